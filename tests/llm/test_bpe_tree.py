import hashlib
import tracemalloc

from hypothesis import example, given, settings
from hypothesis import strategies as st

from echofold.llm.bpe_tree import _Tokens, codec, decode_documents, encode_documents, token_digests

ALPHABET = st.text(alphabet=" \n\t  a'srelvdmlx1!é世　’́😀", max_size=80)


@settings(max_examples=600, deadline=None)
@given(ALPHABET, st.sampled_from([1, 2, 3, 5, 16, 64]))
@example("we'" + "re" * 3, 3)
@example(" " * 40 + "x", 4)
@example("a" * 70, 8)
def test_tree_equals_the_plain_encoder(text, leaf):
    c = codec(None, None)
    ids = c.encode(text, leaf)
    assert ids == c.plain.encode_ordinary(text) and c.decode(ids, leaf) == text.encode()


def test_very_long_pieces_and_texts():
    c = codec(None, None)
    for text in ("a" * 50_000, " " * 20_000 + "b", "it's 12 o'clock, \n\n" * 4_000, "世" * 9_000):
        assert c.encode(text) == c.plain.encode_ordinary(text)


def test_given_documents(spark):
    c = codec(None, None)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_digests(docs).collect():
        ids = c.plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "q"), (None, "hi there", "q"), (2, "", "q"), (2, "", "q")], "doc_id long, text string, n_tokens string")
    empty = hashlib.sha256(b"").hexdigest()
    rows = token_digests(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 0), (2, 0), (2, 0)] and {r.decoded_sha256 for r in rows if r.doc_id} == {empty}
    assert token_digests(df.limit(0)).count() == 0
    both = decode_documents(encode_documents(df.withColumnRenamed("n_tokens", "token_ids")))
    assert sorted(bytes(r.decoded) for r in both.collect()) == [b"", b"", b"", b"hi there"] and both.columns == ["doc_id", "text", "token_ids", "decoded"]


def test_pieces_held_take_little_memory():
    tokens = _Tokens(lambda piece: [300 + i for i in range(len(piece))])
    tracemalloc.start()
    for i in range(300_000):
        assert tokens[f"piece{i}"][0][0] == 300
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
