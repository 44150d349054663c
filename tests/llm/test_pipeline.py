"""The stages against what each should do to its own input, and the registry."""

import hashlib
import re
from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from echofold.llm.bpe_tree import codec
from echofold.llm.common import stash
from echofold.llm.line_dedup import line_key
from echofold.llm.order_minhash import alike_pairs, word_hashes
from echofold.llm.registry import ORACLE_SQL, QUERIES

from .test_order_minhash import passage_and_few_words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, SF), "stage")
        assert docs.dtypes == columns, name
        rows = docs.collect()
        seen.append({r.doc_id: r.text for r in rows})
        assert all(r.n_chars == len(r.text) for r in rows)
    raw, good, lines, near, mixed = seen
    assert set(good) <= set(raw) and all(labels.get(i) != 1 for i in set(raw) - set(good))
    found = Counter(k for t in good.values() for k in {line_key(x) for x in t.split("\n")} if k)
    assert lines == {i: "\n".join(x for x in t.split("\n") if found[line_key(x)] < 10) for i, t in good.items()}
    words = {i: word_hashes(t) for i, t in lines.items()}
    for i in set(lines) - set(near):
        assert any(lines[i] == lines[j] for j in lines if j != i) or alike_pairs([(words[i], words[j]) for j in lines if j != i]).any()
    kept = sorted(near)
    assert not alike_pairs([(words[i], words[j]) for k, i in enumerate(kept) for j in kept[:k]]).any()
    c = codec(None, None)
    want = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(c.plain.encode_ordinary(r.text))) for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in last) == want
    sizes = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in near.values())
    assert abs(sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()) - sizes) < 0.02 * sizes


def test_registry():
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(QUERIES)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_odd_tables_pass_every_stage(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, text_id string, score double, taken long, node string, row int"
    extra = ("x", 1, "s", "t", 0.5, 7, "n", 3)
    good = "A plain sentence with some words, and then another one that follows. It ends here."
    rows = [(None, None, "en", None, 0), (1, "", "en", "a", 0), (2, good, "en", "a", len(good)), (2, good, "en", "a", len(good)), (3, good + " More.", "en", None, 0), (None, good[:40], None, "b", 40), (4, "word " * 30_000, "en", "b", 0)]
    frame = spark.createDataFrame([(*r[:4], r[4], *extra[1:]) for r in rows], schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int")
    for k, docs in enumerate((frame, frame.limit(0))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.limit(4 * (1 - k)).write.parquet(f"{tmp_path}/{k}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            now = stash(stage(spark, now, f"{tmp_path}/{k}"), "stage")
            if name != "byte-level BPE":
                assert now.dtypes == docs.dtypes, name
                assert all((r["size"], r.shard, r.text_id, r.taken, r.row) == (1, "s", "t", 7, 3) for r in now.collect())
        assert "ids_sha256" in now.columns and (k == 0 or now.count() == 0)
    assert corpus_pipeline.run(spark, f"{tmp_path}/1").count() == 0


def test_near_stage_keeps_one_of_each_pair_among_many_texts_of_a_passage(spark):
    texts = passage_and_few_words(400)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect())
    assert kept == list(range(0, len(texts), 2))
