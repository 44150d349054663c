"""Byte-level BPE as a monoid: encode parts of a text on their own, join neighbours up a tree.

A text is cut into leaves of at most ``leaf`` code points. The element of a part is the list
of its pieces (matches of the tokenizer's pattern), each with its tokens, as if the part stood
alone; a leaf's element is made directly. Joining two parts encodes a window around the cut
again: it starts at a piece of the left part and the pattern runs on from there over both.
What is left of the window and right of it stays as it is, once both are proven stable:

* left: the pattern looks at no more than ``LOOK`` code points behind a piece, except to the
  end of a run of white space. A piece that ends ``LOOK`` before the cut, and is not in a run of
  white space that touches the cut, is matched alike with and without what follows. Pieces
  are matched one after the other and nothing looks back, so all before it are, too.
* right: as nothing looks back, once a piece of the window ends where a piece of the right
  part begins, all pieces from there on are those of the right part.

If the window ends before that, it grows, at most to the whole right part. Pieces longer than
a leaf are treated alike: they lie in the window as a whole, so the result is that of the
whole text. Decoding concatenates the bytes of the leaves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: Code points behind a piece that the pattern can look at (``'re``, and the end of a run).
LOOK = 3
LEAF = 2_048


class _Tokens(dict):
    """piece -> (its ids, its ids as text): filled as pieces are met, emptied when it has grown too large."""

    def __init__(self, encode_piece, most: int = 1 << 16):
        self.encode_piece, self.most = encode_piece, most

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.encode_piece(piece))
        out = ids, ",".join(map(str, ids))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encodes by the ranks in ``ranks_path``, each match of ``pattern`` on its own, without special tokens."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = _Tokens(lambda piece: self.plain._encode_single_piece(piece.encode("utf-8", "surrogatepass")))
        self.bytes_of = {b: a for a, b in ranks.items()}

    def leaf(self, text: str) -> tuple[list, list]:
        """The pieces of a text on its own, and their tokens."""
        pieces = self.find.findall(text)
        return pieces, list(map(self.tokens.__getitem__, pieces))

    def join(self, text: str, left: tuple, right: tuple, cut: int, end: int) -> tuple[list, list]:
        """The element of the part up to ``end``, from those of the two parts that meet at ``cut``."""
        pieces, tokens = left
        others, more = right
        run = cut
        while run and text[run - 1].isspace():
            run -= 1
        at, i = cut, len(pieces)
        while i:
            i -= 1
            at -= len(pieces[i])
            if at <= cut - LOOK and at <= run:
                break  # the piece before it ends here: LOOK before the cut, and not within the run
        new, j, start, reach = [], 0, cut, max(64, 2 * (cut - at))
        while at < end and not (at >= cut and at == start):
            stop = min(end, cut + reach)
            m = self.find.match(text, at, stop) if at < stop else None
            if m is None or stop < end and (m.end() > stop - LOOK or text[m.end() - 1].isspace() and text[m.end() : stop].isspace()):
                if stop == end:
                    raise ValueError("the pattern has to match everywhere")
                reach *= 2  # the end of the window might change this piece
                continue
            new.append(m.group())
            at = m.end()
            while start < at and j < len(others):
                start += len(others[j])
                j += 1
        del pieces[i:], tokens[i:]
        pieces += new + others[j:]
        tokens += [*map(self.tokens.__getitem__, new), *more[j:]]
        return pieces, tokens

    def element(self, text: str, leaf: int = LEAF, at: int = 0, end: int | None = None) -> tuple[list, list]:
        """Pieces and tokens of text[at:end]: the monoid's element, reduced over a balanced tree."""
        end = len(text) if end is None else end
        if end - at <= leaf:
            return self.leaf(text[at:end])
        cut = (at + end) // 2
        base = text[at:end]
        return self.join(base, self.element(base, leaf, 0, cut - at), self.element(base, leaf, cut - at), cut - at, end - at)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return list(chain.from_iterable(x[0] for x in self.element(text, leaf)[1]))

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """Concatenates what the halves decode to; leaves look their tokens up."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


@lru_cache(4)
def codec(ranks_path: str | None, pattern: str | None) -> Codec:
    import public_tokenizers

    return Codec(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def _texts(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def encode_documents(df: DataFrame, *, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, leaf: int = LEAF, out_col: str = "token_ids") -> DataFrame:
    """``df`` with an array of token ids in ``out_col``; a null text is the empty one, and gives no tokens.

    ``ranks_path`` and ``pattern`` default to the multilingual public tokenizer; the file
    has to be on every executor. An equally named column is replaced; all others are kept.
    """
    short_batches(df.sparkSession)
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            yield b.append_column(out_col, pa.array([c.encode(x, leaf) for x in _texts(b[text_col])], pa.list_(pa.int32())))

    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, *, ids_col: str = "token_ids", ranks_path: str | None = None, pattern: str | None = None, out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes in ``out_col``; null ids decode to no bytes."""
    df = df.drop(out_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())])

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            yield b.append_column(out_col, pa.array([c.decode(x or []) for x in b[ids_col].to_pylist()], pa.binary()))

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids.

    Row by row in one pass: no shuffle, and no key can gather rows. Repeated rows give
    repeated rows, an empty table none; a null id stays null.
    """
    short_batches(df.sparkSession)
    keep = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            n, ids_hex, bytes_hex = [], [], []
            for text in _texts(b["text"]):
                tokens = c.element(text, leaf)[1]
                ids = list(chain.from_iterable(x[0] for x in tokens))
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(x[1] for x in tokens).encode()).hexdigest())
                bytes_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keep.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
