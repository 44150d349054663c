"""Line dedup over a sharded minimal perfect hash of line hashes.

One pass counts in how many documents each line key occurs; keys are 128-bit hashes, summed
up within each batch before they are shuffled, so a line in every document costs a row per
batch. The distinct hashes found in at least ``min_docs`` documents go to shards by hash. A
shard is a minimal perfect hash (levels of bit arrays; a key sits at the first level where it
is alone, its rank is its slot) and two arrays by slot: 64-bit fingerprints, of other bits
than the slots, and document counts. A second pass probes these arrays line by line.

Index shards that fit ``broadcast_bytes`` together are sent to every executor. Beyond that,
each document's distinct line hashes go to the shards instead and only those found return.
Both give the same rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches, stash

SPACE = " \t\n\v\f\r"
BROADCAST_BYTES, SHARD_KEYS, PART_TEXTS, GAMMA = 32 << 20, 1 << 18, 1 << 13, 2
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_UPPER)


def key_hash(key: str) -> tuple[int, int]:
    """(slot bits, fingerprint bits) as signed 64-bit numbers."""
    d = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectIndex:
    """A minimal perfect hash over distinct uint64 keys with a fingerprint and a count for each."""

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.prints, self.counts = levels, prints, counts
        ends = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [base + np.concatenate([[0], np.cumsum(x)[:-1]]).astype(np.int64) for x, base in zip(levels, ends, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> PerfectIndex:
        """Keys that are equal in ``keys`` cannot be told apart by slot: of those the first is placed at each further level."""
        levels, order, left = [], [], np.arange(len(keys))
        while len(left):
            size = max(8, GAMMA * len(left))
            at = (_mix(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            if len(levels) > 60:  # equal keys: a run of the same slot at every level
                alone = np.bincount(at, minlength=size) > 0
                first = np.sort(np.unique(at, return_index=True)[1])
                placed = np.zeros(len(left), bool)
                placed[first] = True
            else:
                placed = alone[at]
            bits = np.zeros(size, bool)
            bits[at[placed]] = True
            by_slot = np.argsort(at[placed])
            order.append(left[placed][by_slot])
            levels.append(bits)
            left = left[~placed]
        order = np.concatenate(order) if order else np.array([], np.int64)
        return cls(levels, prints[order], counts[order])

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The count of each key that is in the index, else 0."""
        out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slot = ranks[at[hit]]
            same = self.prints[slot] == prints[left[hit]]
            out[left[hit][same]] = self.counts[slot[same]]
            # past level 60 a slot may hold one of several equal keys, so a wrong print goes on
            left = left[~hit] if level <= 60 else np.concatenate([left[~hit], left[hit][~same]])
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels), len(self.prints)], np.int64)
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in self.levels), self.prints.tobytes(), self.counts.astype(np.uint64).tobytes()])

    @classmethod
    def unpack(cls, data: bytes) -> PerfectIndex:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n + 1, 8)
        at, levels = 8 * (n + 2), []
        for size in sizes[:-1]:
            width = (int(size) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=int(size)).astype(bool))
            at += width
        m = int(sizes[-1])
        return cls(levels, np.frombuffer(data, np.uint64, m, at), np.frombuffer(data, np.uint64, m, at + 8 * m).astype(np.int64))


def _lines(batch, text_col: str):
    for text in batch[text_col].to_pylist():
        yield (text or "").split("\n")


def line_counts(docs: DataFrame, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): in how many rows of ``docs`` each line key of at least ``min_chars`` code points occurs."""

    def run(batches):
        for b in batches:
            found: Counter = Counter()
            for lines in _lines(b, text_col):
                found.update({k for k in map(line_key, lines) if len(k) >= min_chars})
            hashes = [key_hash(k) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array(list(found.values()), pa.int64())], ["h1", "h2", "n"])

    return docs.select(F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, n_shards: int) -> DataFrame:
    """(shard, index): a packed ``PerfectIndex`` for each shard of (h1, h2, n)."""

    def run(rows: pa.Table) -> pa.Table:
        u = lambda c: rows[c].to_numpy().astype(np.int64).view(np.uint64)
        order = np.lexsort((u("h2"), u("h1")))
        index = PerfectIndex.build(u("h1")[order], u("h2")[order], u("n")[order])
        return pa.table({"shard": pa.array([rows["shard"][0].as_py()], pa.int64()), "index": pa.array([index.pack()], pa.binary())})

    return counts.withColumn("shard", F.pmod("h1", F.lit(n_shards).cast("long"))).groupBy("shard").applyInArrow(run, "shard long, index binary")


def _filtered(docs: DataFrame, text_col: str, min_chars: int, min_docs: int, probe_of) -> DataFrame:
    """``docs`` with their other lines in ``kept_text``; ``probe_of()`` gives, in the task, batch and keys -> counts."""
    names = ("kept_text", "n_lines", "n_dropped")
    kinds = (T.StringType(), T.LongType(), T.LongType())
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches):
        probe = probe_of()
        for b in batches:
            texts = list(_lines(b, text_col))
            keys = [[line_key(x) for x in lines] for lines in texts]
            drop = probe(b, keys)
            kept, n, gone = [], [], []
            for lines, own in zip(texts, keys, strict=True):
                left = [x for x, k in zip(lines, own, strict=True) if len(k) < min_chars or k not in drop]
                kept.append("\n".join(left))
                n.append(len(lines))
                gone.append(len(lines) - len(left))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def drop_common_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``: lines in at least ``min_docs`` rows are dropped in all.

    A line's key is the line without ASCII white space at its ends, in ASCII lower case. Keys
    of less than ``min_chars`` code points stay. Null and empty texts are one empty line. A
    line that occurs twice in a row of the table counts once there; repeated rows count each.
    An empty table gives none. Columns named like the new ones are replaced.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    frequent = stash(line_counts(docs, text_col, min_chars).where(F.col("n") >= min_docs), "frequent-lines")
    n = frequent.count()
    n_shards = max(1, ceil(n / shard_keys))
    index = stash(build_index(frequent, n_shards), "line-index")
    size = index.agg(F.coalesce(F.sum(F.octet_length("index")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        return _by_broadcast(docs, index, n_shards, text_col, min_chars, min_docs)
    return _by_shards(docs, index, n_shards, text_col, min_chars, min_docs)


def _by_broadcast(docs, index, n_shards, text_col, min_chars, min_docs) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["index"]) for r in index.collect()})

    def probe_of():
        shards = {k: PerfectIndex.unpack(v) for k, v in sent.value.items()}

        def probe(_, keys):
            distinct = list({k for own in keys for k in own if len(k) >= min_chars})
            h = np.array([key_hash(k) for k in distinct], np.int64).reshape(-1, 2)
            of, found = h[:, 0] % n_shards, np.zeros(len(h), np.int64)
            for s in np.unique(of):
                if s in shards:
                    at = np.flatnonzero(of == s)
                    found[at] = shards[s].count(h[at, 0].view(np.uint64), np.ascontiguousarray(h[at, 1]).view(np.uint64))
            return {k for k, c in zip(distinct, found, strict=True) if c >= min_docs}

        return probe

    return _filtered(docs, text_col, min_chars, min_docs, probe_of)


def _by_shards(docs, index, n_shards, text_col, min_chars, min_docs) -> DataFrame:
    """The hashes of each text go to the shards; a text's hits come back as an array of its dropped hashes.

    Hashes are sent once for each distinct text and split over parts of bounded size by text,
    so a line in every text does not gather in one task.
    """
    parts = max(8, ceil(docs.count() / PART_TEXTS))

    def hashes(batches):
        for b in batches:
            rows = [(t, *key_hash(k)) for t, lines in zip(b["text_id"].to_pylist(), _lines(b, text_col), strict=True) for k in {line_key(x) for x in lines} if len(k) >= min_chars]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["text_id", "h1", "h2"])

    def hit(asked: pa.Table, own: pa.Table) -> pa.Table:
        if own.num_rows and asked.num_rows:
            u = lambda c: asked[c].to_numpy().astype(np.int64).view(np.uint64)
            asked = asked.filter(pa.array(PerfectIndex.unpack(own["index"][0].as_py()).count(u("h1"), u("h2")) >= min_docs))
        else:
            asked = asked.slice(0, 0)
        return asked.select(["text_id", "h1", "h2"])

    text_id = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    # rows travel packed, so that no column of theirs meets one made here
    named = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), text_id.alias("own_id"), F.col(text_col).cast("string").alias("text"))
    texts = named.groupBy(F.col("own_id").alias("text_id")).agg(F.first("text").alias(text_col))
    asked = texts.mapInArrow(hashes, "text_id binary, h1 long, h2 long").withColumn("shard", F.pmod("h1", F.lit(n_shards).cast("long"))).withColumn("part", F.pmod(F.xxhash64("text_id"), F.lit(parts).cast("long")))
    shards = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    hits = asked.groupBy("shard", "part").cogroup(shards.groupBy("shard", "part")).applyInArrow(hit, "text_id binary, h1 long, h2 long")
    gone = stash(hits.groupBy("text_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone")), "line-hits")
    joined = named.join(gone.hint("merge"), F.col("own_id") == F.col("text_id"), "left").select("row", "gone", "text")

    def probe_of():
        def probe(b, keys):
            gone = {(x["h1"], x["h2"]) for own in b["gone"].to_pylist() for x in own or ()}
            return {k for own in keys for k in own if key_hash(k) in gone} if gone else set()

        return probe

    out = _filtered(joined, "text", min_chars, min_docs, probe_of)
    return out.select("row.*", "kept_text", "n_lines", "n_dropped")


def without_common_lines(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs``, with its columns, their texts without common lines and ``length_col`` their new length; every row stays."""
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(docs[c] for c in others), F.lit(0).alias("none")).alias("packed"), docs[text_col].alias("text"))
    out = drop_common_lines(packed, text_col="text", **options)
    columns = {c: F.col("kept_text") if c == text_col else F.col("packed").getField(c) for c in docs.columns}
    if length_col in docs.columns:
        columns[length_col] = F.char_length("kept_text").cast(docs.schema[length_col].dataType)
    return out.select(*(v.alias(k) for k, v in columns.items()))


def line_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each row of ``docs``; see ``drop_common_lines``."""
    out = drop_common_lines(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
