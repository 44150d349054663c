"""Scans: streams (stream_id, payload, byte_len) to blocks, seeds, windows, representatives and chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.config import MatchConfig
from ..functions.hashing import PrefixHash, as_bytes, crc32c
from ..functions.kernels import Joined, chunk_ends, representatives, together


def blocks(streams: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, block_id, start, len, bytes): fixed-size blocks, the last one shorter; none for an empty stream."""
    ids = F.when(F.col("byte_len") > 0, F.sequence(F.lit(0).cast("long"), F.expr(f"(byte_len - 1) div {block_size}"))).otherwise(F.array().cast("array<bigint>"))
    start = F.col("block_id") * block_size
    size = F.least(F.lit(block_size).cast("long"), F.col("byte_len") - start)
    return streams.select("stream_id", "payload", "byte_len", F.explode(ids).alias("block_id")).select(
        "stream_id", "block_id", start.alias("start"), size.alias("len"), F.substring("payload", (start + 1).cast("int"), size.cast("int")).alias("bytes")
    )


@F.pandas_udf(T.LongType())
def crc32c_of(data: pd.Series) -> pd.Series:
    """CRC-32C (not the CRC-32 of Spark's own function)."""
    return pd.Series([None if b is None else crc32c(b) for b in data], dtype="Int64")


def block_digests(streams: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, block_id, start, len, crc32c, sha256)."""
    return blocks(streams, block_size).select("stream_id", "block_id", "start", "len", crc32c_of("bytes").alias("crc32c"), F.sha2("bytes", 256).alias("sha256"))


def grid_seeds(streams: DataFrame, seed: int) -> DataFrame:
    """(stream_id, position, key, bytes): the whole aligned pieces of ``seed`` bytes, with their MD5 as key."""
    at = F.when(F.col("byte_len") >= seed, F.sequence(F.lit(0).cast("long"), F.col("byte_len") - seed, F.lit(seed).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    pieces = streams.select("stream_id", "payload", F.explode(at).alias("position")).select("stream_id", "position", F.substring("payload", (F.col("position") + 1).cast("int"), F.lit(seed)).alias("bytes"))
    return pieces.select("stream_id", "position", F.md5("bytes").alias("key"), "bytes")


def windows(streams: DataFrame, length: int) -> DataFrame:
    """(stream_id, position, hash): the polynomial hash of every window, as the bit pattern of a BIGINT."""

    def run(batches):
        for b in batches:
            for sid, payload in zip(b["stream_id"].to_pylist(), b["payload"].to_pylist(), strict=True):
                h = PrefixHash(as_bytes(payload)).windows(length) if len(payload) >= length else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), sid), pa.int64()), pa.array(np.arange(len(h)), pa.int64()), pa.array(h.view(np.int64))], ["stream_id", "position", "hash"])

    return streams.select("stream_id", "payload").mapInArrow(run, "stream_id long, position long, hash long")


def _per_stream(streams: DataFrame, make, schema: str, kinds: list) -> DataFrame:
    """A row for each entry of the arrays that ``make`` gives for a payload, with its stream's id; a batch for each batch read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            found = [make(p) for p in b["payload"].to_pylist()]
            ids = np.repeat(b["stream_id"].to_numpy(zero_copy_only=False), [len(f[0]) for f in found])
            columns = [np.concatenate([f[i] for f in found]) for i in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return streams.select("stream_id", "payload").mapInArrow(run, schema)


def region_representatives(streams: DataFrame, region: int) -> DataFrame:
    """(stream_id, region_id, position, hash, visible_at): each region's window of largest unsigned hash, ties to the first.

    A region cut off by the end of the stream is never visible and left out.
    """

    def make(payload: bytes):
        h = PrefixHash(as_bytes(payload)).windows(region) if len(payload) >= region else np.zeros(0, np.uint64)
        at, visible = representatives(h, region)
        return np.arange(len(at)), at, h[at].view(np.int64), visible

    return _per_stream(streams, make, "stream_id long, region_id long, position long, hash long, visible_at long", [pa.int64()] * 4)


def joined(batches):
    """(ids, payloads joined) of Arrow batches of streams, some at a time."""
    for b in batches:
        ids, sizes = b["stream_id"].to_numpy(zero_copy_only=False), pc.binary_length(b["payload"]).to_numpy(zero_copy_only=False)
        for r in together(sizes.tolist()):
            yield ids[r.start : r.stop], Joined(b["payload"].slice(r.start, len(r)).to_pylist())


def cdc_chunks(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, block_id, start, end, key): content-defined chunks by m1 or m2, with the MD5 of their bytes."""

    def run(batches):
        for ids, j in joined(batches):
            ends = chunk_ends(j, cfg)
            starts = np.concatenate([[0], ends])[:-1]
            own = j.owner(starts)
            at = starts - j.start[own]
            numbers = [pa.array(x, pa.int64()) for x in (ids[own], at // cfg.block_size, at, ends - j.start[own])]
            pieces = pa.array([j.data[a:e] for a, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*numbers, pieces], ["stream_id", "block_id", "start", "end", "bytes"])

    raw = streams.select("stream_id", "payload").mapInArrow(run, "stream_id long, block_id long, start long, end long, bytes binary")
    return raw.select("stream_id", "block_id", "start", "end", F.md5("bytes").alias("key"))


def byte_statistics(streams: DataFrame) -> DataFrame:
    """(stream_id, byte_len, distinct_bytes, top_share, entropy): the histogram of bytes, reduced; nothing for empty streams."""

    def make(payload: bytes):
        seen = np.bincount(as_bytes(payload), minlength=256)
        share = seen[seen > 0] / len(payload)
        return [len(payload)], [len(share)], [share.max()], [-(share * np.log2(share)).sum()]

    return _per_stream(streams.where("byte_len > 0"), make, "stream_id long, byte_len long, distinct_bytes long, top_share double, entropy double", [pa.int64(), pa.int64(), pa.float64(), pa.float64()])


def ordinals(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``ordinal``: a stream's chunks numbered from 0 by where they start."""
    return chunks.withColumn("ordinal", (F.row_number().over(Window.partitionBy("stream_id").orderBy("start", "end")) - 1).cast("long"))
