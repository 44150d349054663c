"""Candidates: (stream_id, src, dst, len, method, phase), each an equal range at an earlier position.

Within a stream (``find_candidates``) the history is the stream's own, so streams are the
unit of work and nothing is shuffled. Across streams (``corpus_*``) seeds or chunks are keyed
by digest and each is matched with the first of its key; ranges do not cross rows there, as a
corpus has no order of bytes between rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import MatchConfig
from ..functions.kernels import Found, Joined, find, find_overlay
from .scans import cdc_chunks, grid_seeds, joined

SCHEMA = "stream_id long, src long, dst long, len long, method string, phase int"
BASE, OVERLAY, EXTERNAL = 0, 1, 255


def find_candidates(streams: DataFrame, cfg: MatchConfig, *, best: bool = False) -> DataFrame:
    """The distinct candidates of ``cfg.method`` (phase 0) and of its overlay (phase 1) in each stream.

    With ``best``, those of the smallest source for each destination and length stand for all,
    which is what ``select.representatives`` would keep of them.
    """
    names = ["stream_id", "src", "dst", "len", "method", "phase"]

    def batch(ids: np.ndarray, j: Joined, found: list[tuple[Found, str, int]]) -> pa.RecordBatch:
        sizes = [len(f.src) for f, _, _ in found]
        src, dst, n = (np.concatenate([getattr(f, c) for f, _, _ in found]) for c in ("src", "dst", "length"))
        own = j.owner(dst)
        label = lambda i, kind: pa.array(np.repeat(np.array([f[i] for f in found], object if kind == pa.string() else np.int64), sizes), kind)
        return pa.RecordBatch.from_arrays([pa.array(ids[own], pa.int64()), pa.array(src - j.start[own], pa.int64()), pa.array(dst - j.start[own], pa.int64()), pa.array(n, pa.int64()), label(1, pa.string()), label(2, pa.int32())], names)

    def run(batches):
        for ids, j in joined(batches):
            # that of the overlay first: its runs are shorter, so those of the base are among them
            found = [(find_overlay(j, cfg, best), "m0", OVERLAY)] if cfg.overlay else []
            yield batch(ids, j, [(find(j, cfg, best), cfg.method, BASE), *found])

    return streams.select("stream_id", "payload").mapInArrow(run, SCHEMA)


def candidate_metrics(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, raw_events, distinct_candidates) of the base method."""
    return metrics_of_methods(streams, {cfg.method: cfg}).drop("method")


def metrics_of_methods(streams: DataFrame, configs: dict[str, MatchConfig]) -> DataFrame:
    """(stream_id, raw_events, distinct_candidates, method) of the base method of each of ``configs``, by its name.

    Streams are read once, and what methods have in common is searched once.
    """
    names = ["stream_id", "raw_events", "distinct_candidates", "method"]

    def run(batches):
        for ids, j in joined(batches):
            for name, cfg in configs.items():
                f = find(j, cfg, best=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f.raw, pa.int64()), pa.array(f.distinct, pa.int64()), pa.array([name] * len(ids), pa.string())], names)

    return streams.select("stream_id", "payload").mapInArrow(run, "stream_id long, raw_events long, distinct_candidates long, method string")


def external_candidates(df: DataFrame) -> DataFrame:
    """A caller's (stream_id, src, dst, len) as candidates; ``verified`` tells which are true."""
    return df.select("stream_id", "src", "dst", "len", F.lit("external").alias("method"), F.lit(EXTERNAL).alias("phase"))


def verified(rows: DataFrame, streams: DataFrame) -> DataFrame:
    """``rows`` with ``status``: ok, or why the range is no candidate. The bytes are compared, periodically where the ranges overlap."""
    s, d, n = F.col("src").cast("int"), F.col("dst").cast("int"), F.col("len").cast("int")
    same = F.substring("payload", s + 1, n) == F.substring("payload", d + 1, n)
    status = (
        F.when(F.col("payload").isNull(), "no such stream")
        .when((F.col("src") < 0) | (F.col("src") >= F.col("dst")), "source is not before destination")
        .when((F.col("len") <= 0) | (F.col("dst") + F.col("len") > F.col("byte_len")), "out of range")
        .when(~same, "bytes differ")
        .otherwise("ok")
    )
    return rows.join(streams.select("stream_id", "payload", "byte_len"), "stream_id", "left").withColumn("status", status).drop("payload", "byte_len")


def chunk_pairs(chunks: DataFrame, cfg: MatchConfig) -> DataFrame:
    """All earlier equal chunks of each chunk of a stream, by a self-join of ``cdc_chunks``."""
    keyed = chunks.withColumn("len", F.col("end") - F.col("start")).where(F.col("len") >= cfg.min_match)
    a = keyed.select("stream_id", "key", "len", F.col("start").alias("src"))
    b = keyed.select("stream_id", "key", "len", F.col("start").alias("dst"))
    joined = a.join(b, ["stream_id", "key", "len"]).where("src < dst")
    if cfg.distance_cap:
        joined = joined.where(F.col("dst") - F.col("src") <= cfg.distance_cap)
    return joined.select("stream_id", "src", "dst", "len", F.lit(cfg.method).alias("method"), F.lit(BASE).alias("phase"))


def _first_of_key(keyed: DataFrame) -> DataFrame:
    """Each row of (key, len, stream_id, position) but a key's first, with that first as source.

    A key in a third of all rows would gather in one task: its first place is an aggregate
    that every task forms in part, and the join back is one that Spark splits where a key's
    rows are too many for a task.
    """
    at = F.struct("stream_id", "position")
    first = keyed.groupBy("key", "len").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "len", "first")
    return keyed.join(first, ["key", "len"]).where(at != F.col("first")).select(
        F.col("first.stream_id").alias("src_stream"), F.col("first.position").alias("src"), "stream_id", F.col("position").alias("dst"), F.col("len").cast("long").alias("len")
    )


def corpus_seed_matches(streams: DataFrame, seed: int) -> DataFrame:
    """(src_stream, src, stream_id, dst, len): aligned seeds with equal bytes, each with the first by (stream, position).

    The key is the seed itself up to 64 bytes, else its SHA-256.
    """
    seeds = grid_seeds(streams, seed).withColumn("key", F.col("bytes") if seed <= 64 else F.unhex(F.sha2("bytes", 256))).drop("bytes")
    return _first_of_key(seeds.withColumn("len", F.lit(seed)))


def corpus_chunk_matches(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(src_stream, src, stream_id, dst, len): chunks with equal length and digest, each with the first."""
    chunks = cdc_chunks(streams, cfg).select("stream_id", F.col("start").alias("position"), (F.col("end") - F.col("start")).alias("len"), "key")
    return _first_of_key(chunks.where(F.col("len") >= cfg.min_match))
