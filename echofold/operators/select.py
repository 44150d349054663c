"""From candidates to matches: filters, dedup, representatives, islands and the best set of intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import MATCH_COST, MatchConfig
from ..functions.kernels import select


def gain_filter(candidates: DataFrame) -> DataFrame:
    """Candidates that save more than a reference costs. Shorter ones are dropped without complaint."""
    return candidates.where(F.col("len") > MATCH_COST)


def interval_status(candidates: DataFrame, streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """``candidates`` with ``status``: ok or the first rule that the interval breaks; after ``gain_filter``."""
    status = (
        F.when(F.col("byte_len").isNull(), "no such stream")
        .when((F.col("src") < 0) | (F.col("src") >= F.col("dst")), "source is not before destination")
        .when(F.col("len") > F.col("byte_len") - F.col("dst"), "out of range")
        .when(F.col("len") < cfg.effective_min_match, "below the minimum")
        .otherwise("ok")
    )
    if cfg.distance_cap:
        status = F.when(F.col("dst") - F.col("src") > cfg.distance_cap, "too far").otherwise(status)
    return candidates.join(streams.select("stream_id", "byte_len"), "stream_id", "left").withColumn("status", status).drop("byte_len")


def triples(candidates: DataFrame) -> DataFrame:
    """Distinct (stream_id, src, dst, len); of equal ones the earliest phase."""
    return candidates.groupBy("stream_id", "src", "dst", "len").agg(F.min("phase").alias("phase"))


def representatives(candidates: DataFrame) -> DataFrame:
    """(stream_id, dst, len, src): for each destination interval the smallest source. Every length stays."""
    return candidates.groupBy("stream_id", "dst", "len").agg(F.min("src").alias("src"))


def islands(intervals: DataFrame) -> DataFrame:
    """``intervals`` with ``island``: groups between which no interval reaches; each can be solved alone."""
    by = Window.partitionBy("stream_id").orderBy("dst", "len", "src")
    reach = F.max(F.col("dst") + F.col("len")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("dst") >= reach), 1).otherwise(0)
    return intervals.withColumn("__new", new).withColumn("island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__new")


def best_intervals(intervals: DataFrame) -> DataFrame:
    """(stream_id, origin_match_id, src, dst, len): the best set that does not overlap in each stream.

    ``intervals`` has a row per (stream_id, dst, len). One shuffle brings a stream's rows
    together, in order; the task then solves one stream after the other.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            sid, src, dst, length = (np.concatenate([b[c].to_numpy() for b in rows]) for c in ("stream_id", "src", "dst", "len"))
            keep = select(dst, src, length, MATCH_COST)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sid[keep], np.arange(len(keep)), src[keep], dst[keep], length[keep])], ["stream_id", "origin_match_id", "src", "dst", "len"])

        for b in batches:
            ids = b["stream_id"].to_numpy()
            ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            start = 0
            for end in ends:
                part = b.slice(start, end - start)
                if held and part.num_rows and held[0]["stream_id"][0] != part["stream_id"][0]:
                    yield solve(held)
                    held = []
                if part.num_rows:
                    held.append(part)
                start = end
        if held:
            yield solve(held)

    ordered = intervals.select("stream_id", "src", "dst", "len").repartition("stream_id").sortWithinPartitions("stream_id", "dst", "src")
    return ordered.mapInArrow(run, "stream_id long, origin_match_id long, src long, dst long, len long")


def select_matches(candidates: DataFrame, streams: DataFrame, cfg: MatchConfig, *, strict: bool = True) -> DataFrame:
    """Matches from any candidates, a caller's too.

    With ``strict`` a candidate that breaks a rule fails the query; else it is left out.
    """
    checked = interval_status(gain_filter(candidates), streams, cfg)
    if strict:
        # raise_error sits in the value of a used column, so it can't be optimised away
        ok = checked.withColumn("len", F.when(F.col("status") == "ok", F.col("len")).otherwise(F.raise_error(F.concat(F.lit("invalid match: "), "status")).cast("long")))
    else:
        ok = checked.where("status = 'ok'")
    return best_intervals(representatives(ok))


def coverage(matches: DataFrame, streams: DataFrame) -> DataFrame:
    """(stream_id, original_size, semantic_match_count, covered_bytes, literal_bytes) of every stream."""
    sums = matches.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("covered"))
    n, c = F.coalesce("n", F.lit(0)), F.coalesce("covered", F.lit(0))
    return streams.select("stream_id", "byte_len").join(sums, "stream_id", "left").select("stream_id", F.col("byte_len").alias("original_size"), n.alias("semantic_match_count"), c.alias("covered_bytes"), (F.col("byte_len") - c).alias("literal_bytes"))


def order_violations(matches: DataFrame) -> DataFrame:
    """(stream_id, overlaps, disordered): how often an interval begins before the last has ended, or ids do not follow dst."""
    by = Window.partitionBy("stream_id").orderBy("dst", "src", F.desc("len"))
    rows = matches.withColumn("before", F.lag(F.col("dst") + F.col("len")).over(by)).withColumn("nth", F.row_number().over(by) - 1)
    return rows.groupBy("stream_id").agg(F.count_if(F.col("dst") < F.col("before")).alias("overlaps"), F.count_if(F.col("nth") != F.col("origin_match_id")).alias("disordered"))


def match_count_bound(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, most_matches): no selection can have more."""
    return streams.select("stream_id", F.least(F.expr(f"byte_len div {cfg.effective_min_match}"), F.expr(f"byte_len div {MATCH_COST + 1}")).alias("most_matches"))
