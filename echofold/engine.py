"""The engine's calls: find, select, write, read, verify, inspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.config import MatchConfig
from .operators import archives, candidates, layouts, select


def find_matches(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, origin_match_id, src, dst, len): the best repeats of each stream.

    A candidate of the finder has been compared byte for byte and meets the method's minimum,
    so only what it gains is still asked.
    """
    found = select.gain_filter(candidates.find_candidates(streams, cfg, best=True))
    return select.best_intervals(select.representatives(found))


def compress(streams: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, archive)."""
    return archives.write_archives(find_matches(streams, cfg), streams, cfg)


def compress_with_candidates(streams: DataFrame, rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(stream_id, archive) from a caller's (stream_id, src, dst, len); false ones fail the query."""
    checked = candidates.verified(candidates.external_candidates(rows), streams)
    ok = checked.withColumn("len", F.when(F.col("status") == "ok", F.col("len")).otherwise(F.raise_error(F.concat(F.lit("invalid match: "), "status")).cast("long"))).drop("status")
    return archives.write_archives(select.select_matches(ok, streams, cfg), streams, cfg)


def decompress(archived: DataFrame, **options) -> DataFrame:
    return archives.read_archives(archived, **options)


def verify(archived: DataFrame, **options) -> DataFrame:
    return archives.verify_archives(archived, **options)


def inspect(archived: DataFrame, **options) -> DataFrame:
    return archives.inspect_archives(archived, **options)


def statistics(streams: DataFrame, cfg: MatchConfig, matches: DataFrame | None = None) -> DataFrame:
    """A row for each stream: sizes, counts and coverage, with the size of its container in ``cfg.layout``."""
    matches = find_matches(streams, cfg) if matches is None else matches
    sizes = layouts.encoded_sizes(matches, streams, cfg, (cfg.layout,)).select("stream_id", F.col("encoded_size").alias("archive_size"))
    return select.coverage(matches, streams).join(sizes, "stream_id").select("*", F.lit(cfg.method).alias("method"), F.lit(cfg.layout).alias("layout"), F.lit(cfg.checksum).alias("checksum"))
