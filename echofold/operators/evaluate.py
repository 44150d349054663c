"""Comparing runs: means, majorities, ratios, populations, and records parsed from logs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import MatchConfig
from ..functions.container import WIDTH
from ..functions.errors import EngineError
from ..functions.kernels import Found, Joined, chosen
from .layouts import CRC_BYTES, HEADER_BYTES, TAIL_BYTES
from .scans import joined

#: key=value fields of a profile line, all numbers but the event's name.
PROFILE_NUMBERS = ("elapsed_ms", "ram", "ram_peak", "temp", "temp_peak", "handles", "files", "io")


def geometric_mean(value: Column) -> Column:
    """0 if any value is 0; null over no rows."""
    return F.when(F.min(value) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(value))))


def sizes_of_methods(streams: DataFrame, configs: dict[str, MatchConfig], base: str) -> DataFrame:
    """(stream_id, kind, original_size, semantic_match_count, covered_bytes, archive_size, base_size) of each stream by each of ``configs``.

    ``archive_size`` is that of its container in the index layout, ``base_size`` that by the
    configuration named ``base``. Matches are found, chosen and summed up where the stream is:
    it is read once, what methods have in common is searched once, and nothing is shuffled.
    """
    if any(c.layout != "index" for c in configs.values()):
        raise EngineError("InvalidConfiguration", "sizes of the index layout only")
    names = ["stream_id", "kind", "original_size", "semantic_match_count", "covered_bytes", "archive_size", "base_size"]

    def run(batches):
        for ids, j in joined(batches):
            sizes = {k: _index_sizes(j, chosen(j, cfg), cfg) for k, cfg in configs.items()}
            for k, columns in sizes.items():
                rows = [ids, np.diff(j.start), *columns, sizes[base][-1]]
                made = [pa.array(x, pa.int64()) for x in rows]
                yield pa.RecordBatch.from_arrays([made[0], pa.array([k] * len(ids), pa.string()), *made[1:]], names)

    return streams.select("stream_id", "payload").mapInArrow(run, "stream_id long, kind string, " + ", ".join(f"{n} long" for n in names[2:]))


def _index_sizes(j: Joined, matches: Found, cfg: MatchConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matches, bytes covered, bytes of the container in the index layout) of each payload, from its matches in order."""
    v = lambda x: 1 + sum((x >= 1 << 7 * k).astype(np.int64) for k in range(1, 9))
    src, dst, n = matches.src, matches.dst, matches.length
    begin = j.start[j.owner(dst)]
    gap = dst - np.maximum(begin, np.concatenate([[0], (dst + n)[:-1]]) if len(dst) else begin)
    size = np.diff(j.start)
    count, covered, table = (j.each(dst, x) for x in (np.ones(len(dst), np.int64), n, v(gap) + v(dst - src) + v(n)))
    fixed = HEADER_BYTES + TAIL_BYTES + 2 * WIDTH[cfg.checksum]
    return count, covered, fixed + size - covered + -(-size // cfg.block_size) * CRC_BYTES + v(count) + table


def compare_sizes(new: DataFrame, old: DataFrame, keys: list[str], group: list[str], size: str) -> DataFrame:
    """Wins, ties and losses of ``new`` against ``old`` by ``group``; a strict majority of wins passes.

    Rows that only one side has are counted as ``missing`` (in old only) and ``unexpected``.
    """
    a, b = new.select(*keys, F.col(size).alias("new_size")), old.select(*keys, F.col(size).alias("old_size"))
    both = a.join(b, keys, "full_outer")
    n, o = F.col("new_size"), F.col("old_size")
    out = both.groupBy(*group).agg(
        F.count_if(n < o).alias("wins"), F.count_if(n == o).alias("ties"), F.count_if(n > o).alias("losses"),
        F.count_if(n.isNull()).alias("missing"), F.count_if(o.isNull()).alias("unexpected"), F.min_by("new_size", n / o).alias("best_new_size"), F.max(n / o).alias("worst_ratio"),
    )
    total = F.col("wins") + F.col("ties") + F.col("losses")
    return out.withColumn("majority", (F.col("wins") * 2 > total) & (F.col("missing") == 0) & (F.col("unexpected") == 0))


def ratios(candidate: DataFrame, baseline: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """<metric>_ratio of candidate to baseline; null where the baseline is 0 or missing."""
    b = baseline.select(*keys, *(F.col(m).alias(f"__{m}") for m in metrics))
    return candidate.join(b, keys, "left").select(*keys, *(F.try_divide(F.col(m), F.col(f"__{m}")).alias(f"{m}_ratio") for m in metrics))


def population_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with ``side``; none if the two are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def parse_profile(lines: DataFrame, col: str = "value", mark: str = "PROFILE") -> DataFrame:
    """(event, numbers, ok, ok_count, detail, malformed) of the lines that begin with ``mark``; others are left out.

    A line is the mark, ``event=`` and every number in order, then a detail. One that is not is
    ``malformed``: it comes back as it is, its fields null. ``ok`` is told only by a detail
    with a single ok=true or ok=false.
    """
    line = F.col(col)
    form = "^" + mark + r" event=(\S+)" + "".join(rf" {n}=(-?\d+)" for n in PROFILE_NUMBERS) + r"(?: (.*))?$"
    good = line.rlike(form)
    part = lambda i: F.when(good, F.regexp_extract(line, form, i))
    said = F.regexp_extract_all(F.coalesce(part(10), F.lit("")), F.lit(r"(?<!\S)ok=(true|false)(?=\s|$)"), F.lit(1))
    return lines.where(line.startswith(mark)).select(
        part(1).alias("event"),
        *(part(i).cast("long").alias(n) for i, n in enumerate(PROFILE_NUMBERS, 2)),
        F.when(F.size(said) == 1, F.get(said, F.lit(0)) == "true").alias("ok"),
        F.when(good, F.size(said)).alias("ok_count"),
        F.nullif(part(10), F.lit("")).alias("detail"),
        F.when(~good, line).alias("malformed"),
    )


#: The least mean share of the baseline's coverage that a method has to keep; a fixed value.
LEAST_COVERAGE = 0.95


def gates(rows: DataFrame, expected: list[str]) -> DataFrame:
    """A row for each method of ``rows`` (method, id, new_size, old_size, new_covered, old_covered): its verdict.

    The samples of a method have to be exactly ``expected``, each once, and sizes positive;
    else the query fails, whatever the rest says. Coverage is the geometric mean of new to old,
    at most 1 each, over samples that the baseline covers at all; sizes pass by a strict
    majority of smaller ones.
    """
    wanted = rows.select("method").distinct().select("method", F.explode(F.array(*map(F.lit, expected)).cast("array<string>")).alias("id"), F.lit(1).alias("wanted"))
    both = rows.join(wanted, ["method", "id"], "full_outer")
    share = F.when(F.col("old_covered") > 0, F.least(F.lit(1.0), F.col("new_covered") / F.col("old_covered")))
    n, o = F.col("new_size"), F.col("old_size")
    out = both.groupBy("method").agg(
        F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.count_if(n.isNull()).alias("missing"), (F.count("id") - F.count_distinct("id")).alias("twice"), F.count_if((n <= 0) | (o <= 0)).alias("no_size"),
        F.count(share).alias("positive"), geometric_mean(share).alias("coverage"), F.count_if(n < o).alias("wins"), F.count_if(n == o).alias("ties"), F.count_if(n > o).alias("losses"),
        geometric_mean(F.greatest(F.lit(1.0), n / o)).alias("size"), F.min(share).alias("worst_coverage"), F.max(n / o).alias("worst_size"),
    )
    flaws = ["unexpected", "missing", "twice", "no_size"]
    broken = F.when(F.greatest(*flaws) > 0, F.to_json(F.struct("method", *flaws))).when(F.col("positive") == 0, F.concat("method", F.lit(": nothing is covered")))
    # raise_error sits in the value of a used column, so it can't be optimised away
    wins = F.when(broken.isNull(), F.col("wins")).otherwise(F.raise_error(F.concat(F.lit("not the fixed population: "), broken)).cast("long"))
    out = out.withColumn("wins", wins).withColumn("coverage_pass", F.col("coverage") >= LEAST_COVERAGE).withColumn("size_pass", F.col("wins") * 2 > F.col("wins") + F.col("ties") + F.col("losses"))
    return out.select("method", "positive", "coverage", "worst_coverage", "wins", "ties", "losses", "size", "worst_size", "coverage_pass", "size_pass")


def status_counts(records: DataFrame) -> DataFrame:
    """Records by status, with the total."""
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))


def unmapped(records: DataFrame, known: DataFrame, record_key: str, refs: str, known_key: str) -> DataFrame:
    """References of ``records`` (an array column) that ``known`` does not have."""
    each = records.select(record_key, F.explode(refs).alias("ref"))
    return each.join(known.select(F.col(known_key).alias("ref")).distinct(), "ref", "left_anti")
