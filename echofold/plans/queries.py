"""Queries over the given tables, and the SQL that gives the same rows.

All run over whole tables and whole texts. What SQL can't express, or not in reasonable time
over whole texts, has no SQL here and is tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import engine
from ..functions.config import MatchConfig, Overlay
from ..operators import archives, candidates, documents, evaluate, layouts, scans, select
from ..sources import streams, table
from ..sources.manifests import json_status

SEED, BLOCK = 64, 1024
#: Parameters by method that fit documents of a few KB.
CONFIGS = {
    "m0": MatchConfig("m0", min_match=64),
    "m1": MatchConfig("m1", target_chunk=128, block_size=65536),
    "m2": MatchConfig("m2", target_chunk=128, block_size=65536),
    "m3": MatchConfig("m3", min_match=64, seed_size=32),
    "m4": MatchConfig("m4", min_match=64, seed_size=32),
    "m5": MatchConfig("m5", min_match=64),
    "m4+overlay": MatchConfig("m4", min_match=128, seed_size=64, overlay=Overlay(64, 1 << 20)),
}
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams(table(spark, sf_dir, "documents"), "doc_id", "text")


def aligned_matches(s: DataFrame) -> DataFrame:
    """Matches of each stream's aligned seeds with the first equal one: free of overlaps as they are."""
    seeds = scans.grid_seeds(s, SEED).select("stream_id", "position", F.col("bytes").alias("key"))
    by = Window.partitionBy("stream_id", "key")
    rows = seeds.withColumn("src", F.min("position").over(by)).where("src < position")
    order = Window.partitionBy("stream_id").orderBy("position")
    return rows.select("stream_id", (F.row_number().over(order) - 1).cast("long").alias("origin_match_id"), "src", F.col("position").alias("dst"), F.lit(SEED).cast("long").alias("len"))


def aligned_runs(s: DataFrame) -> DataFrame:
    """Candidates of whole seeds: at each distance, runs of aligned seeds that equal those before.

    Every pair of a stream's equal aligned seeds lies on a distance; pairs that follow each
    other there are one run (gaps and islands).
    """
    seeds = scans.grid_seeds(s, SEED).select("stream_id", "position", F.col("bytes").alias("key"))
    a, b = seeds.select("stream_id", "key", F.col("position").alias("src")), seeds.select("stream_id", "key", F.col("position").alias("dst"))
    pairs = a.join(b, ["stream_id", "key"]).where("src < dst").select("stream_id", (F.col("dst") - F.col("src")).alias("distance"), "src")
    by = Window.partitionBy("stream_id", "distance").orderBy("src")
    run = F.col("src") - SEED * F.row_number().over(by)
    return pairs.withColumn("run", run).groupBy("stream_id", "distance", "run").agg(F.min("src").alias("src"), (F.count(F.lit(1)) * SEED).alias("len")).select("stream_id", "src", (F.col("src") + F.col("distance")).alias("dst"), "len")


# The same in SQL.
_SEEDS = f"""
s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS byte_len FROM documents WHERE doc_id IS NOT NULL),
seeds AS (SELECT stream_id, p * {SEED} AS position, substr(h, p * {2 * SEED} + 1, {2 * SEED}) AS key FROM (SELECT *, unnest(range(byte_len // {SEED})) AS p FROM s))"""
_ALIGNED = _SEEDS + f""",
firsts AS (SELECT stream_id, position, min(position) OVER (PARTITION BY stream_id, key) AS src FROM seeds),
m AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY position) - 1 AS origin_match_id, src, position AS dst, {SEED} AS len FROM firsts WHERE src < position)"""
_RUNS = _SEEDS + f""",
pairs AS (SELECT a.stream_id, b.position - a.position AS distance, a.position AS src FROM seeds a JOIN seeds b ON a.stream_id = b.stream_id AND a.key = b.key AND a.position < b.position),
numbered AS (SELECT *, src - {SEED} * row_number() OVER (PARTITION BY stream_id, distance ORDER BY src) AS run FROM pairs),
c AS (SELECT stream_id, min(src) AS src, min(src) + distance AS dst, count(*) * {SEED} AS len FROM numbered GROUP BY stream_id, distance, run)"""
_LITERALS = _ALIGNED + f""",
marks AS (SELECT stream_id, dst, dst + len AS upto FROM m UNION ALL SELECT stream_id, byte_len, byte_len FROM s),
gaps AS (SELECT stream_id, coalesce(lag(upto) OVER (PARTITION BY stream_id ORDER BY dst, upto), 0) AS a, dst AS b FROM marks),
lit AS (SELECT stream_id, block_id, greatest(a, block_id * {BLOCK}) AS start, least(b, (block_id + 1) * {BLOCK}) - greatest(a, block_id * {BLOCK}) AS len
        FROM (SELECT *, unnest(range(a // {BLOCK}, (b - 1) // {BLOCK} + 1)) AS block_id FROM gaps WHERE a < b))"""
# Runs of bytes that equal those a distance behind, for each distance of a seed and its like.
_RUNS_OF_BYTES = lambda seed: f"""
s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS byte_len FROM documents WHERE doc_id IS NOT NULL),
cut AS MATERIALIZED (SELECT stream_id, k, substr(h, 128 * k + 1, 128) AS piece FROM (SELECT *, unnest(range((byte_len + 63) // 64)) AS k FROM s)),
wide AS MATERIALIZED (SELECT stream_id, k, piece || coalesce(lead(piece) OVER (PARTITION BY stream_id ORDER BY k), '') AS wide FROM cut),
bytes AS MATERIALIZED (SELECT stream_id, 64 * k + j AS p, substr(piece, 2 * j + 1, 2) AS byte FROM (SELECT *, unnest(range(length(piece) // 2)) AS j FROM cut)),
windows AS (SELECT stream_id, 64 * k + j AS position, substr(wide, 2 * j + 1, {2 * seed}) AS key FROM (SELECT *, unnest(range(64)) AS j FROM wide) WHERE length(wide) >= 2 * j + {2 * seed}),
behind AS MATERIALIZED (SELECT DISTINCT stream_id, b.position - a.position AS distance FROM windows a JOIN windows b USING (stream_id, key) WHERE a.position % {seed} = 0 AND a.position < b.position),
equal AS (SELECT a.stream_id, distance, a.p FROM behind JOIN bytes a USING (stream_id) JOIN bytes b ON b.stream_id = a.stream_id AND b.p = a.p + distance AND b.byte = a.byte),
runs AS MATERIALIZED (SELECT stream_id, distance, min(p) AS src, count(*) AS len FROM (SELECT *, p - row_number() OVER (PARTITION BY stream_id, distance ORDER BY p) AS run FROM equal) GROUP BY stream_id, distance, run HAVING count(*) >= {seed})"""  # noqa: E731
_WHOLE_RUNS = "SELECT stream_id, src, src + distance AS dst, len FROM runs WHERE len >= 64"
_WHOLE_SEEDS = "SELECT stream_id, p AS src, p + distance AS dst, (src + len - p) // 32 * 32 AS len FROM (SELECT *, unnest(range((src + 31) // 32 * 32, src + len, 32)) AS p FROM runs) WHERE (src + len - p) // 32 * 32 >= 64"
# The best set of intervals: from the last to the first, each is taken if it is worth as much as going without it.
_BEST = lambda found: f"""
r AS (SELECT stream_id, dst, len, min(src) AS src FROM ({found}) WHERE len > 25 GROUP BY stream_id, dst, len),
o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY dst, src, len DESC) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM r),
a AS MATERIALIZED (SELECT x.stream_id, x.i, any_value(x.n) AS n, any_value(x.src) AS src, any_value(x.dst) AS dst, any_value(x.len) AS len, 1 + count(y.i) AS after
      FROM o x LEFT JOIN o y ON x.stream_id = y.stream_id AND y.dst < x.dst + x.len GROUP BY x.stream_id, x.i),
dp AS (SELECT DISTINCT stream_id, n + 1 AS i, [0::BIGINT] AS gain, [0::BIGINT] AS covered, [0::BIGINT] AS few, []::BOOLEAN[] AS take FROM a
  UNION ALL
  SELECT stream_id, i, list_prepend(CASE WHEN t THEN g ELSE gain[1] END, gain), list_prepend(CASE WHEN t THEN c ELSE covered[1] END, covered), list_prepend(CASE WHEN t THEN f ELSE few[1] END, few), list_prepend(t, take)
  FROM (SELECT *, (g, c, f) >= (gain[1], covered[1], few[1]) AS t FROM (
    SELECT a.stream_id, a.i, gain, covered, few, take, gain[after - dp.i + 1] + len - 25 AS g, covered[after - dp.i + 1] + len AS c, few[after - dp.i + 1] - 1 AS f FROM dp JOIN a ON a.stream_id = dp.stream_id AND a.i = dp.i - 1))),
walk AS (SELECT stream_id, 1::BIGINT AS i, take FROM dp WHERE i = 1
  UNION ALL
  SELECT w.stream_id, CASE WHEN w.take[w.i] THEN a.after ELSE w.i + 1 END, w.take FROM walk w JOIN a ON a.stream_id = w.stream_id AND a.i = w.i),
m AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY i) - 1 AS origin_match_id, src, dst, CAST(len AS BIGINT) AS len FROM walk JOIN a USING (stream_id, i) WHERE take[i])"""  # noqa: E731
_VAR = lambda v: f"greatest(1, (length(bin({v})) + 6) // 7)"


# -- sources and scans -----------------------------------------------------------------------


@query("SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, ''))) AS byte_len, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents WHERE doc_id IS NOT NULL")
def stream_identity(spark, sf_dir):
    return docs(spark, sf_dir).select("stream_id", "byte_len", F.sha2("payload", 256).alias("sha256"))


@query(
    f"""WITH s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT *, unnest(range((n + {BLOCK - 1}) // {BLOCK})) AS block_id FROM s)
SELECT stream_id, block_id, block_id * {BLOCK} AS start, least({BLOCK}, n - block_id * {BLOCK}) AS len, sha256(unhex(substr(h, block_id * {2 * BLOCK} + 1, {2 * BLOCK}))) AS sha256 FROM b"""
)
def block_partition(spark, sf_dir):
    return scans.blocks(docs(spark, sf_dir), BLOCK).select("stream_id", "block_id", "start", "len", F.sha2("bytes", 256).alias("sha256"))


@query(
    f"""WITH RECURSIVE s AS (SELECT doc_id AS stream_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT stream_id, block_id, substr(h, block_id * {2 * BLOCK} + 1, {2 * BLOCK}) AS h, least({BLOCK}, n - block_id * {BLOCK}) AS len FROM (SELECT *, unnest(range((n + {BLOCK - 1}) // {BLOCK})) AS block_id FROM s)),
e AS (SELECT stream_id, block_id, len, len - 1 - j AS k, CAST('0x' || substr(h, 2 * j + 1, 2) AS BIGINT) AS byte FROM (SELECT *, unnest(range(len)) AS j FROM b)),
one AS MATERIALIZED (SELECT i AS byte, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
t AS (SELECT 0 AS k, byte, v FROM one UNION ALL SELECT k + 1, t.byte, xor(t.v >> 8, one.v) FROM t JOIN one ON one.byte = t.v & 255 WHERE k < {BLOCK}),
z AS (SELECT 0 AS len, 4294967295 AS v UNION ALL SELECT len + 1, xor(z.v >> 8, one.v) FROM z JOIN one ON one.byte = z.v & 255 WHERE len < {BLOCK}),
x AS (SELECT stream_id, block_id, len, bit_xor(t.v) AS v FROM e JOIN t USING (k, byte) GROUP BY stream_id, block_id, len)
SELECT stream_id, block_id, xor(xor(x.v, z.v), 4294967295) AS crc32c FROM x JOIN z USING (len)"""
)
def block_crc32c(spark, sf_dir):
    return scans.block_digests(docs(spark, sf_dir), BLOCK).select("stream_id", "block_id", "crc32c")


@query(f"WITH {_SEEDS} SELECT stream_id, position, md5(unhex(key)) AS key FROM seeds")
def grid_seeds(spark, sf_dir):
    return scans.grid_seeds(docs(spark, sf_dir), SEED).drop("bytes")


@query()
def region_representatives(spark, sf_dir):
    return scans.region_representatives(docs(spark, sf_dir), 32)


@query()
def rolling_chunks_m1(spark, sf_dir):
    return scans.cdc_chunks(docs(spark, sf_dir), CONFIGS["m1"])


@query()
def order1_chunks_m2(spark, sf_dir):
    return scans.cdc_chunks(docs(spark, sf_dir), CONFIGS["m2"])


@query(
    """WITH s AS (SELECT doc_id AS stream_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE doc_id IS NOT NULL AND text <> ''),
b AS (SELECT stream_id, n, substr(h, 2 * i + 1, 2) AS byte FROM (SELECT *, unnest(range(n)) AS i FROM s)),
c AS (SELECT stream_id, n, byte, count(*) AS k FROM b GROUP BY ALL)
SELECT stream_id, n AS byte_len, count(*) AS distinct_bytes, round(max(k / n), 6) AS top_share, round(-sum(k / n * log2(k / n)), 6) + 0 AS entropy FROM c GROUP BY stream_id, n"""
)
def byte_statistics(spark, sf_dir):
    out = scans.byte_statistics(docs(spark, sf_dir))
    return out.select("stream_id", "byte_len", "distinct_bytes", F.round("top_share", 6).alias("top_share"), (F.round("entropy", 6) + 0).alias("entropy"))


# -- candidates and selection ----------------------------------------------------------------


@query(
    f"""WITH {_SEEDS}, f AS (SELECT key, min((stream_id, position)) AS first FROM seeds GROUP BY key)
SELECT d.lang, count(*) AS repeated_seeds, count(*) * {SEED} AS covered_bytes FROM seeds JOIN f USING (key) JOIN documents d ON d.doc_id = stream_id
WHERE (stream_id, position) <> first GROUP BY d.lang"""
)
def grid_seed_dedup(spark, sf_dir):
    """Bytes of each language that an earlier aligned seed of any document has."""
    found = candidates.corpus_seed_matches(docs(spark, sf_dir), SEED)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), "lang")
    return found.join(langs, "stream_id").groupBy("lang").agg(F.count(F.lit(1)).alias("repeated_seeds"), F.sum("len").alias("covered_bytes"))


@query(f"WITH {_RUNS} SELECT * FROM c")
def aligned_run_candidates(spark, sf_dir):
    return aligned_runs(docs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT stream_id, dst, len, min(src) AS src FROM c WHERE len > 25 GROUP BY stream_id, dst, len")
def interval_representatives(spark, sf_dir):
    return select.representatives(select.gain_filter(aligned_runs(docs(spark, sf_dir))))


@query(
    f"""WITH {_RUNS}, r AS (SELECT stream_id, dst, len, min(src) AS src FROM c WHERE len > 25 GROUP BY stream_id, dst, len),
w AS (SELECT *, max(dst + len) OVER (PARTITION BY stream_id ORDER BY dst, len, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR dst >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY dst, len, src ROWS UNBOUNDED PRECEDING) AS island FROM w)
SELECT stream_id, CAST(island AS BIGINT) AS island, count(*) AS intervals, min(dst) AS start, max(dst + len) AS end_ FROM i GROUP BY stream_id, island"""
)
def overlap_islands(spark, sf_dir):
    r = select.representatives(select.gain_filter(aligned_runs(docs(spark, sf_dir))))
    return select.islands(r).groupBy("stream_id", "island").agg(F.count(F.lit(1)).alias("intervals"), F.min("dst").alias("start"), F.max(F.col("dst") + F.col("len")).alias("end_"))


@query(f"WITH RECURSIVE {_RUNS}, {_BEST('SELECT * FROM c')} SELECT * FROM m")
def best_intervals(spark, sf_dir):
    """The choice among candidates of whole aligned seeds."""
    return select.best_intervals(select.representatives(select.gain_filter(aligned_runs(docs(spark, sf_dir)))))


@query(
    f"""WITH {_RUNS}, r AS (SELECT DISTINCT stream_id, dst, len FROM c WHERE len > 25),
e AS (SELECT stream_id, dst, dst + len AS upto FROM r)
SELECT stream_id, count(*) AS candidates, max(upto - dst) AS longest FROM e GROUP BY stream_id"""
)
def candidate_summary(spark, sf_dir):
    c = select.gain_filter(aligned_runs(docs(spark, sf_dir))).dropDuplicates(["stream_id", "dst", "len"])
    return c.groupBy("stream_id").agg(F.count(F.lit(1)).alias("candidates"), F.max("len").alias("longest"))


@query()
def candidate_events(spark, sf_dir):
    """Raw events and distinct candidates of the finders of each method."""
    return candidates.metrics_of_methods(docs(spark, sf_dir), {name: cfg for name, cfg in CONFIGS.items() if "+" not in name})


@query()
def chunk_pairs_m1(spark, sf_dir):
    return candidates.chunk_pairs(scans.cdc_chunks(docs(spark, sf_dir), CONFIGS["m1"]), CONFIGS["m1"])


@query()
def corpus_chunk_dedup(spark, sf_dir):
    """Bytes of each source that chunks of earlier documents have."""
    found = candidates.corpus_chunk_matches(docs(spark, sf_dir), CONFIGS["m1"])
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id"), "source")
    return found.join(sources, "stream_id").groupBy("source").agg(F.count(F.lit(1)).alias("repeated_chunks"), F.sum("len").alias("covered_bytes"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Finders whose candidates SQL can tell: whole seeds of runs of equal bytes, or those runs.
_FOUND_BY_SQL = {"m3": (32, _WHOLE_SEEDS), "m4": (32, _WHOLE_RUNS), "m5": (CONFIGS["m5"].seed, _WHOLE_RUNS)}


def _matches_query(name: str):
    def run(spark, sf_dir):
        return engine.find_matches(docs(spark, sf_dir), CONFIGS[name])

    run.__name__ = "matches_" + name.replace("+", "_")
    seed, found = _FOUND_BY_SQL.get(name, (0, ""))
    query(f"WITH RECURSIVE {_RUNS_OF_BYTES(seed)}, {_BEST(found)} SELECT * FROM m" if seed else None)(run)


for _name in CONFIGS:
    _matches_query(_name)


@query(
    f"""WITH RECURSIVE {_RUNS_OF_BYTES(32)}, {_BEST(_WHOLE_RUNS)},
i AS (SELECT stream_id, count(*) AS n, sum({_VAR("gap")} + {_VAR("dst - src")} + {_VAR("len")}) AS b, sum(len) AS covered FROM (SELECT *, dst - coalesce(lag(dst + len) OVER (PARTITION BY stream_id ORDER BY dst), 0) AS gap FROM m) GROUP BY stream_id),
t AS (SELECT stream_id, byte_len, coalesce(n, 0) AS n, coalesce(b, 0) AS b, coalesce(covered, 0) AS covered FROM s LEFT JOIN i USING (stream_id))
SELECT stream_id, byte_len AS original_size, n AS semantic_match_count, CAST(covered AS BIGINT) AS covered_bytes, CAST(byte_len - covered AS BIGINT) AS literal_bytes,
       CAST(156 + byte_len - covered + 4 * ((byte_len + 8388607) // 8388608) + {_VAR("n")} + b AS BIGINT) AS archive_size, 'm4' AS method, 'index' AS layout, 'xxh3' AS checksum FROM t"""
)
def method_stats(spark, sf_dir):
    """The flagship: coverage and container size of each document by m4."""
    return engine.statistics(docs(spark, sf_dir), CONFIGS["m4"])


@query()
def method_comparison(spark, sf_dir):
    """Each method's container sizes against those of m4: wins, ties, losses and the mean share covered.

    Every method is run once, where the stream is.
    """
    rows = evaluate.sizes_of_methods(docs(spark, sf_dir).where("byte_len > 0"), CONFIGS, "m4")
    n, o = F.col("archive_size"), F.col("base_size")
    share = (F.col("covered_bytes") + 1) / (F.col("original_size") + 1)
    out = rows.groupBy("kind").agg(F.count_if(n < o).alias("wins"), F.count_if(n == o).alias("ties"), F.count_if(n > o).alias("losses"), F.round(evaluate.geometric_mean(share), 9).alias("coverage_mean"))
    return out.withColumn("majority", F.col("wins") * 2 > F.col("wins") + F.col("ties") + F.col("losses"))


# -- layouts and containers ------------------------------------------------------------------


@query(f"WITH {_ALIGNED}, t AS (SELECT stream_id, count(*) AS n, sum(len) AS covered FROM m GROUP BY stream_id) SELECT stream_id, byte_len AS original_size, coalesce(n, 0) AS semantic_match_count, CAST(coalesce(covered, 0) AS BIGINT) AS covered_bytes, CAST(byte_len - coalesce(covered, 0) AS BIGINT) AS literal_bytes FROM s LEFT JOIN t USING (stream_id)")
def stats_summary(spark, sf_dir):
    s = docs(spark, sf_dir)
    return select.coverage(aligned_matches(s), s)


@query(f"WITH {_LITERALS} SELECT stream_id, block_id, start, len FROM lit")
def literal_ranges(spark, sf_dir):
    s = docs(spark, sf_dir)
    return layouts.literal_ranges(aligned_matches(s), s, BLOCK)


@query(f"WITH {_ALIGNED} SELECT stream_id, origin_match_id, dst - coalesce(lag(dst + len) OVER (PARTITION BY stream_id ORDER BY dst), 0) AS dst_gap, dst - src AS distance, CAST(len AS BIGINT) AS total_len FROM m")
def index_layout(spark, sf_dir):
    return layouts.index_table(aligned_matches(docs(spark, sf_dir)))


@query(f"WITH {_ALIGNED} SELECT stream_id, origin_match_id, src, dst, CAST(len AS BIGINT) AS len FROM m")
def index_layout_inverse(spark, sf_dir):
    return layouts.from_index_table(layouts.index_table(aligned_matches(docs(spark, sf_dir))))


@query(f"WITH {_ALIGNED} SELECT stream_id, src // {BLOCK} AS block_id, row_number() OVER (PARTITION BY stream_id, src // {BLOCK} ORDER BY src, dst, len DESC) - 1 AS register_id, src % {BLOCK} AS source_offset, dst - src AS distance, CAST(len AS BIGINT) AS total_len FROM m")
def future_layout(spark, sf_dir):
    return layouts.future_registers(aligned_matches(docs(spark, sf_dir)), BLOCK)


@query(
    f"""WITH {_LITERALS}, o AS (SELECT stream_id, block_id, 'literal' AS op, start AS pos, len, NULL::BIGINT AS distance FROM lit UNION ALL SELECT stream_id, dst // {BLOCK}, 'match', dst, len, dst - src FROM m)
SELECT stream_id, block_id, row_number() OVER (PARTITION BY stream_id, block_id ORDER BY pos) - 1 AS op_id, op, pos, len, distance FROM o"""
)
def io_layout(spark, sf_dir):
    s = docs(spark, sf_dir)
    return layouts.io_operations(aligned_matches(s), s, BLOCK)


@query(
    f"""WITH {_ALIGNED}, x AS (SELECT *, unnest(range(dst // {BLOCK}, (dst + len - 1) // {BLOCK} + 1)) AS block_id FROM m)
SELECT stream_id, origin_match_id, block_id, greatest(dst, block_id * {BLOCK}) AS start, least(dst + len, (block_id + 1) * {BLOCK}) - greatest(dst, block_id * {BLOCK}) AS len, greatest(dst, block_id * {BLOCK}) = dst AS is_first FROM x"""
)
def block_overlaps(spark, sf_dir):
    return layouts.block_overlaps(aligned_matches(docs(spark, sf_dir)), BLOCK)


@query(
    f"""WITH {_LITERALS},
i AS (SELECT stream_id, count(*) AS n, sum({_VAR("gap")} + {_VAR("dst - src")} + {_VAR("len")}) AS b, sum(len) AS covered FROM (SELECT *, dst - coalesce(lag(dst + len) OVER (PARTITION BY stream_id ORDER BY dst), 0) AS gap FROM m) GROUP BY stream_id),
r AS (SELECT stream_id, sum(b + {_VAR("n")} - 1) AS b FROM (SELECT stream_id, src // {BLOCK} AS block_id, count(*) AS n, sum({_VAR(f"src % {BLOCK}")} + {_VAR("dst - src")} + {_VAR("len")}) AS b FROM m GROUP BY 1, 2) GROUP BY stream_id),
o AS (SELECT stream_id, sum(b) AS b FROM (SELECT stream_id, 1 + {_VAR("len")} AS b FROM lit UNION ALL SELECT stream_id, 1 + {_VAR("dst - src")} + {_VAR("len")} FROM m) GROUP BY stream_id),
t AS (SELECT s.stream_id, 156 + byte_len - coalesce(covered, 0) + 4 * ((byte_len + {BLOCK - 1}) // {BLOCK}) AS base, (byte_len + {BLOCK - 1}) // {BLOCK} AS blocks, coalesce(n, 0) AS n, coalesce(i.b, 0) AS ib, coalesce(r.b, 0) AS rb, coalesce(o.b, 0) AS ob
      FROM s LEFT JOIN i USING (stream_id) LEFT JOIN r USING (stream_id) LEFT JOIN o USING (stream_id))
SELECT stream_id, 'index' AS layout, CAST(base + {_VAR("n")} + ib AS BIGINT) AS encoded_size FROM t
UNION ALL SELECT stream_id, 'future', CAST(base + blocks + rb AS BIGINT) FROM t
UNION ALL SELECT stream_id, 'io', CAST(base + ob AS BIGINT) FROM t"""
)
def encoded_sizes(spark, sf_dir):
    s = docs(spark, sf_dir)
    return layouts.encoded_sizes(aligned_matches(s), s, MatchConfig("m4", min_match=64, seed_size=SEED, block_size=BLOCK))


def _round_trip(layout: str):
    def run(spark, sf_dir):
        s = docs(spark, sf_dir)
        cfg = MatchConfig("m4", layout=layout, min_match=64, seed_size=32, block_size=BLOCK)
        return archives.read_archives(engine.compress(s, cfg)).select("stream_id", "byte_len", F.md5("payload").alias("md5"), "status")

    run.__name__ = f"round_trip_{layout}"
    query("SELECT doc_id AS stream_id, octet_length(encode(coalesce(text, ''))) AS byte_len, md5(encode(coalesce(text, ''))) AS md5, 'ok' AS status FROM documents WHERE doc_id IS NOT NULL")(run)


for _layout in ("index", "future", "io"):
    _round_trip(_layout)


_PLAIN = MatchConfig("m4", min_match=64, seed_size=SEED, block_size=BLOCK)


@query(
    f"""WITH {_ALIGNED},
i AS (SELECT stream_id, count(*) AS n, sum({_VAR("gap")} + {_VAR("dst - src")} + {_VAR("len")}) AS b, sum(len) AS covered FROM (SELECT *, dst - coalesce(lag(dst + len) OVER (PARTITION BY stream_id ORDER BY dst), 0) AS gap FROM m) GROUP BY stream_id),
t AS (SELECT stream_id, byte_len, (byte_len + {BLOCK - 1}) // {BLOCK} AS blocks, coalesce(n, 0) AS n, coalesce(b, 0) AS b, CAST(coalesce(covered, 0) AS BIGINT) AS covered FROM s LEFT JOIN i USING (stream_id))
SELECT stream_id, 'own' AS format, 'ok' AS status, CAST(156 + byte_len - covered + 4 * blocks + {_VAR("n")} + b AS BIGINT) AS archive_size, 'm4' AS method, 'index' AS layout, 'xxh3' AS checksum, {BLOCK}::BIGINT AS block_size, 64::BIGINT AS min_match,
       byte_len AS original_size, blocks AS block_count, n AS semantic_match_count, covered AS covered_bytes, byte_len - covered AS literal_bytes, CAST({_VAR("n")} + b AS BIGINT) AS index_size, byte_len - covered + 4 * blocks AS payload_size FROM t"""
)
def inspect_archives(spark, sf_dir):
    s = docs(spark, sf_dir)
    return archives.inspect_archives(archives.write_archives(aligned_matches(s), s, _PLAIN))


@query("SELECT doc_id AS stream_id, 'own' AS whole, 'truncated' AS short, 'corrupt' AS other FROM documents WHERE doc_id IS NOT NULL")
def sniff_written(spark, sf_dir):
    """What the first bytes tell of containers: whole, cut within their mark, and with another first byte."""
    s = docs(spark, sf_dir)
    out = archives.write_archives(aligned_matches(s), s, _PLAIN)
    for name, payload in {"whole": F.col("archive"), "short": F.substring("archive", 1, 5), "other": F.concat(F.unhex(F.lit("00")), F.expr("substring(archive, 2)"))}.items():
        out = archives.sniff_formats(out.withColumn("head", payload), "head").withColumnRenamed("format", name)
    return out.select("stream_id", "whole", "short", "other")


@query("SELECT page_id, CASE WHEN octet_length(encode(coalesce(html, ''))) < 8 THEN CASE WHEN coalesce(html, '') = '' THEN 'truncated' ELSE 'corrupt' END ELSE 'corrupt' END AS format FROM pages")
def container_sniff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    return archives.sniff_formats(pages, "payload").select("page_id", "format")


@query(
    """WITH h AS (SELECT o_orderkey, o_orderkey % 6 AS version, (o_orderkey // 6) % 7 AS id, o_custkey % 5 * 65537 AS base_len, o_orderkey % 11 AS missing FROM orders),
c AS (SELECT *, CASE id WHEN 4 THEN 32 WHEN 5 THEN 16 ELSE 0 END AS seed_len FROM h),
x AS (SELECT *, CASE WHEN missing = 0 THEN 'TruncatedArchive' WHEN version NOT IN (1, 2, 3, 4) THEN 'UnsupportedVersion' WHEN id = 6 THEN 'UnknownChecksum' WHEN version <= 2 AND base_len = 0 THEN 'CorruptHeader'
             WHEN missing = 1 AND seed_len > 0 THEN 'TruncatedArchive' ELSE 'ok' END AS status FROM c)
SELECT o_orderkey, status, CASE WHEN status = 'ok' THEN CAST(version AS INTEGER) END AS version, CASE WHEN status = 'ok' THEN ['md5', 'none', 'sha1', 'sha512', 'vhash', 'siphash'][id + 1] END AS checksum,
       CASE WHEN status = 'ok' THEN ['io-rounded', 'io', 'future', 'index'][version] END AS layout, CASE WHEN status = 'ok' THEN base_len END AS base_len, CASE WHEN status = 'ok' THEN 16 + seed_len END AS header_end FROM x"""
)
def retired_headers(spark, sf_dir):
    """Headers of every version and checksum, made from order keys: some cut short, some of no known kind."""
    n = lambda e: F.expr(f"CAST({e} AS INT)")
    seed_len = F.expr("CASE (o_orderkey div 6) % 7 WHEN 4 THEN 32 WHEN 5 THEN 16 ELSE 0 END")
    width = F.expr("CASE (o_orderkey div 6) % 7 WHEN 2 THEN 4 WHEN 3 THEN 48 WHEN 5 THEN 248 ELSE 0 END")
    byte = lambda v: F.unhex(F.lpad(F.hex(v), 2, "0"))
    base = n("o_custkey % 5 * 65537")
    little = F.concat(*(byte(F.shiftrightunsigned(base, 8 * i).bitwiseAND(255)) for i in range(4)))
    whole = F.concat(F.lit(b"RETIRED!"), byte(n("o_orderkey % 6")), byte(n("(o_orderkey div 6) % 7")), byte(seed_len), byte(width), little, F.encode(F.repeat(F.lit("s"), seed_len), "UTF-8"))
    cut = F.expr("CASE o_orderkey % 11 WHEN 0 THEN 15 WHEN 1 THEN 17 ELSE 99 END")
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.substring(whole, F.lit(1), cut).alias("head"))
    return archives.retired_headers(made, "head", b"RETIRED!").select("o_orderkey", "status", "version", "checksum", "layout", "base_len", "header_end")


# -- evaluation ------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, CAST(sum(TRY_CAST(nullif(regexp_extract(props, '\"k\": *([0-9]+)', 1), '') AS BIGINT)) AS BIGINT) AS total_k, count(*) FILTER (nullif(regexp_extract(props, '\"k\": *([0-9]+)', 1), '') IS NULL) AS unparsed FROM events GROUP BY event_type")
def log_field_parse(spark, sf_dir):
    k = F.expr("""try_cast(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS BIGINT)""")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total_k"), F.count_if(F.col("k").isNull()).alias("unparsed"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS strict FROM events GROUP BY event_type")
def strict_json_props(spark, sf_dir):
    """Properties that are JSON without any leniency."""
    rows = json_status(table(spark, sf_dir, "events"), "props")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("json_status") == "ok").alias("strict"))


@query("SELECT lang, round(exp(avg(ln(octet_length(encode(text))))), 6) AS mean_bytes, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang")
def geometric_mean_bytes(spark, sf_dir):
    t = table(spark, sf_dir, "documents").where("text <> ''")
    return t.groupBy("lang").agg(F.round(evaluate.geometric_mean(F.octet_length("text")), 6).alias("mean_bytes"), F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT source, lang, sum(octet_length(encode(coalesce(text, '')))) AS size FROM documents GROUP BY ALL),
b AS (SELECT source, lang, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY ALL)
SELECT lang, count(*) FILTER (a.size < b.size) AS wins, count(*) FILTER (a.size = b.size) AS ties, count(*) FILTER (a.size > b.size) AS losses, count(*) FILTER (a.size < b.size) * 2 > count(*) AS majority
FROM a JOIN b USING (source, lang) GROUP BY lang"""
)
def size_majority(spark, sf_dir):
    t = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    size = lambda f: t.groupBy("source", "lang").agg(F.sum(f).alias("size"))
    out = evaluate.compare_sizes(size(F.octet_length("text")), size(F.char_length("text")), ["source", "lang"], ["lang"], "size")
    return out.select("lang", "wins", "ties", "losses", "majority")


@query(
    """WITH a AS (SELECT role, text FROM conversations WHERE turn % 2 = 0), b AS (SELECT role, text FROM conversations WHERE turn % 2 = 1)
SELECT 'left' AS side, role, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY role
UNION ALL SELECT 'right', role, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY role"""
)
def population_difference(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    part = lambda k: c.where(F.col("turn") % 2 == k).select("role", "text")
    return evaluate.population_difference(part(0), part(1)).groupBy("side", "role").agg(F.count(F.lit(1)).alias("n"))


@query()
def document_units(spark, sf_dir):
    return documents.document_units(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit_id").alias("distinct_units"))


@query()
def incremental_chunks(spark, sf_dir):
    """Documents as a stream: the first chunk of each key, counted."""
    import shutil
    import tempfile
    import uuid

    from ..streaming.incremental import run_to_table, text_stream

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    root = f"{base.rstrip('/')}/incremental-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="echofold-stream-")
    schema = table(spark, sf_dir, "documents").schema
    out = run_to_table(spark, text_stream(spark, f"{sf_dir.rstrip('/')}/documents.parquet", schema), CONFIGS["m1"], f"{root}/out", f"{root}/state")
    counted = out.agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.col("end") - F.col("start")).alias("bytes")).first()
    if not base:
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)
    return spark.createDataFrame([(counted["chunks"], counted["bytes"])], "chunks long, bytes long")
