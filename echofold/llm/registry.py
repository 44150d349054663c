"""The queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import permutation_neighbours

    v = _table(spark, sf_dir, "embeddings")
    return permutation_neighbours(v, v.where(F.col("vec_id") % 50 == 0))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_tree import token_digests

    return token_digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_permutation_index, op3_bpe)}
ORACLE_SQL: dict[str, str] = {}


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import mix_sources

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, with_text=False).select("doc_id", "source", "size", "source_size", "target", "taken")


QUERIES["op10_source_mix"] = op10_source_mix


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_digests

    return line_digests(_table(spark, sf_dir, "documents"))


QUERIES["op7_line_dedup"] = op7_line_dedup
ORACLE_SQL["op7_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.i), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.r, k.doc_id
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


QUERIES["op8_warc"] = op8_warc
ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
m AS (SELECT payload_digest, payload_bytes, max(page_id) AS most FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN most IS NOT NULL AND most <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN most <> page_id THEN most END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest AND p.payload_bytes = m.payload_bytes
"""


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


QUERIES["op9_sketch"] = op9_sketch


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_gam import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op4_quality_gam"] = op4_quality_gam


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


QUERIES["op2_order_minhash"] = op2_order_minhash


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_personal_data

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    key = spark.conf.get("spark.echofold.surrogates.key", "surrogates of this corpus")
    return replace_personal_data(docs, key=key, count_col="n_mentions")


QUERIES["op6_surrogates"] = op6_surrogates


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_labeller import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES |= {"op5_block_labeller": op5_block_labeller, "pipeline": pipeline}
