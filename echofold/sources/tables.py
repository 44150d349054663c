"""Tables as DataFrames, and payload columns as ``streams``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path Spark can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def streams(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(stream_id, payload, byte_len): one stream per row.

    Text is encoded as UTF-8, so every position downstream is a byte position. A null
    payload is the empty stream; rows with a null id are dropped, since a stream is named
    by its id. Python gets them in short batches, for this sets the session.
    """
    short_batches(df.sparkSession)
    payload: Column = F.col(payload_col)
    if df.schema[payload_col].dataType.typeName() == "string":
        payload = F.encode(payload, "UTF-8")
    return (
        df.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("bigint").alias("stream_id"), F.coalesce(payload, F.lit(b"")).alias("payload"))
        .withColumn("byte_len", F.octet_length("payload").cast("bigint"))
    )


def short_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most ``size`` bytes in this session, besides their number of rows: texts may be long.

    The setting is read when a query runs, after the call that made it has returned; so it
    stays set. A smaller one is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "1g"))
    if not 0 < now <= size:
        spark.conf.set(key, f"{size}b")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """One stream per file below ``path``; ids are a hash of the path, the SHA-256 is the identity."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select(
        F.xxhash64("path").alias("stream_id"),
        F.col("path"),
        F.col("content").alias("payload"),
        F.col("length").alias("byte_len"),
        F.sha2("content", 256).alias("sha256"),
    )
