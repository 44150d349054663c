"""Chunk dedup of documents as they arrive.

Each micro-batch is chunked; chunks are kept or dropped against state keyed by digest. The
state is one row per key, held by Spark's state store: a chunk is new if its key has not been
seen, in this batch or before. Late or repeated documents change nothing that was emitted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import MatchConfig
from ..functions.kernels import chunks
from ..operators.scans import cdc_chunks
from ..sources import streams


def text_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    """The Parquet files of the folder ``path``, or that one file, as they arrive."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def new_chunks(docs: DataFrame, cfg: MatchConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(stream_id, start, end, key) of the first chunk of each key in a stream of documents; also for static input."""
    return cdc_chunks(streams(docs, id_col, text_col), cfg).select("stream_id", "start", "end", "key").dropDuplicates(["key"])


def recent_chunks(docs: DataFrame, cfg: MatchConfig, ts_col: str, history: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ts, stream_id, start, end, key) of chunks whose key was not seen within ``history`` before.

    State is bounded: a key is forgotten once the watermark has passed it by ``history``, so
    it may be new again later, as with a finder that looks back a limited distance.
    """
    rows = docs.select(F.col(ts_col).alias("ts"), F.col(id_col).cast("long").alias("stream_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("payload"))
    cut = chunk_lists(rows.where("stream_id IS NOT NULL").withWatermark("ts", history), cfg)
    return cut.select("ts", "stream_id", F.inline("chunks")).dropDuplicatesWithinWatermark(["key"])


def chunk_lists(rows: DataFrame, cfg: MatchConfig) -> DataFrame:
    """(ts, stream_id, chunks): an array of (start, end, key) for each row of (ts, stream_id, payload)."""

    @F.pandas_udf("array<struct<start:long,end:long,bytes:binary>>")
    def cut(payloads: pd.Series) -> pd.Series:
        return pd.Series([[(a, e, p[a:e]) for _, a, e in chunks(p, cfg)] for p in payloads])

    keyed = F.transform(cut("payload"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.md5(c["bytes"]).alias("key")))
    return rows.select("ts", "stream_id", keyed.alias("chunks"))


def run_to_table(spark: SparkSession, docs: DataFrame, cfg: MatchConfig, out: str, checkpoint: str) -> DataFrame:
    """Runs over all that is there now and stops; a restart goes on from ``checkpoint``. Returns what ``out`` holds."""
    query = new_chunks(docs, cfg).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def arrival_violations(events: DataFrame, key: str, position: str, window: str = "10 minutes") -> DataFrame:
    """(window, key, n, rejected, disordered) by window of ``ts``: what an order-keeping index would reject.

    Rejected are null positions; disordered those that are not above every earlier one of
    their window and key, earlier by ``ts``, ties by position. Late rows beyond the watermark
    are left out.
    """
    rows = events.withWatermark("ts", window).groupBy(F.window("ts", window), key).agg(F.sort_array(F.collect_list(F.struct("ts", F.col(position).alias("p")))).alias("rows"))
    known = F.filter("rows", lambda r: r["p"].isNotNull())
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["top"], r["p"].cast("double")).alias("top"), (acc["n"] + F.when(r["p"].cast("double") <= acc["top"], 1).otherwise(0)).alias("n"))
    return rows.select("window", key, F.size("rows").cast("long").alias("n"), (F.size("rows") - F.size(known)).cast("long").alias("rejected"), F.aggregate(known, start, step, lambda acc: acc["n"]).cast("long").alias("disordered"))
