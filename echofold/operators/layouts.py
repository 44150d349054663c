"""Three layouts of matches as tables, what they leave as literals, and the size they encode to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.config import MatchConfig

HEADER_BYTES, TAIL_BYTES, CRC_BYTES = 80, 44, 4


def varint_bytes(v: Column) -> Column:
    """Bytes of the shortest encoding with seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(v)) / 7)).cast("long")


def derived(matches: DataFrame) -> DataFrame:
    """``matches`` with distance, end and period (the source bytes that differ before they repeat)."""
    d = F.col("dst") - F.col("src")
    return matches.withColumn("distance", d).withColumn("end", F.col("dst") + F.col("len")).withColumn("period", F.least("len", d))


def index_table(matches: DataFrame) -> DataFrame:
    """(stream_id, origin_match_id, dst_gap, distance, total_len): one table in destination order, gaps from the last end."""
    by = Window.partitionBy("stream_id").orderBy("dst")
    gap = F.col("dst") - F.coalesce(F.lag(F.col("dst") + F.col("len")).over(by), F.lit(0))
    return matches.select("stream_id", "origin_match_id", gap.alias("dst_gap"), (F.col("dst") - F.col("src")).alias("distance"), F.col("len").alias("total_len"))


def from_index_table(table: DataFrame) -> DataFrame:
    """The matches of an index table: running sums of gaps and lengths."""
    by = Window.partitionBy("stream_id").orderBy("origin_match_id").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("dst_gap") + F.col("total_len")).over(by)
    dst = end - F.col("total_len")
    return table.select("stream_id", "origin_match_id", (dst - F.col("distance")).alias("src"), dst.alias("dst"), F.col("total_len").alias("len"))


def future_registers(matches: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, block_id, register_id, source_offset, distance, total_len): matches owned by their source's block."""
    block = F.expr(f"src div {block_size}")
    by = Window.partitionBy("stream_id", "block_id").orderBy("src", "dst", F.desc("len"))
    return matches.withColumn("block_id", block).select("stream_id", "block_id", (F.row_number().over(by) - 1).cast("long").alias("register_id"), (F.col("src") % block_size).alias("source_offset"), (F.col("dst") - F.col("src")).alias("distance"), F.col("len").alias("total_len"))


def literal_ranges(matches: DataFrame, streams: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, block_id, start, len): what no match covers, cut at block borders."""
    sizes = streams.select("stream_id", F.col("byte_len").alias("end"))
    # a stream's end counts as one more interval, behind which no gap follows
    marks = matches.select("stream_id", "dst", (F.col("dst") + F.col("len")).alias("to")).unionByName(sizes.select("stream_id", F.col("end").alias("dst"), F.col("end").alias("to")))
    by = Window.partitionBy("stream_id").orderBy("dst", "to")
    gaps = marks.select("stream_id", F.coalesce(F.lag("to").over(by), F.lit(0)).alias("a"), F.col("dst").alias("b")).where("a < b")
    cut = gaps.select("stream_id", "a", "b", F.explode(F.sequence(F.expr(f"a div {block_size}"), F.expr(f"(b - 1) div {block_size}"))).alias("block_id"))
    start = F.greatest(F.col("a"), F.col("block_id") * block_size)
    return cut.select("stream_id", "block_id", start.alias("start"), (F.least(F.col("b"), (F.col("block_id") + 1) * block_size) - start).alias("len"))


def block_overlaps(matches: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, origin_match_id, block_id, start, len, is_first): each match cut at block borders; later pieces are carried."""
    cut = matches.select("*", F.explode(F.sequence(F.expr(f"dst div {block_size}"), F.expr(f"(dst + len - 1) div {block_size}"))).alias("block_id"))
    start = F.greatest(F.col("dst"), F.col("block_id") * block_size)
    return cut.select("stream_id", "origin_match_id", "block_id", start.alias("start"), (F.least(F.col("dst") + F.col("len"), (F.col("block_id") + 1) * block_size) - start).alias("len"), (start == F.col("dst")).alias("is_first"))


def io_operations(matches: DataFrame, streams: DataFrame, block_size: int) -> DataFrame:
    """(stream_id, block_id, op_id, op, pos, len, distance): literals and match starts of each block in destination order."""
    none = F.lit(None).cast("bigint")
    lit = literal_ranges(matches, streams, block_size).select("stream_id", "block_id", F.lit("literal").alias("op"), F.col("start").alias("pos"), "len", none.alias("distance"))
    ref = matches.select("stream_id", F.expr(f"dst div {block_size}").alias("block_id"), F.lit("match").alias("op"), F.col("dst").alias("pos"), "len", (F.col("dst") - F.col("src")).alias("distance"))
    by = Window.partitionBy("stream_id", "block_id").orderBy("pos")
    return lit.unionByName(ref).withColumn("op_id", (F.row_number().over(by) - 1).cast("long")).select("stream_id", "block_id", "op_id", "op", "pos", "len", "distance")


def encoded_sizes(matches: DataFrame, streams: DataFrame, cfg: MatchConfig, which: tuple[str, ...] = ("index", "future", "io")) -> DataFrame:
    """(stream_id, layout, encoded_size): the bytes of a container in each layout of ``which``, from row values alone."""
    width = {"xxh3": 16, "blake3": 32}[cfg.checksum]
    fixed = HEADER_BYTES + TAIL_BYTES + 2 * width
    blocks = F.expr(f"(byte_len + {cfg.block_size - 1}) div {cfg.block_size}")
    out = streams.select("stream_id", "byte_len", blocks.alias("blocks"))
    v = varint_bytes
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    sizes = {}
    index = index_table(matches).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum(v(F.col("dst_gap")) + v(F.col("distance")) + v(F.col("total_len"))).alias("table_bytes"), F.sum("total_len").alias("covered"))
    out = out.join(index, "stream_id", "left")
    sizes["index"] = v(zero("n")) + zero("table_bytes")
    if "future" in which:
        registers = future_registers(matches, cfg.block_size).groupBy("stream_id", "block_id").agg(F.count(F.lit(1)).alias("m"), F.sum(v(F.col("source_offset")) + v(F.col("distance")) + v(F.col("total_len"))).alias("b"))
        out = out.join(registers.groupBy("stream_id").agg(F.sum(F.col("b") + v(F.col("m")) - 1).alias("register_bytes")), "stream_id", "left")
        sizes["future"] = F.col("blocks") + zero("register_bytes")
    if "io" in which:
        head = F.when(F.col("op") == "literal", 1 + v(F.col("len"))).otherwise(1 + v(F.col("distance")) + v(F.col("len")))
        out = out.join(io_operations(matches, streams, cfg.block_size).groupBy("stream_id").agg(F.sum(head).alias("op_bytes")), "stream_id", "left")
        sizes["io"] = zero("op_bytes")
    shared = F.lit(fixed) + F.col("byte_len") - zero("covered") + F.col("blocks") * CRC_BYTES
    rows = F.array(*(F.struct(F.lit(k).alias("layout"), (shared + sizes[k]).cast("long").alias("encoded_size")) for k in which))
    return out.select("stream_id", F.explode(rows).alias("r")).select("stream_id", "r.layout", "r.encoded_size")
