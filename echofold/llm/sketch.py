"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions only.

A text's sketch is the set of its shingle hashes below a fixed fraction of the hash range.
Two sketches are samples of the same part of the hash space however long their texts are, so
the union of sketches is the sketch of the union, and overlap over own size estimates
containment even between a line and a book.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_of

SHINGLE, ONE_IN = 5, 4
#: Rows of a range of ids.
RANGE_ROWS, MOST_RANGES = 512, 4_096
WORD = r"[^\x20\x09-\x0D]+"


def sketch(text: Column, shingle: int = SHINGLE, one_in: int = ONE_IN) -> Column:
    """The retained hashes of ``text``, sorted, each once. Null is the empty text.

    Shingles are runs of ``shingle`` words; a text of fewer words is one shingle, the empty
    text too. Hashes lie in [-2**63, 2**63); those below -2**63 + 2**64 / one_in are kept.
    Of a text all of whose hashes are above, the least hash stands for the sketch.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    # hashing each word first keeps the shingles' own hashes to a few numbers each
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (shingle - 1), F.lit(1))), lambda i: F.xxhash64(*(F.get(h, i + (j - 1)) for j in range(shingle))))
        return _retained(each, one_in)

    # through a one-element array, so that the words are hashed once and not at each use
    return F.transform(F.array(hashed), of)[0]


def _retained(hashes: Column, one_in: int) -> Column:
    """The ``hashes`` below the bound, sorted, each once, or else the least of them."""
    last = -(2**63) + 2**64 // one_in - 1
    low = F.filter(hashes, lambda x: x <= F.lit(last))
    # through a one-element array, so that they are filtered once
    return F.transform(F.array(low), lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(F.array_min(hashes))))[0]


def merge(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of both texts together (but for the shingles across their border)."""
    return _retained(F.array_union(a, b), one_in)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return both.cast("double") / (F.size(a) + F.size(b) - both)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(a)


def as_string(s: Column) -> Column:
    """16 hex digits for each hash."""
    return F.concat_ws("", F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")))


def range_of(value: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    above = lambda at, step: (at + step <= len(bounds)) & (F.get(known, at + step - 1) < value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(above(at, step), at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, columns: list[str], range_rows: int = RANGE_ROWS, added: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` with ``next_<column>``, of the row that follows in descending ``id_col`` order; after the last comes the first.

    The columns ``added`` are made once for each row, and are handed on like ``columns``.

    Null ids come last; equal ids are in descending order of ``columns``. Rows are dealt to
    ranges of ids of about ``range_rows`` rows, ``MOST_RANGES`` at most, and put in order
    range by range. The first row of a range is added behind the last of the range before,
    where it serves as its next row only.
    """
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, max(1, ceil(docs.count() / range_rows)))
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.select(F.percentile_approx(id_col, shares, 20 * ranges).alias("q")).first()["q"] if shares else None
    bounds = sorted(set(found or ()))
    ranged = docs.withColumn("__range", F.when(F.col(id_col).isNull(), F.lit(-1)).otherwise(range_of(F.col(id_col), bounds)))
    tops = {r["__range"]: r["top"] for r in ranged.groupBy("__range").agg(F.max(id_col).alias("top")).collect()}
    added = added or {}
    if not tops:
        return docs.withColumns(added).select("*", *(F.col(c).alias(f"next_{c}") for c in (*columns, *added)))
    down = sorted(tops, reverse=True)
    handed = spark.createDataFrame([(tops[below], above) for above, below in zip(down, down[1:] + down[:1], strict=True)], "__top long, __for int")
    at_top = docs.join(F.broadcast(handed), F.col(id_col).cast("long").eqNullSafe(F.col("__top")))
    heads = at_top.groupBy("__for").agg(F.max(F.struct(id_col, *columns)).alias("h")).select(F.col("h")[id_col].alias(id_col), *(F.col("h")[c].alias(c) for c in columns), F.col("__for").alias("__range"), F.lit(True).alias("__handed"))
    w = Window.partitionBy("__range").orderBy("__handed", F.col(id_col).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in columns))
    both = ranged.withColumn("__handed", F.lit(False)).unionByName(heads, allowMissingColumns=True).withColumns(added)
    nexts = both.withColumn("__next", F.lead(F.struct(*columns, *added)).over(w)).where("NOT __handed")
    return nexts.select(*docs.columns, *added, *(F.col("__next")[c].alias(f"next_{c}") for c in (*columns, *added)))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, n_chars, sketch) of every whole text; equal texts have equal sketches. Row by row, without a shuffle."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), sketch(text, shingle, one_in).alias("sketch"))


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, one_in: int = ONE_IN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has the first half of the text (the larger, of an odd length) and then
    as many code points, or all, of the start of the next document's, by descending id;
    after the last comes the first. A single document follows itself. A null text is the
    empty one. Repeated rows count each; an empty table gives none.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = with_next(base, "doc_id", ["text"], range_rows, {"sketch": sketch(F.col("text"), shingle, one_in)})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    # the aliased sketch must not be merged into its uses, which would make it once for each
    out = out.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.explode(F.array(sketch(F.col("edited"), shingle, one_in))).alias("edited_sketch"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
