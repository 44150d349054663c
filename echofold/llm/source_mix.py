"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Each source's target is its share of all words by weight, at most ``cap`` times its own
size; what is above goes to the others by weight. A source's rows are dealt by a hash over as
many shards as their number asks for: a source with a third of all rows over a third of the
shards, a rare one over a single shard, where its share is many blocks. In each shard, blocks
of equal length are given to the sources one by one, each to the highest quotient target /
(2 * blocks so far + 1): integer quotas per shard and source, in proportion to the targets.
A source's rows in a shard are taken whole, as often as the quota is a multiple of their
words; what remains of the quota goes to rows in seeded order, each if it fits.

A shard holds about ``shard_rows`` rows of ids and sizes, without texts.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def targets(sizes: dict, weights=WEIGHTS, cap: float = 3.0) -> dict:
    """source -> words: shares of all words by weight, none above ``cap`` times its source's.

    Sources count in code point order, null last; the weights repeat. The excess of those
    above is shared out again, until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out = {s: 0.0 for s in order}
    # the least size for its weight is the first above, and each excess only brings others closer to it
    rest = sorted((s for s in order if sizes[s] > 0), key=lambda s: sizes[s] / weight[s])
    left, total = float(sum(sizes.values())), sum(weight[s] for s in rest)
    for i, s in enumerate(rest):
        if left * weight[s] / total <= cap * sizes[s]:
            return out | {x: left * weight[x] / total for x in rest[i:]}
        out[s] = cap * float(sizes[s])
        left, total = left - out[s], total - weight[s]
    return out


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """``seats`` by highest quotients weight / (2 * seats so far + 1), none above ``most``; ties to the first.

    A party has k seats at a price p if weight / (2k - 1) >= p > weight / (2k + 1), so the
    price is found by halving; what is left at that price goes one by one.
    """
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = min(seats, int(most[weights > 0].sum()))
    at = lambda p: np.where(weights > 0, np.minimum(np.floor((weights / p + 1) / 2), most), 0).astype(np.int64)
    if seats <= 0 or not (weights > 0).any():
        return np.zeros(len(weights), np.int64)
    low, high = weights[weights > 0].min() / (2.0 * most.max() + 2), 2 * weights.max()
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = at(high * (1 + 1e-9))  # below all ties, which then go one by one
    for _ in range(seats - int(got.sum())):
        q = np.where(got < most, weights / (2 * got + 1), -1)
        got[int(np.argmax(q))] += 1
    return got


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _picks(block: int, cap: float, whole: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["is_null", "source", "place", "id", "row"], kind="stable").reset_index(drop=True)
        cell = rows.groupby(["is_null", "source"], sort=False).ngroup().to_numpy()
        size = rows["size"].to_numpy(np.int64)
        total = np.bincount(cell, size).astype(np.int64)
        share = np.bincount(cell, size * rows["rate"].to_numpy(float))
        most = np.floor(cap * total).astype(np.int64)
        quota = np.minimum(sainte_lague(share, round(share.sum() / block), -(-most // block)) * block, most)
        laps = np.where(total > 0, quota // np.maximum(total, 1), 0)
        left = (quota - laps * total).tolist()
        taken = laps[cell] * size
        open_: dict[int, int] = {}  # the smallest row of a cell that did not fit
        for i, (c, n) in enumerate(zip(cell.tolist(), size.tolist(), strict=True)):
            if n <= left[c]:
                taken[i] += n
                left[c] -= n
            elif c not in open_ or n < size[open_[c]]:
                open_[c] = i
        for c, i in open_.items():
            n = int(size[i])
            taken[i] += (n if 2 * left[c] > n else 0) if whole else left[c]
        return pd.DataFrame({"row": rows["row"], "taken": taken})

    return run


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: float = 3.0, block: int = 16, shard_rows: int = 1_024, seed: int = 11, whole: bool = False, with_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    Sizes are counted over all rows, once. Only the list of sources with their sizes goes to
    the driver: it has as many rows as the mix has sources, each with a weight of its own. A
    null text has size 0 and null is a source of its own. No row is taken more than ``cap``
    times. The last words of a quota are the start of a row that does not fit as a whole;
    with ``whole``, that row is taken whole or not, whichever is nearer. What is taken depends
    on ids, texts, sources and ``seed`` only, so reruns agree; of rows with equal id, text and
    source any may be the one that is taken more often. An empty table gives none. Columns
    named like the new ones are replaced; without ``with_text``, the text is left out.
    """
    spark = docs.sparkSession
    old = docs.select(*(F.col(c) for c in docs.columns if c in (id_col, text_col, source_col) or c not in NEW))
    columns = [c for c in old.columns if with_text or c != text_col]
    text, source = F.col(text_col).cast("string"), F.col(source_col)
    rows = stash(
        old.select(
            F.struct(*(old[c] for c in columns)).alias("old"),
            n_words(text).alias("size"),
            F.col(id_col).cast("string").alias("id"),
            F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("place"),
            source.isNull().alias("is_null"),
            F.coalesce(source.cast("string"), F.lit("")).alias("source"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    found = rows.groupBy("is_null", "source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {(None if r["is_null"] else r["source"]): r["s"] for r in found}
    goal = targets(sizes, weights, cap)
    shards = max(1, ceil(sum(r["n"] for r in found) / shard_rows))
    table = [(r["is_null"], r["source"], r["s"], float(goal[None if r["is_null"] else r["source"]]), ceil(r["n"] / shard_rows)) for r in found]
    known = F.broadcast(spark.createDataFrame(table, "is_null boolean, source string, source_size long, target double, parts int"))
    part = F.pmod(F.xxhash64("place", F.lit(seed)), F.col("parts").cast("long"))
    slim = rows.select("row", "size", "id", "place", "is_null", "source").join(known, ["is_null", "source"])
    dealt = slim.select("row", "size", "id", "place", "is_null", "source", (F.col("target") / F.greatest("source_size", F.lit(1))).alias("rate"), F.pmod(part + F.pmod(F.xxhash64("is_null", "source"), F.lit(shards)), F.lit(shards)).alias("shard"))
    picks = dealt.groupBy("shard").applyInPandas(_picks(block, cap, whole), "row long, taken long")
    out = rows.join(picks.hint("merge"), "row").join(known, ["is_null", "source"])
    return out.select("old.*", "size", "source_size", "target", "taken")


#: Columns that ``mix_sources`` adds.
NEW = ("size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row, whole, for each time it is taken.

    A row of no words is never taken.
    """
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.struct(*(docs[c] for c in docs.columns)).alias("packed"))
    mixed = mix_sources(packed, id_col="id", text_col="text", source_col="source", whole=True, with_text=False, **options)
    return mixed.where("taken > 0").select("packed", F.explode(F.expr("sequence(1, CAST(taken div size AS INT))"))).select("packed.*")
