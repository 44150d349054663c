"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Every row is posted under its
first ``prefix`` pivots, with the place of the pivot in its order, in the inverted file of
each pivot. A query walks the files of its own first pivots; what the two orders share
gives Spearman's footrule distance, with pivots missing from a prefix placed right behind
it. The rows with the smallest distance are ranked again by the exact cosine.

Rows are dealt evenly over blocks of bounded size, each with its own inverted files; the
stated queries, also in blocks, meet each block once, and the best of each block are
merged. So no task's memory grows with the table, and a repeated vector fills no task.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

#: Rows of a block, queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 4_096
OUT = "query_id long, vec_id long, score double"


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(vec_id, vec): one row per id; without null, zero or non-finite vectors and null ids.

    Where an id repeats with different vectors, the smallest vector (as an array) stands
    for it. With ``dim``, only vectors of that many components.
    """
    vec = F.col(vec_col).cast("array<double>")
    ok = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    out = df.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec")).where("vec_id IS NOT NULL AND vec IS NOT NULL").where(ok)
    if dim is not None:
        out = out.where(F.size("vec") == dim)
    return out.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by the largest component, so that squares neither overflow nor vanish."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def prefixes(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Row by row the ``prefix`` nearest pivots, nearest first, ties to the earlier pivot."""
    near = -(_unit(v) @ pivots.T)
    return np.argsort(near, axis=1, kind="stable")[:, :prefix].astype(np.int32)


def footrule_gains(orders: np.ndarray, queries: np.ndarray, n_pivots: int):
    """For each query, how much closer than the largest footrule distance each row is.

    The largest distance is ``prefix * (prefix + 1)``, for prefixes that share nothing; a
    pivot at places i and j of both takes ``2 * (prefix - max(i, j))`` off.
    """
    n, prefix = orders.shape
    flat = orders.ravel()
    by = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by], np.arange(n_pivots + 1))
    rows, places = (by // prefix).astype(np.int64), (by % prefix).astype(np.int32)
    for q in queries:
        gain = np.zeros(n, np.int32)
        for i, p in enumerate(q):
            at = slice(ends[p], ends[p + 1])
            gain[rows[at]] += 2 * (prefix - np.maximum(places[at], i))
        yield gain


def _search(dim: int, pivots: int, k: int, share: float):
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        ids, qids = (np.asarray(t["vec_id"].to_numpy()) for t in (data, asked))
        out: tuple[list, list, list] = ([], [], [])
        if len(ids) and len(qids):
            v, q = _unit(_matrix(data["vec"], dim)), _unit(_matrix(asked["vec"], dim))
            orders, wanted = (_matrix(t["near"], len(t["near"][0])) for t in (data, asked))
            most = min(len(ids), max(4 * k, ceil(share * len(ids))))
            for i, gain in enumerate(footrule_gains(orders, wanted, pivots)):
                gain[ids == qids[i]] = -1
                least = np.partition(gain, len(gain) - most)[len(gain) - most]
                at = np.flatnonzero(gain >= max(least, 0))
                score = (v[at] * q[i]).sum(axis=1)
                best = np.lexsort((ids[at], -score))[:k]
                out[0].append(np.full(len(best), qids[i]))
                out[1].append(ids[at][best])
                out[2].append(score[best])
        cat = [np.concatenate(x) if x else np.array([]) for x in out]
        return pa.table({"query_id": pa.array(cat[0], pa.int64()), "vec_id": pa.array(cat[1], pa.int64()), "score": pa.array(cat[2], pa.float64())})

    return run


def permutation_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    n_pivots: int = 256,
    prefix: int = 96,
    rerank: float = 0.125,
    seed: int = 7,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each query.

    ``n_pivots`` rows, drawn by a seeded hash of the id, are the pivots: the only thing
    fitted on a sample, and all that is sent to the driver. Every row is indexed.
    Of each block, whatever its size, that share ``rerank`` which is nearest by footrule
    (4 * ``k`` rows at least), and all that tie with the last of it, is ranked by the exact
    cosine of the original vectors in double precision; ties go to the smaller id. A
    query's own id is never its neighbour. Null, zero and non-finite vectors and null ids
    take no part; nor do vectors of another length than the commonest (of those the shortest). An
    empty table, or one without usable vectors, gives no rows; where fewer than ``k``
    other rows exist, all are given. Further columns are ignored.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = usable(vectors, id_col, vec_col).groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not common:
        return empty
    dim = common["dim"]
    first = usable(vectors, id_col, vec_col, dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n_pivots).collect()
    pivots = _unit(np.array([r["vec"] for r in first]))
    prefix = min(prefix, len(pivots))

    def order(batches):
        for b in batches:
            near = prefixes(_matrix(b["vec"], dim), pivots, prefix)
            yield b.append_column("near", pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, prefix), pa.int32()), pa.array(near.ravel())))

    schema = "vec_id long, vec array<double>, near array<int>"
    data = stash(usable(vectors, id_col, vec_col, dim).mapInArrow(order, schema), "permutations")
    asked = stash(usable(queries, id_col, vec_col, dim).mapInArrow(order, schema), "queries")
    n, m = data.count(), asked.count()
    if not n or not m:
        return empty
    blocks, sets = ceil(n / block_rows), ceil(m / block_queries)
    deal = lambda df, own, of, other, others: df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(of).cast("long"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
    left, right = deal(data, "block", blocks, "set", sets), deal(asked, "set", sets, "block", blocks)
    found = left.groupBy("block", "set").cogroup(right.groupBy("block", "set")).applyInArrow(_search(dim, len(pivots), k, rerank), OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
