import numpy as np
import pytest

from echofold.llm.permutation_index import footrule_gains, permutation_neighbours, prefixes, usable

SCHEMA = "vec_id long, embedding array<float>, rank string"


def exact(rows, asked, k=5):
    out = {}
    for q, v in asked:
        a = np.array(v, float)
        near = [(-float((a / np.linalg.norm(a)) @ (np.array(w, float) / np.linalg.norm(w))), i) for i, w in rows if i != q]
        out[q] = [i for _, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def test_footrule_gain_is_the_distance_from_the_largest():
    r = np.random.default_rng(0)
    pivots = r.standard_normal((20, 6))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    orders, asked = (prefixes(r.standard_normal((n, 6)), pivots, 7) for n in (40, 5))
    for q, gain in zip(asked, footrule_gains(orders, asked, 20), strict=True):
        for o, g in zip(orders, gain, strict=True):
            place = lambda xs, p: list(xs).index(p) if p in xs else 7
            distance = sum(abs(place(q, p) - place(o, p)) for p in {*q, *o})
            assert distance == 7 * 8 - g


def test_whole_lists_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.standard_normal(8)]) for i in range(300)]
    rows[7] = (7, rows[6][1])
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    asked = [(i, v) for i, v in rows if i % 50 == 0 or i == 6]
    got = {}
    for x in sorted(permutation_neighbours(df, df.where("vec_id % 50 = 0 OR vec_id = 6"), block_rows=64, block_queries=3, rerank=1.0).collect(), key=lambda x: x["rank"]):
        got.setdefault(x.query_id, []).append(x.vec_id)
    single = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == exact(single, [(i, [float(np.float32(x)) for x in v]) for i, v in asked])


def recall(df, rows, **options):
    want = exact(rows, [(i, v) for i, v in rows if i % 50 == 0])
    hits = sum(r.vec_id in want[r.query_id] for r in permutation_neighbours(df, df.where("vec_id % 50 = 0"), **options).collect())
    return hits / sum(map(len, want.values()))


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.select("vec_id", "embedding").collect()]
    assert recall(df, rows) >= 0.95 and recall(df, rows, rerank=0.01) < 0.9


def test_recall_on_a_full_block_without_structure(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((16_384, 32)).astype(np.float32)
    df = spark.createDataFrame([(i * 5, x.tolist(), "x") for i, x in enumerate(v)], SCHEMA)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    asked = np.arange(0, len(v), 400)
    near = u[asked] @ u.T
    near[np.arange(len(asked)), asked] = -9
    want = {int(5 * q): set((5 * np.argsort(-row)[:5]).tolist()) for q, row in zip(asked, near, strict=True)}
    rows = permutation_neighbours(df, df.where("vec_id % 2000 = 0"), rerank=0.1).collect()
    assert len(rows) == 5 * len(asked) and sum(x.vec_id in want[x.query_id] for x in rows) >= 0.9 * len(rows)


def test_vectors_of_the_commonest_length_take_part(spark):
    rows = [(0, [1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, [2.0]), (4, [1.0, 0.0]), (5, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = permutation_neighbours(df, df).collect()
    assert {r.query_id for r in got} == {r.vec_id for r in got} == {1, 2, 4} and len(got) == 6


def test_rows_that_take_no_part(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0])]
    good = [(10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in bad + good], SCHEMA)
    assert {r.vec_id for r in usable(df, "vec_id", "embedding").collect()} == {10, 11, 12}
    got = sorted(tuple(r) for r in permutation_neighbours(df, df).collect())
    assert [(q, k, v) for q, k, v, _ in got] == [(10, 1, 11), (10, 2, 12), (11, 1, 10), (11, 2, 12), (12, 1, 10), (12, 2, 11)]
    assert got[0][3] == pytest.approx(1.0, abs=1e-15) and got[1][3] == 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert permutation_neighbours(df, df).count() == 0
    one = spark.createDataFrame([(1, [1.0], "x")], SCHEMA)
    assert permutation_neighbours(one, one).count() == 0 and permutation_neighbours(one, df).count() == 0


def test_extreme_components(spark):
    df = spark.createDataFrame([(1, [1e38, 0.0], "x"), (2, [1e-38, 1e-45], "x"), (3, [-1e38, 1e38], "x")], SCHEMA)
    got = {(r.query_id, r.vec_id): r.score for r in permutation_neighbours(df, df).collect()}
    assert got[1, 2] == pytest.approx(1.0) and got[1, 3] == pytest.approx(-(2**-0.5))
