import zlib

import numpy as np

from echofold.llm.quality_gam import FEATURES, add_scores, features, fit, keep_good, score_documents, train

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = score_documents(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    y = np.array([truth[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.97 and np.mean([r.predicted == t for r, t in zip(held, y, strict=True)]) > 0.97


def test_tables_and_pairs_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:3000], y[:3000], n_pairs=3)
    assert model.pairs[0][:2] == (0, 1) and auc(model.score(x[3000:]), y[3000:]) > 0.95
    again = fit(x[:3000], y[:3000], n_pairs=3)
    assert (model.score(x) == again.score(x)).all()


def test_scores_are_sums_of_table_entries():
    r = np.random.default_rng(3)
    x = np.round(r.random((1500, 4)), 2)
    model = fit(x, ((x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * r.random(1500)) > 0.9).astype(float), n_pairs=3, rounds=20)
    bin_of = lambda cuts, v: sum(c <= v for c in cuts)
    assert len(model.pairs) == 3
    for row in [*x[:60], np.array([-9.0, 9.0, 0.5, 0.5])]:
        odds = model.base + sum(t[bin_of(c, v)] for t, c, v in zip(model.tables, model.cuts, row, strict=True))
        odds += sum(t[bin_of(cj, row[j]), bin_of(ck, row[k])] for j, k, cj, ck, t in model.pairs)
        assert abs(model.score(row[None, :])[0] - 1 / (1 + np.exp(-odds))) < 1e-12


def test_without_both_labels():
    x = np.zeros((3, 2))
    assert fit(x[:0], np.zeros(0)).score(x).tolist() == [0.5] * 3
    assert (fit(x, np.ones(3)).score(x) == 3.5 / 4).all()


def test_features_of_odd_texts():
    for text in (None, "", " ", "\n\n", "x", "!" * 100_000, "\ud800", "世界 " * 50_000):
        v = features(text)
        assert len(v) == len(FEATURES) and np.isfinite(v).all()


def test_labels_are_used_only_outside_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, "good text here." if i % 2 else "### %%% $$$", "de") for i in range(200)], "doc_id long, text string, score string")
    real = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = spark.createDataFrame([(i, 1 - i % 2 if i in held else i % 2) for i in range(200)], "doc_id long, quality int")
    a, b = (sorted((r.doc_id, r.score) for r in score_documents(docs, x).collect()) for x in (real, wrong))
    assert a == b and keep_good(docs, real).columns == docs.columns
    assert {r.doc_id for r in keep_good(docs, real).collect()} == set(range(1, 200, 2))


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (9, 7)], "doc_id long, quality int")
    rows = score_documents(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and not next(r for r in rows if r.doc_id is None).held_out
    assert score_documents(docs.limit(0), labels).count() == 0
    model = train(docs, labels.limit(0))
    assert {r.score for r in add_scores(docs, model).collect()} == {0.5}
