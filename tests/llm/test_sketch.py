import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echofold.llm.sketch import containment, edited_fingerprints, fingerprints, merge, sketch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORDS.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rows):
    """(id, n, edited text, next text), by descending id, null last, equal ids by descending text."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, nx = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, len(t), t[: len(t) - half] + nx[:half], nx))
    return out


@pytest.mark.parametrize("range_rows", [2, 5, 1000])
def test_edited_texts_in_any_number_of_ranges(spark, range_rows):
    rows = [(3 * i, f"tëxt {i} " * (i % 7) + "😀" * (i % 3)) for i in range(23)] + [(None, "none"), (None, None), (9, "tie"), (9, "tie"), (30, None), (33, "")]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, sketch string")
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in edited_fingerprints(df, range_rows=range_rows).collect()), key=repr)
    assert got == sorted(((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e, _ in edited(rows)), key=repr)


def test_a_fraction_of_all_hashes_estimates_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    texts = dict(rows)
    got = {r.doc_id: r for r in edited_fingerprints(docs).collect()}
    errors, sizes = [], []
    for i, _, e, nx in edited(rows):
        a, b, c = shingles(texts[i]), shingles(e), shingles(nx)
        errors += [len(a & b) / len(a | b) - got[i].near_edited, len(a & c) / len(a | c) - got[i].near_next]
        sizes.append(len(got[i].fingerprint) / 16 - len(a) / 4)
    assert abs(np.mean(errors)) < 0.01 and np.mean(np.abs(errors)) < 0.05 and abs(np.mean(sizes)) < 3
    same: dict = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint


def test_merge_and_containment(spark):
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    df = spark.createDataFrame([(a, b, " ".join(words[200:300]))], "a string, b string, c string")
    s = {x: sketch(F.col(x)) for x in "abc"}
    r = df.select(F.size(F.array_except(merge(s["a"], s["b"]), sketch(F.lit(" ".join(words))))).alias("extra"), containment(s["c"], s["a"]).alias("inside"), containment(s["a"], s["b"]).alias("half"), containment(sketch(F.lit("zzz")), s["a"]).alias("none"), F.size(merge(sketch(F.lit("zzz")), sketch(F.lit("zzzz")))).alias("one")).first()
    assert r.extra == 0 and r.inside == 1.0 and 0.42 < r.half < 0.58 and r.none == 0.0 and r.one in (1, 2)


def test_short_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a b c d"), (5, " a\tb\nc d e "), (6, "a b c d e")]
    got = {r.doc_id: r.sketch for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1).collect()}
    assert got[1] == got[2] and [len(got[i]) for i in range(1, 7)] == [1] * 6 and got[5] == got[6] != got[4]
    one = edited_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_texts_are_told_apart_by_their_least_hash(spark):
    rows = [(i, f"w{i}") for i in range(40)] + [(100, "same"), (99, "same")]
    for r in edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.near_next == (1.0 if r.doc_id == 100 else 0.0)


def test_no_python_runs_on_executors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = edited_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
