import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm.line_dedup import PerfectIndex, drop_common_lines, line_digests, line_key, without_common_lines
from echofold.llm.registry import ORACLE_SQL


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 3))
def test_perfect_index(keys, repeats):
    k = np.array(sorted(keys), np.uint64)
    k = np.concatenate([k, k[:repeats]])  # equal slot bits, told apart by their prints
    prints = np.arange(len(k), dtype=np.uint64) * np.uint64(7)
    counts = np.arange(len(k), dtype=np.uint64) + np.uint64(1)
    index = PerfectIndex.unpack(PerfectIndex.build(k, prints, counts).pack())
    assert (index.count(k, prints) == counts.astype(np.int64)).all() and len(index.prints) == len(k)
    assert not index.count(k, prints + np.uint64(3)).any() and sum(int(b.sum()) for b in index.levels) == len(k)


def plain(rows, least=10, chars=1):
    split = [(t or "").split("\n") for _, t in rows]
    found = Counter(k for lines in split for k in {line_key(x) for x in lines} if len(k) >= chars)
    out = []
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [x for x in lines if found[line_key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "shard_keys": 1}, {"shard_keys": 1}])
def test_against_plain_python(spark, options):
    rows = [(i, f"Common \n own {i}\n\x0b mIXed{i % 3}\t\n\n É") for i in range(25)]
    rows += [(None, None), (3, ""), (4, "\n\n"), (4, "\n\n"), (5, "common\ncommon\nCOMMON"), (6, "É"), (7, "é"), (8, "x\ny\n" * 5000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, n_lines string")
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_digests(df, **options).collect()), key=repr)
    assert got == plain(rows)


def test_given_documents_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op7_line_dedup"]).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(tuple, line_digests(docs).collect())) == want == sorted(map(tuple, line_digests(docs, broadcast_bytes=0, shard_keys=40).collect()))
    assert sum(r[2] for r in want) > 100


def test_empty_tables_and_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_chars int")
    assert line_digests(df).count() == 0 and drop_common_lines(df, broadcast_bytes=0).count() == 0
    df = spark.createDataFrame([(i, "a\nb" + str(i), 99) for i in range(10)], "doc_id long, text string, n_chars int")
    out = without_common_lines(df)
    assert out.dtypes == df.dtypes and {(r.text, r.n_chars) for r in out.collect()} == {(f"b{i}", 2) for i in range(10)}


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_clashing_columns_on_either_path(spark, options):
    df = spark.createDataFrame([(i, "a\nb" + str(i), 7, "t", "g", "r", "o") for i in range(12)], "doc_id long, text string, n_lines int, text_id string, gone string, row string, own_id string")
    got = drop_common_lines(df, **options).collect()
    assert {(r.kept_text, r.n_lines, r.n_dropped, r.text_id, r.gone, r.row, r.own_id) for r in got} == {(f"b{i}", 2, 1, "t", "g", "r", "o") for i in range(12)}
    kept = without_common_lines(df, **options)
    assert kept.columns == df.columns and {(r.text, r.n_lines) for r in kept.collect()} == {(f"b{i}", 7) for i in range(12)}
