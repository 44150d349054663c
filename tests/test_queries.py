"""Each query against its SQL, and operators against plain Python, on small data."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from echofold import engine
from echofold.functions import kernels
from echofold.functions.config import MatchConfig, Overlay
from echofold.functions.hashing import crc32c
from echofold.operators import archives, candidates, documents, evaluate, layouts, scans, select
from echofold.plans import queries as own
from echofold.sources import binary_files, streams

from .test_kernels import best

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return int(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(own.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def payloads(spark):
    rows = [(1, b"abc" * 50), (2, bytes(range(100)) * 5 + b"tail"), (3, b""), (4, None), (5, b"z" * 700), (None, b"lost")]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in rows], "id long, payload binary")
    return streams(df, "id", "payload"), {i: p or b"" for i, p in rows if i is not None}


def test_streams(spark):
    s, data = payloads(spark)
    assert {r.stream_id: (bytes(r.payload), r.byte_len) for r in s.collect()} == {i: (p, len(p)) for i, p in data.items()}
    text = streams(spark.createDataFrame([(1, "é")], "id long, t string"), "id", "t").first()
    assert text.byte_len == 2


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"xyz")
    r = binary_files(spark, f"file://{tmp_path}").first()
    assert bytes(r.payload) == b"xyz" and r.byte_len == 3


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200


@pytest.mark.parametrize("method", ["m0", "m1", "m2", "m3", "m4", "m5"])
def test_matches_of_each_method(spark, method):
    s, data = payloads(spark)
    cfg = MatchConfig(method, min_match=32, **({"seed_size": 16} if method in ("m3", "m4") else {"target_chunk": 32} if method in ("m1", "m2") else {}))
    got = {}
    for r in engine.find_matches(s, cfg).collect():
        got.setdefault(r.stream_id, []).append((r.src, r.dst, r.len))
    want = {i: m for i, p in data.items() if (m := best(p, cfg)[1])}
    assert {i: sorted(m) for i, m in got.items()} == {i: sorted(m) for i, m in want.items()}


def test_sizes_of_all_methods_in_one_pass(spark):
    s, _ = payloads(spark)
    s = s.where("byte_len > 0")
    configs = {k: MatchConfig(k, min_match=32, **({"seed_size": 16} if k in ("m3", "m4") else {"target_chunk": 32} if k in ("m1", "m2") else {})) for k in ("m0", "m1", "m2", "m3", "m4", "m5")}
    configs["m4+overlay"] = MatchConfig("m4", min_match=64, seed_size=32, block_size=1024, overlay=Overlay(32, 1000))
    rows = {(r.stream_id, r.kind): r for r in evaluate.sizes_of_methods(s, configs, "m4").collect()}
    for k, cfg in configs.items():
        for r in engine.statistics(s, cfg).collect():
            got = rows.pop((r.stream_id, k))
            assert (got.original_size, got.semantic_match_count, got.covered_bytes, got.archive_size) == (r.original_size, r.semantic_match_count, r.covered_bytes, r.archive_size)
    assert not rows


@pytest.mark.parametrize("name", ["method_comparison", "candidate_events"])
def test_methods_share_one_pass(spark, name):
    plan = own.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("MapInArrow") == 1 and "Join" not in plan


def test_events_of_all_methods(spark):
    s, data = payloads(spark)
    configs = {"m0": MatchConfig("m0", min_match=32), "m2": MatchConfig("m2", min_match=8, target_chunk=32), "m4": MatchConfig("m4", min_match=32, seed_size=16)}
    want = {(i, k, f.raw, f.distinct) for i, p in data.items() for k, c in configs.items() for f in [kernels.candidates(p, c, best=True)]}
    assert {(r.stream_id, r.method, r.raw_events, r.distinct_candidates) for r in candidates.metrics_of_methods(s, configs).collect()} == want


def test_islands_do_not_change_the_choice(spark):
    s, _ = payloads(spark)
    cfg = MatchConfig("m4", min_match=32, seed_size=16)
    reps = select.representatives(select.gain_filter(candidates.find_candidates(s, cfg)))
    whole = {(r.stream_id, r.src, r.dst, r.len) for r in select.best_intervals(reps).collect()}
    isles = select.islands(reps).withColumn("stream_id", F.col("stream_id") * 1000 + F.col("island"))
    assert {(r.stream_id // 1000, r.src, r.dst, r.len) for r in select.best_intervals(isles).collect()} == whole


def test_order_and_bounds(spark):
    s, _ = payloads(spark)
    cfg = MatchConfig("m4", min_match=32, seed_size=16)
    m = engine.find_matches(s, cfg)
    assert all(r.overlaps == 0 and r.disordered == 0 for r in select.order_violations(m).collect())
    most = {r.stream_id: r.most_matches for r in select.match_count_bound(s, cfg).collect()}
    assert all(r.n <= most[r.stream_id] for r in m.groupBy("stream_id").agg(F.count("*").alias("n")).collect())


def test_callers_candidates(spark):
    s, data = payloads(spark)
    rows = spark.createDataFrame([(1, 0, 3, 147), (5, 0, 1, 699), (2, 0, 3, 40), (2, 0, 900, 40), (2, 5, 5, 40), (9, 0, 1, 30)], "stream_id long, src long, dst long, len long")
    status = {(r.stream_id, r.src, r.dst): r.status for r in candidates.verified(rows, s).collect()}
    assert status == {(1, 0, 3): "ok", (5, 0, 1): "ok", (2, 0, 3): "bytes differ", (2, 0, 900): "out of range", (2, 5, 5): "source is not before destination", (9, 0, 1): "no such stream"}
    cfg = MatchConfig("m4", min_match=32, seed_size=16)
    good = rows.where("stream_id IN (1, 5)")
    back = engine.decompress(engine.compress_with_candidates(s, good, cfg))
    assert {r.stream_id: bytes(r.payload) for r in back.collect()} == data
    with pytest.raises(Exception, match="bytes differ|out of range|not before"):
        engine.compress_with_candidates(s, rows.where("stream_id = 2"), cfg).collect()
    loose = select.select_matches(candidates.external_candidates(rows.where("stream_id <> 2")), s, cfg, strict=False)
    assert {r.stream_id for r in loose.collect()} == {1, 5}


@pytest.mark.parametrize("layout", ["index", "future", "io"])
def test_sizes_are_those_of_containers(spark, layout):
    s, data = payloads(spark)
    cfg = MatchConfig("m4", layout=layout, min_match=32, seed_size=16, block_size=1024)
    archived = engine.compress(s, cfg)
    sizes = {r.stream_id: r.encoded_size for r in layouts.encoded_sizes(engine.find_matches(s, cfg), s, cfg).where(F.col("layout") == layout).collect()}
    assert {r.stream_id: len(r.archive) for r in archived.collect()} == sizes
    info = {r.stream_id: r for r in engine.inspect(archived).collect()}
    stats = {r.stream_id: r for r in engine.statistics(s, cfg).collect()}
    for i, p in data.items():
        assert info[i].original_size == len(p) == stats[i].original_size and info[i].covered_bytes == stats[i].covered_bytes and info[i].archive_size == stats[i].archive_size
    assert {tuple(r) for r in archives.archive_matches(archived).collect()} == {tuple(r) for r in engine.find_matches(s, cfg).collect()}


def test_containers_are_handed_on_in_parts(spark):
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    s, data = payloads(spark)
    schema = StructType([StructField("stream_id", LongType()), StructField("archive", BinaryType())])
    rows = [(i, bytearray(b"x" * (kernels.GROUP // 2 + 1))) for i in range(4)] + [(4, None)]
    sizes = spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(lambda bs: (b.select(["stream_id"]) for b in archives.parts(bs, "archive")), "stream_id long")
    assert [r.stream_id for r in sizes.collect()] == [0, 1, 2, 3, 4]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [bytes(r[1]) if r[1] else None for r in rows]})
    assert [len(b) for b in archives.parts([batch, batch.slice(0, 0)], "a")] == [1, 1, 1, 2]
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert int(size.rstrip("b")) <= 8 << 20


def test_broken_containers_are_rows(spark):
    s, _ = payloads(spark)
    a = engine.compress(s, MatchConfig("m4", min_match=32, seed_size=16))
    broken = a.withColumn("archive", F.when(F.col("stream_id") == 1, F.expr("substring(archive, 1, 50)")).when(F.col("stream_id") == 2, F.lit(b"????????????")).when(F.col("stream_id") == 3, F.lit(None)).otherwise(F.col("archive")))
    assert {r.stream_id: r.status for r in engine.verify(broken).collect()} == {1: "TruncatedArchive", 2: "CorruptHeader", 3: "TruncatedArchive", 4: "ok", 5: "ok"}
    assert {r.stream_id: r.format for r in archives.sniff_formats(broken.where("archive IS NOT NULL"), "archive").collect()} == {1: "own", 2: "corrupt", 4: "own", 5: "own"}
    assert archives.inspect_archives(broken).where("status <> 'ok' AND method IS NOT NULL").count() == 0


def test_scans(spark):
    s, data = payloads(spark)
    got = {(r.stream_id, r.block_id): (r.start, r.len, r.crc32c) for r in scans.block_digests(s, 64).collect()}
    assert got == {(i, k): (a, len(p[a : a + 64]), crc32c(p[a : a + 64])) for i, p in data.items() for k, a in enumerate(range(0, len(p), 64))}
    from echofold.functions.hashing import poly_hash

    region = 8
    want = {}
    for i, p in data.items():
        for k in range(max(0, len(p) - region + 1) // region):
            want[i, k] = max(range(k * region, (k + 1) * region), key=lambda x: (poly_hash(p[x : x + region]), -x))
    assert {(r.stream_id, r.region_id): r.position for r in scans.region_representatives(s, region).collect()} == want
    for r in scans.byte_statistics(s).collect():
        p = data[r.stream_id]
        share = [p.count(bytes([b])) / len(p) for b in set(p)]
        assert math.isclose(r.entropy, -sum(x * math.log2(x) for x in share), abs_tol=1e-9) and r.distinct_bytes == len(share)


def test_corpus_matches_hold_every_repeat(spark):
    s, data = payloads(spark)
    seen, want = {}, set()
    for i in sorted(data):
        for a in range(0, len(data[i]) - 15, 16):
            key = data[i][a : a + 16]
            if key in seen:
                want.add((*seen[key], i, a))
            seen.setdefault(key, (i, a))
    assert {(r.src_stream, r.src, r.stream_id, r.dst) for r in candidates.corpus_seed_matches(s, 16).collect()} == want
    cfg = MatchConfig("m1", min_match=8, target_chunk=32, block_size=1024)
    a = {(r.stream_id, r.src, r.dst, r.len) for r in candidates.chunk_pairs(scans.cdc_chunks(s, cfg), cfg).collect()}
    assert a == {(r.stream_id, r.src, r.dst, r.len) for r in candidates.find_candidates(s, cfg).collect()}


def test_evaluation(spark):
    a = spark.createDataFrame([("x", 1, 5), ("x", 2, 7), ("x", 3, 9), ("y", 1, 4)], "g string, id long, size long")
    b = spark.createDataFrame([("x", 1, 6), ("x", 2, 7), ("x", 3, 10), ("y", 2, 4)], "g string, id long, size long")
    got = {r.g: r for r in evaluate.compare_sizes(a, b, ["g", "id"], ["g"], "size").collect()}
    assert (got["x"].wins, got["x"].ties, got["x"].losses, got["x"].majority) == (2, 1, 0, True)
    assert (got["y"].missing, got["y"].unexpected, got["y"].majority) == (1, 1, False)
    assert {r.size_ratio for r in evaluate.ratios(a, b, ["g", "id"], ["size"]).collect()} == {5 / 6, 1.0, 0.9, None}
    assert a.agg(F.round(evaluate.geometric_mean(F.col("size")), 9)).first()[0] == round((5 * 7 * 9 * 4) ** 0.25, 9)
    assert spark.range(3).agg(evaluate.geometric_mean(F.col("id"))).first()[0] == 0
    assert evaluate.population_difference(a, a).count() == 0 and evaluate.population_difference(a, b).count() == 6
    lines = spark.createDataFrame([("PROFILE event=sort elapsed_ms=12 ram=5 ram_peak=9 temp=0 temp_peak=1 handles=2 files=3 io=77 rows=4",), ("noise",)], "value string")
    r = evaluate.parse_profile(lines).first()
    assert (r.event, r.elapsed_ms, r.ram_peak, r.io, r.detail) == ("sort", 12, 9, 77, "rows=4")
    records = spark.createDataFrame([("a", "active", ["t1", "t2"]), ("b", "retired", [])], "id string, status string, tests array<string>")
    assert {(r.status, r.n, r.total) for r in evaluate.status_counts(records).collect()} == {("active", 1, 2), ("retired", 1, 2)}
    known = spark.createDataFrame([("t1",)], "name string")
    assert [r.ref for r in evaluate.unmapped(records, known, "id", "tests", "name").collect()] == ["t2"]


def test_document_units(spark):
    text = "# A\n\npara one\nmore\n\n- item\n  goes on\n- two\n\n## B\n| x | y |\n|---|---|\n| 1 | 2 |\n\n$$\na+b\n$$\n"
    rows = documents.document_units(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").orderBy("unit_no").collect()
    assert [(r.heading, r.kind, r.text) for r in rows] == [("A", "paragraph", "para one more"), ("A", "list_item", "item goes on"), ("A", "list_item", "two"), ("A > B", "table_row", "x | y"), ("A > B", "table_row", "1 | 2"), ("A > B", "formula", "a+b")]
    assert len({r.unit_id for r in rows}) == 6 and all(len(r.unit_id) == 16 for r in rows)


def test_incremental_chunks_over_restarts(spark, tmp_path):
    from echofold.streaming.incremental import new_chunks, run_to_table, text_stream

    cfg = MatchConfig("m1", min_match=8, target_chunk=32, block_size=1024)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    src, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    docs.where("doc_id < 60").coalesce(1).write.parquet(src)
    stream = lambda: text_stream(spark, src, docs.schema)
    run_to_table(spark, stream(), cfg, out, state)
    docs.where("doc_id >= 40 AND doc_id < 90").coalesce(1).write.mode("append").parquet(src)
    got = run_to_table(spark, stream(), cfg, out, state)
    want = new_chunks(docs.where("doc_id < 90"), cfg)
    assert got.select("key").distinct().count() == got.count() == want.count()


def test_late_rows_and_rejects(spark, tmp_path):
    from echofold.streaming.incremental import arrival_violations

    rows = spark.createDataFrame([(1, None, "a"), (2, 5, "a")], "t long, position long, k string").select(F.timestamp_seconds("t").alias("ts"), "position", "k")
    r = arrival_violations(rows, "k", "position").first()
    assert (r.n, r.rejected) == (2, 1)
