import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from echofold.functions.config import MatchConfig
from echofold.functions.errors import EngineError
from echofold.operators.evaluate import gates, parse_profile
from echofold.operators.scans import blocks, ordinals
from echofold.sources import streams
from echofold.sources.manifests import json_status, manifest, strict_json
from echofold.streaming.incremental import arrival_violations, recent_chunks


def population(spark, rows):
    return spark.createDataFrame(rows, "method string, id string, new_size long, old_size long, new_covered long, old_covered long")


def test_gates_over_a_fixed_population(spark):
    rows = [("m0", "a", 9, 10, 50, 50), ("m0", "b", 9, 10, 80, 50), ("m0", "c", 12, 10, 0, 0), ("m3", "a", 10, 10, 40, 50), ("m3", "b", 5, 10, 50, 50), ("m3", "c", 10, 10, 50, 50)]
    got = {r.method: r for r in gates(population(spark, rows), ["a", "b", "c"]).collect()}
    assert (got["m0"].wins, got["m0"].losses, got["m0"].positive, got["m0"].coverage, got["m0"].size_pass, got["m0"].coverage_pass) == (2, 1, 2, 1.0, True, True)
    assert got["m0"].worst_size == 1.2 and got["m0"].size == pytest.approx(1.2 ** (1 / 3))
    assert (got["m3"].wins, got["m3"].ties, got["m3"].size_pass, got["m3"].coverage_pass) == (1, 2, False, False) and got["m3"].worst_coverage == 0.8


@pytest.mark.parametrize("flaw", [[("m0", "a", 1, 2, 1, 1)], [("m0", "a", 1, 2, 1, 1)] * 2 + [("m0", "b", 1, 2, 1, 1)], [("m0", x, 1, 2, 1, 1) for x in "abc"], [("m0", "a", 0, 2, 1, 1), ("m0", "b", 1, 2, 1, 1)], [("m0", "a", 1, 2, 1, 0), ("m0", "b", 1, 2, 1, 0)]])
def test_other_populations_fail(spark, flaw):
    with pytest.raises(PySparkException):
        gates(population(spark, flaw), ["a", "b"]).collect()


def test_profile_lines(spark):
    numbers = "elapsed_ms=5 ram=1 ram_peak=2 temp=3 temp_peak=-4 handles=5 files=6 io=7"
    lines = [f"PROFILE event=end {numbers} ok=true x", f"PROFILE event=two {numbers} ok=true ok=false", f"PROFILE event=plain {numbers}", "PROFILE event=broken ram=1", f" PROFILE event=x {numbers}", "other", f"PROFILE event=odd {numbers} notok=true"]
    got = parse_profile(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.event, r.ok, r.ok_count, r.detail) for r in got] == [("end", True, 1, "ok=true x"), ("two", None, 2, "ok=true ok=false"), ("plain", None, 0, None), (None, None, None, None), ("odd", None, 0, "notok=true")]
    assert [r.malformed for r in got] == [None, None, None, "PROFILE event=broken ram=1", None] and (got[0].elapsed_ms, got[0].temp_peak, got[0].io) == (5, -4, 7)


def test_strict_json(spark):
    assert strict_json('{"a": [1, null, "x"]}') == {"a": [1, None, "x"]}
    bad = ['{"a": 1, "a": 1}', "NaN", "[Infinity]", "1 2", "{", "", "[" * 100_000]
    for text in bad:
        with pytest.raises(EngineError):
            strict_json(text)
    rows = json_status(spark.createDataFrame([(None,), ("[]",), *((b,) for b in bad[:3])], "t string"), "t").collect()
    assert [r.json_status for r in rows][:2] == [None, "ok"] and all("not strict JSON" in r.json_status for r in rows[2:])
    assert manifest('{"samples": [{"id": "a", "size": 3}]}', {"id": str, "size": int}) == [{"id": "a", "size": 3}]
    for text in ('{"samples": 1}', "[]", '{"samples": [{"id": "a", "size": true}]}', '{"samples": [{"id": "a", "size": 1}, {"id": "a", "size": 1}]}', '{"samples": [1]}'):
        with pytest.raises(EngineError):
            manifest(text, {"id": str, "size": int})


def test_ordinals(spark):
    s = streams(spark.createDataFrame([(1, "a" * 2500), (2, "b")], "id long, t string"), "id", "t")
    assert [(r.stream_id, r.ordinal, r.start) for r in ordinals(blocks(s, 1024).withColumn("end", F.col("start") + F.col("len"))).orderBy("stream_id", "ordinal").collect()] == [(1, 0, 0), (1, 1, 1024), (1, 2, 2048), (2, 0, 0)]


def test_disorder_of_arrivals(spark):
    rows = [("2024-01-01 00:00:01", "a", 1), ("2024-01-01 00:00:02", "a", 3), ("2024-01-01 00:00:03", "a", 2), ("2024-01-01 00:00:04", "a", 3), ("2024-01-01 00:00:05", "a", None), ("2024-01-01 00:00:06", "a", 9), ("2024-01-01 00:00:01", "b", 7)]
    df = spark.createDataFrame(rows, "ts string, k string, p long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.k, r.n, r.rejected, r.disordered) for r in arrival_violations(df, "k", "p").collect()) == [("a", 6, 1, 2), ("b", 1, 0, 0)]


def test_a_key_is_forgotten_behind_the_watermark(spark, tmp_path):
    cfg, text = MatchConfig("m1", target_chunk=64, min_match=16, block_size=4096), " ".join(f"w{i}" for i in range(300))
    frame = lambda rows: spark.createDataFrame(rows, "ts string, doc_id long, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    steps = [[("2024-01-01 00:00:00", 1, text)], [("2024-01-01 00:05:00", 2, text)], [("2024-01-01 09:00:00", 3, "x y")], [("2024-01-01 10:00:00", 4, text)]]
    found = []
    for k, rows in enumerate(steps):
        frame(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("ts timestamp, doc_id long, text string").parquet(str(tmp_path / "in"))
        query = recent_chunks(stream, cfg, "ts", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()
        found.append({r.stream_id for r in spark.read.parquet(str(tmp_path / "out")).collect()})
    assert found[0] == found[1] == {1} and found[-1] == {1, 3, 4}
