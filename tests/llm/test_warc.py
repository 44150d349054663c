import gzip
import hashlib
import io
import json
import os

import duckdb
import pytest

from echofold.llm.registry import ORACLE_SQL
from echofold.llm.warc import archive_round_trip, inflate, mark_revisits, normalise, parse, read_archives, record, split_records, write_archives

SCHEMA = "page_id long, url string, html string, record_type string"


def plain(rows):
    payloads = [(i, (h or "").encode()) for i, h in rows]
    most = {}
    for i, p in payloads:
        if len(p) >= 1000:
            most[p] = max(most.get(p, -1), -1 if i is None else i)
    out = []
    for i, p in payloads:
        again = len(p) >= 1000 and most[p] != i and most[p] >= 0
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", most[p] if again else None))
    return sorted(out, key=repr)


def test_round_trip_with_nulls_ties_and_hot_payloads(spark):
    rows = [(i, "hot" * 400) for i in range(60)] + [(None, "hot" * 400), (100, None), (101, ""), (102, "é" * 500), (103, "é" * 500), (104, "b" * 999), (105, "b" * 999), (106, "c" * 1000), (106, "c" * 1000), (107, "x" * 300_000), (None, "n" * 2000), (None, "n" * 2000)]
    df = spark.createDataFrame([(i, None if i == 5 else f"http://x/\r\n{i}", h, "q") for i, h in rows], SCHEMA)
    assert sorted(map(tuple, archive_round_trip(df).collect()), key=repr) == plain(rows)


def test_given_pages_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(map(tuple, archive_round_trip(spark.read.parquet(f"{sf}/pages.parquet")).collect())) == sorted(con.sql(ORACLE_SQL["op8_warc"]).fetchall())


def test_files_members_and_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i % 3}</p>" * 200, "q") for i in range(20)], SCHEMA).coalesce(2)
    files = write_archives(mark_revisits(df), f"file://{tmp_path}/raw")
    for f in files.collect():
        data = open(f.path.removeprefix("file://"), "rb").read()
        assert len(list(split_records([gzip.decompress(data)]))) == f.n
    members = normalise(files, f"file://{tmp_path}/new")
    rows = members.collect()
    assert len(rows) == 20
    for m in rows:
        with open(m.path.removeprefix("file://"), "rb") as f:
            f.seek(m.pos)
            fields, block = parse(gzip.decompress(f.read(m.length)))
        lines = [json.loads(x) for x in open(m.path.removeprefix("file://") + ".idx")]
        assert {"offset": m.pos, "length": m.length, "type": fields["warc-type"], "page_id": fields["x-page-id"]} in lines
        assert os.path.getsize(m.path.removeprefix("file://")) == sum(x["length"] for x in lines)
        assert fields["warc-type"] == "revisit" and block.endswith(b"\r\n\r\n") or int(fields["x-payload-length"]) == len(block.partition(b"\r\n\r\n")[2])
    assert read_archives(members).where("record_type = 'revisit'").count() == 17


def test_damage_is_not_passed_over():
    r = record(1, "u", b"payload", "response", None, 7, hashlib.sha1(b"payload").hexdigest())
    assert list(split_records([r[:10], r[10:] + r])) == [r, r]
    for bad in ([r[:-3]], [r + b"x"], [b"junk\r\n\r\n"]):
        with pytest.raises(ValueError):
            list(split_records(bad))
    two = gzip.compress(r) + gzip.compress(r)
    assert b"".join(inflate(io.BytesIO(two), 7)) == r + r


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert archive_round_trip(df).count() == 0
