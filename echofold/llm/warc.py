"""WARC archives: written as whole-file gzip, normalised to a gzip member per record, read back by index.

``write_archives`` writes a record per page, many to a file, each file one gzip stream: it can
only be read from its start. ``normalise`` inflates such a stream once, in pieces of bounded
size, writes every record as a member of its own and beside the archive an index of their
offsets. ``read_archives`` then takes single members by that index.

A task that is run again writes files of new names; the tables of files and records name only
those of the attempt that succeeded. Files lie in the shared folder and are opened through
``pyarrow.fs``, so that can be any store it knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, scratch, short_batches, stash

END = b"\r\n"
PIECE, LEVEL, SALTS = 1 << 20, 4, 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "path string, pos long, length long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 1_000) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest id
    is the response and the others revisit it; all others are responses. Rows that share that
    id are all responses, as are rows with null ids only. Null html is the empty payload.

    A payload that a third of all pages share would gather in one task of the join; the rows
    of the other side, one per repeated payload, are therefore copied to ``SALTS`` salts.
    """
    new = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = pages.drop(*new)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    full = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    large = F.col("payload_bytes") >= least_bytes
    most = (
        full.where(large)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max(id_col).cast("long").alias("__most"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .select(F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"), "__most", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    )
    salted = full.withColumn("__own", F.pmod(F.hash(F.lit(3), id_col), F.lit(SALTS)))
    joined = salted.join(most, (F.col("payload_digest") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__bytes")) & (F.col("__own") == F.col("__salt")) & large, "left")
    again = F.col("__most").isNotNull() & ~F.col("__most").eqNullSafe(F.col(id_col).cast("long"))
    return joined.select(*pages.columns, "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("__most")).alias("refers_to"))


def _line(name: str, value) -> bytes:
    clean = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in str(value))
    return f"{name}: {clean}".encode("utf-8", "replace") + END


def record(page_id, url, payload: bytes, kind: str, refers_to, payload_bytes: int, digest: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head only; its payload's length and digest are in its own head."""
    head = b"WARC/1.1" + END + _line("WARC-Type", kind)
    head += _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{kind}')}>") + _line("WARC-Date", date)
    if url is not None:
        head += _line("WARC-Target-URI", url)
    if page_id is not None:
        head += _line("X-Page-Id", page_id)
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()) + _line("X-Payload-Length", payload_bytes)
    if kind == "revisit":
        head += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("X-Refers-To-Page-Id", refers_to)
        head += _line("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:response')}>")
    block = _HTTP + (payload if kind == "response" else b"")
    return head + _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(block)) + END + block + END + END


def parse(data: bytes) -> tuple[dict, bytes]:
    """Heads (names in lower case) and block of one record."""
    head, _, rest = data.partition(END + END)
    lines = head.split(END)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n + 4:
        raise ValueError("a record is cut off")
    return fields, rest[:n]


def split_records(pieces):
    """The records of an inflated stream that comes in pieces; holds a record and a piece at most."""
    held = bytearray()
    pieces = iter(pieces)
    more = True
    while more or held:
        end = held.find(END + END)
        need = None
        if end >= 0:
            fields = bytes(held[:end]).lower().split(END)
            length = next((int(x.partition(b":")[2]) for x in fields if x.startswith(b"content-length:")), None)
            if length is None:
                raise ValueError("a record without a length")
            need = end + 4 + length + 4
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            continue
        piece = next(pieces, None)
        if piece is None:
            if held:
                raise ValueError("a record is cut off")
            return
        held += piece


def inflate(source, piece: int = PIECE):
    """A gzip file's bytes in pieces; members that follow each other count as one stream."""
    d = zlib.decompressobj(31)
    while data := source.read(piece):
        while data:
            out = d.decompress(data, piece)
            if out:
                yield out
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
            else:
                data = d.unconsumed_tail
    if out := d.flush():
        yield out


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def _name(folder: str, ending: str) -> str:
    t = TaskContext.get()
    return f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}{ending}"


def write_archives(marked: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the rows of ``mark_revisits`` into ``folder``, a file of one gzip stream per task; returns (path, n)."""

    def run(batches):
        out, n, path = None, 0, ""
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path = _name(folder, ".warc.gz")
                    store, at = _open(path)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out, z = store.open_output_stream(at, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(z.compress(record(r["id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"])))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    url = F.col(url_col).cast("string") if url_col in marked.columns else F.lit(None).cast("string")
    rows = marked.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), "record_type", "refers_to", "payload_bytes", "payload_digest")
    return stash(rows.mapInArrow(run, "path string, n long"), "archives")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites the gzip files of ``files`` (path) into ``folder``, a member per record; returns (path, pos, length).

    Each file is read once from start to end. Beside it lies ``<file>.idx``: a JSON line with
    offset, length, type and page id for each record.
    """

    def run(batches):
        for b in batches:
            for source in b["path"].to_pylist():
                store, at = _open(source)
                path = _name(folder, ".warc.gz")
                target, to = _open(path)
                target.create_dir(to.rsplit("/", 1)[0], recursive=True)
                offsets, lengths, pos = [], [], 0
                with store.open_input_stream(at, compression=None) as f, target.open_output_stream(to, compression=None) as out, target.open_output_stream(to + ".idx", compression=None) as idx:
                    for rec in split_records(inflate(f)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        fields, _ = parse(rec)
                        out.write(member)
                        idx.write((json.dumps({"offset": pos, "length": len(member), "type": fields["warc-type"], "page_id": fields.get("x-page-id")}) + "\n").encode())
                        offsets.append(pos)
                        lengths.append(len(member))
                        pos += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["path", "pos", "length"])

    n = max(1, files.count())
    return stash(files.select("path").repartition(n).mapInArrow(run, "path string, pos long, length long"), "members")


def read_archives(members: DataFrame) -> DataFrame:
    """A row per record of ``members`` (path, pos, length), each inflated alone; a response's digest is checked."""

    def run(batches):
        path, f = None, None
        for b in batches:
            rows = []
            for m in b.to_pylist():
                if m["path"] != path:
                    path = m["path"]
                    store, at = _open(path)
                    f = store.open_input_file(at)
                f.seek(m["pos"])
                fields, block = parse(zlib.decompress(f.read(m["length"]), 31))
                payload, kind = block.partition(END + END)[2], fields["warc-type"]
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(fields["x-payload-length"])
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"a payload in {path} does not match its digest")
                number = lambda k: int(fields[k]) if k in fields else None  # noqa: B023, E731
                rows.append({**m, "page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id")})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RECORD.split(", ")])
    return members.mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read from its archives.

    Writes, normalises and reads back; the whole-file archives are deleted once normalised.
    An empty table writes no file and gives no rows. Further columns are ignored.
    """
    spark: SparkSession = pages.sparkSession
    short_batches(spark)
    raw = scratch(spark, "raw-warc")
    files = write_archives(mark_revisits(pages, **options), raw)
    members = normalise(files, folder or scratch(spark, "warc"))
    drop_path(spark, raw)
    return read_archives(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
