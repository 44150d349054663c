"""Containers of streams: written, read, verified and inspected, a row each."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import MOST_POSITION, MatchConfig
from ..functions.container import Marks, decode, encode, sniff
from ..functions.errors import EngineError
from ..functions.kernels import together


def _rebatched(matches: DataFrame, streams: DataFrame) -> DataFrame:
    """streams with their matches as one array each; both come together by stream id."""
    lists = matches.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("dst", "src", "len"))).alias("matches"))
    return streams.select("stream_id", "payload").join(lists, "stream_id", "left")


def parts(batches, column: str):
    """Batches cut into parts of about ``GROUP`` bytes of ``column``: what is made of one is handed on before the next."""
    for b in batches:
        for r in together(pc.fill_null(pc.binary_length(b[column]), 0).to_pylist()):
            yield b.slice(r.start, len(r))


def write_archives(matches: DataFrame, streams: DataFrame, cfg: MatchConfig, marks: Marks = Marks()) -> DataFrame:
    """(stream_id, archive): the container of each stream."""

    def run(batches):
        for b in parts(batches, "payload"):
            made = [encode(p, [(m["src"], m["dst"], m["len"]) for m in ms or ()], cfg, marks) for p, ms in zip(b["payload"].to_pylist(), b["matches"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["stream_id"], pa.array(made, pa.binary())], ["stream_id", "archive"])

    return _rebatched(matches, streams).mapInArrow(run, "stream_id long, archive binary")


def _each(archives: DataFrame, make, schema: str, marks: Marks, output_limit: int) -> DataFrame:
    def run(batches):
        for b in parts(batches, "archive"):
            rows = []
            for sid, data in zip(b["stream_id"].to_pylist(), b["archive"].to_pylist(), strict=True):
                try:
                    rows += make(sid, data, decode(data or b"", marks, output_limit), None)
                except EngineError as e:
                    rows += make(sid, data, None, e)
            yield pa.RecordBatch.from_pylist(rows, target) if rows else pa.RecordBatch.from_pylist([], target)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    target = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    return archives.select("stream_id", "archive").mapInArrow(run, schema)


def read_archives(archives: DataFrame, *, marks: Marks = Marks(), output_limit: int = MOST_POSITION) -> DataFrame:
    """(stream_id, payload, byte_len, status, code): reconstructed payloads; a broken container gives a row that tells why."""
    make = lambda sid, data, a, e: [{"stream_id": sid, "payload": a.payload if a else None, "byte_len": len(a.payload) if a else None, "status": e.kind if e else "ok", "code": e.code if e else 0}]
    return _each(archives, make, "stream_id long, payload binary, byte_len long, status string, code int", marks, output_limit)


def verify_archives(archives: DataFrame, **options) -> DataFrame:
    """(stream_id, status, code) of each container, read in full."""
    return read_archives(archives, **options).select("stream_id", "status", "code")


def archive_matches(archives: DataFrame, *, marks: Marks = Marks(), output_limit: int = MOST_POSITION) -> DataFrame:
    """(stream_id, origin_match_id, src, dst, len) of intact containers."""
    make = lambda sid, data, a, e: [{"stream_id": sid, "origin_match_id": i, "src": s, "dst": d, "len": n} for i, (s, d, n) in enumerate(sorted(a.matches, key=lambda m: m[1]))] if a else []
    return _each(archives, make, "stream_id long, origin_match_id long, src long, dst long, len long", marks, output_limit)


def inspect_archives(archives: DataFrame, *, marks: Marks = Marks(), output_limit: int = MOST_POSITION) -> DataFrame:
    """A row for each container: parameters, sizes and counts; null where it is broken, with the kind in ``status``."""

    def make(sid, data, a, e):
        row = {"stream_id": sid, "format": sniff(data or b"", marks), "status": e.kind if e else "ok", "archive_size": len(data or b"")}
        if a:
            covered = sum(m[2] for m in a.matches)
            row |= {"method": a.config.method, "layout": a.config.layout, "checksum": a.config.checksum, "block_size": a.config.block_size, "min_match": a.config.min_match, "original_size": len(a.payload)}
            row |= {"block_count": -(-len(a.payload) // a.config.block_size), "semantic_match_count": len(a.matches), "covered_bytes": covered, "literal_bytes": len(a.payload) - covered, "index_size": a.index_length, "payload_size": a.body_end - 80}
        return [row]

    schema = "stream_id long, format string, status string, archive_size long, method string, layout string, checksum string, block_size long, min_match long, original_size long, block_count long, semantic_match_count long, covered_bytes long, literal_bytes long, index_size long, payload_size long"
    return _each(archives, make, schema, marks, output_limit)


def sniff_formats(df: DataFrame, payload_col: str, marks: Marks = Marks()) -> DataFrame:
    """``df`` with ``format``, from the first bytes by expressions alone."""
    head = F.substring(payload_col, 1, 8)
    starts = lambda ms: F.lit(False) if not ms else [F.substring(payload_col, 1, len(m)) == F.lit(m) for m in ms]
    any_of = lambda ms: F.lit(False) if not ms else F.coalesce(F.greatest(*starts(ms), F.lit(False)), F.lit(False))
    known = [marks.header, *marks.retired, *marks.legacy]
    short = F.greatest(*(F.substring(F.lit(m), F.lit(1), F.octet_length(payload_col)) == F.col(payload_col) for m in known), F.lit(False))
    kind = F.when(F.octet_length(payload_col) < 8, F.when(short, "truncated").otherwise("corrupt")).when(head == F.lit(marks.header), "own").when(any_of(marks.retired), "retired").when(any_of(marks.legacy), "legacy").otherwise("corrupt")
    return df.withColumn("format", kind)


#: Checksums of retired headers: id, bytes of the seed, and the digest's width less 16 modulo 256; fixed values.
DESCRIPTORS = {"md5": (0, 0, 0), "none": (1, 0, 0), "sha1": (2, 0, 4), "sha512": (3, 0, 48), "vhash": (4, 32, 0), "siphash": (5, 16, 248)}
#: Layouts by version; fixed values.
RETIRED_LAYOUTS = {1: "io-rounded", 2: "io", 3: "future", 4: "index"}


def retired_headers(df: DataFrame, payload_col: str, mark: bytes) -> DataFrame:
    """``df`` with status, version, checksum, layout, base_len, seed and header_end of retired headers, by expressions alone.

    A header is the ``mark`` of 8 bytes, version, checksum id, seed length and width, the base
    length in little-endian order, and the seed. Of a broken one only ``status`` is told: the
    first rule that it breaks, as a kind of error.
    """
    p = F.col(payload_col)
    byte = lambda i: F.conv(F.hex(F.substring(p, i + 1, 1)), 16, 10).cast("int")
    own = (byte(9), byte(10), byte(11))
    known = [(name, reduce(lambda a, b: a & b, (x == v for x, v in zip(own, d, strict=True)))) for name, d in DESCRIPTORS.items()]
    checksum = reduce(lambda rest, k: F.when(k[1], k[0]).otherwise(rest), known, F.lit(None).cast("string"))
    layout = reduce(lambda rest, v: F.when(byte(8) == v, RETIRED_LAYOUTS[v]).otherwise(rest), RETIRED_LAYOUTS, F.lit(None).cast("string"))
    base = reduce(lambda a, b: a + b, (byte(12 + i).cast("long") * 256**i for i in range(4)))
    status = (
        F.when(F.coalesce(F.octet_length(p), F.lit(0)) < 16, "TruncatedArchive")
        .when(F.substring(p, 1, 8) != F.lit(mark), "CorruptHeader")
        .when(layout.isNull(), "UnsupportedVersion")
        .when(checksum.isNull(), "UnknownChecksum")
        .when((byte(8) <= 2) & (base == 0), "CorruptHeader")
        .when(F.octet_length(p) < 16 + byte(10), "TruncatedArchive")
        .otherwise("ok")
    )
    fields = {"version": byte(8), "checksum": checksum, "layout": layout, "base_len": base, "seed": F.substring(p, F.lit(17), byte(10)), "header_end": (16 + byte(10)).cast("long")}
    return df.withColumn("status", status).withColumns({k: F.when(F.col("status") == "ok", v) for k, v in fields.items()})
