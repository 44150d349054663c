"""The self-contained container of one payload: literals once, repeats as references, digests over both.

Layouts: ``index`` keeps all references in one table behind the blocks; ``future`` keeps each
at the block of its source; ``io`` keeps them in place. The marks that containers begin and
end with, and the labels that the digests begin with, are parameters (``Marks``): give those
of another writer of this format to exchange containers with it.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np

from .config import CHECKSUMS, LAYOUTS, MATCH_COST, METHODS, MOST_POSITION, MatchConfig, Overlay
from .errors import EngineError
from .hashing import crc32c, digest

#: Header: mark, version, flags, checksum, layout, method, overlay flag, reserved, and eight numbers. Fixed format.
HEADER = struct.Struct("<8s6BH8Q")
TAIL = struct.Struct("<8s2BH4Q")
WIDTH = {"xxh3": 16, "blake3": 32}
VERSION = 3
Match = tuple[int, int, int]


@dataclass(frozen=True)
class Marks:
    header: bytes = b"ECHOFLD\0"
    tail: bytes = b"ECHOFLDT"
    plaintext: bytes = b"ECHOFLD-PLAINTEXT\0"
    encoded: bytes = b"ECHOFLD-ENCODED\0"
    retired: tuple[bytes, ...] = ()
    legacy: tuple[bytes, ...] = ()


@dataclass
class Archive:
    """What a container holds."""

    config: MatchConfig
    payload: bytes
    matches: list[Match]
    archive_length: int
    body_end: int
    index_length: int


def put_varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def sniff(data: bytes, marks: Marks = Marks()) -> str:
    """own, retired, legacy, truncated or corrupt, from the first bytes."""
    if len(data) < 8:
        return "truncated" if any(m.startswith(data) for m in (marks.header, *marks.retired, *marks.legacy)) else "corrupt"
    if data[:8] == marks.header:
        return "own"
    if any(data.startswith(m) for m in marks.retired):
        return "retired"
    return "legacy" if any(data.startswith(m) for m in marks.legacy) else "corrupt"


def _block_of(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def _gaps(matches: list[Match], lo: int, hi: int) -> list[tuple[int, int]]:
    """Parts of [lo, hi) that no match covers; matches are in destination order."""
    out, at = [], lo
    k = max(0, bisect_right(matches, lo, key=lambda m: m[1]) - 1)
    while k < len(matches) and matches[k][1] < hi:
        _, dst, n = matches[k]
        if dst > at:
            out.append((at, dst))
        at = max(at, min(hi, dst + n))
        k += 1
    if at < hi:
        out.append((at, hi))
    return out


def encode(payload: bytes, matches: list[Match], cfg: MatchConfig, marks: Marks = Marks()) -> bytes:
    """The container of ``payload`` with ``matches`` (src, dst, len), which have to be true and free of overlaps."""
    n, width = len(payload), WIDTH[cfg.checksum]
    matches = sorted(matches, key=lambda m: (m[1], m[0], -m[2]))
    check_matches(matches, n, cfg)
    o = cfg.overlay
    seed = {"m0": cfg.min_match, "m1": 48, "m2": 0}.get(cfg.method, cfg.seed)
    out = bytearray(HEADER.pack(marks.header, VERSION, 0, CHECKSUMS[cfg.checksum], LAYOUTS[cfg.layout], METHODS[cfg.method], int(o is not None), 0, cfg.block_size, cfg.min_match, seed, cfg.target_chunk or 0, cfg.distance_cap, o.distance if o else 0, o.min_match if o else 0, n))
    owned: dict[int, list[Match]] = {}
    for m in sorted(matches):
        owned.setdefault(m[0] // cfg.block_size, []).append(m)
    starts = [m[1] for m in matches]
    for k, (lo, hi) in enumerate(_block_of(n, cfg.block_size)):
        gaps = _gaps(matches, lo, hi)
        if cfg.layout == "future":
            mine = owned.get(k, [])
            out += put_varint(len(mine))
            for src, dst, size in mine:
                out += put_varint(src - lo) + put_varint(dst - src) + put_varint(size)
        if cfg.layout == "io":
            begun = range(bisect_left(starts, lo), bisect_left(starts, hi))
            for at, end, i in sorted([*((a, e, -1) for a, e in gaps), *((starts[i], 0, i) for i in begun)]):
                if i >= 0:
                    src, dst, size = matches[i]
                    out += b"\1" + put_varint(dst - src) + put_varint(size)
                else:
                    out += b"\0" + put_varint(end - at) + payload[at:end]
        else:
            for at, end in gaps:
                out += payload[at:end]
        out += struct.pack("<I", crc32c(payload[lo:hi]))
    body_end, index = len(out), 0
    if cfg.layout == "index":
        out += put_varint(len(matches))
        last = 0
        for src, dst, size in matches:
            out += put_varint(dst - last) + put_varint(dst - src) + put_varint(size)
            last = dst + size
        index = len(out) - body_end
    length = len(out) + TAIL.size + 2 * width
    out += TAIL.pack(marks.tail, VERSION, 0, 0, length, body_end if index else 0, index, body_end)
    out += digest(cfg.checksum, marks.plaintext, payload)
    out += digest(cfg.checksum, marks.encoded, bytes(out))
    return bytes(out)


def check_matches(matches: list[Match], n: int, cfg: MatchConfig) -> None:
    last = 0
    for src, dst, size in matches:
        ok = 0 <= src < dst and size > MATCH_COST and size >= cfg.effective_min_match and dst + size <= n and last <= dst
        if not ok or cfg.distance_cap and dst - src > cfg.distance_cap:
            raise EngineError("InvalidMatch", f"({src}, {dst}, {size})")
        last = dst + size


class _Reader:
    def __init__(self, data: bytes, at: int, end: int, broken: str):
        self.data, self.at, self.end, self.broken = data, at, end, broken

    def take(self, n: int) -> bytes:
        if self.at + n > self.end:
            raise EngineError("TruncatedArchive" if self.end == len(self.data) else self.broken, f"{n} bytes at {self.at}")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        v = shift = 0
        while True:
            b = self.take(1)[0]
            v |= (b & 127) << shift
            shift += 7
            if b < 128:
                if v > MOST_POSITION or shift > 7 and b == 0:
                    raise EngineError(self.broken, "a number is too large or not in its shortest form")
                return v
            if shift >= 63:
                raise EngineError(self.broken, "a number is too long")


def parse_header(data: bytes, marks: Marks = Marks()) -> tuple[MatchConfig, int]:
    """The parameters and the payload's length."""
    kind = sniff(data, marks)
    if kind in ("retired", "legacy"):
        raise EngineError("UnsupportedVersion", kind)
    if kind == "truncated" or kind == "own" and len(data) < HEADER.size:
        raise EngineError("TruncatedArchive", "header")
    if kind != "own":
        raise EngineError("CorruptHeader", "unknown mark")
    _, version, flags, check, layout, method, own, reserved, block, least, seed, chunk, cap, rep_d, rep_m, n = HEADER.unpack_from(data)
    if version != VERSION:
        raise EngineError("UnsupportedVersion", str(version))
    names = lambda table, v: next((k for k, x in table.items() if x == v), None)
    if names(CHECKSUMS, check) is None:
        raise EngineError("UnknownChecksum", str(check))
    if flags or reserved or own > 1 or names(LAYOUTS, layout) is None or names(METHODS, method) is None or n > MOST_POSITION or not own and (rep_d or rep_m):
        raise EngineError("CorruptHeader", "a field is out of range")
    m = names(METHODS, method)
    try:
        cfg = MatchConfig(m, names(LAYOUTS, layout), names(CHECKSUMS, check), block, least, seed if m in ("m3", "m4") else None, chunk or None, cap or None, Overlay(rep_m, rep_d) if own else None)
    except EngineError as e:
        raise EngineError("CorruptHeader", e.detail) from e
    if seed != {"m0": least, "m1": 48, "m2": 0}.get(m, cfg.seed) or m not in ("m1", "m2") and chunk:
        raise EngineError("CorruptHeader", "seed size or target chunk")
    return cfg, n


def _tail(data: bytes, cfg: MatchConfig, marks: Marks) -> tuple[int, int, int, bytes, bytes]:
    """(tail start, index offset, index length, plaintext digest, encoded digest)."""
    width = WIDTH[cfg.checksum]
    start = len(data) - TAIL.size - 2 * width
    if start < HEADER.size:
        raise EngineError("TruncatedArchive", "tail")
    mark, version, flags, reserved, length, offset, total, body_end = TAIL.unpack_from(data, start)
    if mark != marks.tail or version != VERSION or flags or reserved or length != len(data):
        raise EngineError("CorruptRecord", "tail")
    if cfg.layout == "index":
        if not HEADER.size <= offset <= start or total < 1 or offset + total != start:
            raise EngineError("CorruptIndex", "place of the table")
        if body_end != offset:
            raise EngineError("CorruptRecord", "end of the blocks")
    else:
        if offset or total:
            raise EngineError("CorruptIndex", "a table where the layout has none")
        if body_end != start:
            raise EngineError("CorruptRecord", "end of the blocks")
    at = start + TAIL.size
    return start, offset, total, data[at : at + width], data[at + width :]


def _read_index(data: bytes, offset: int, total: int, cfg: MatchConfig, n: int) -> list[Match]:
    r = _Reader(data, offset, offset + total, "CorruptIndex")
    count = r.varint()
    if count > min(n // cfg.effective_min_match, n // (MATCH_COST + 1), total // 3):
        raise EngineError("CorruptIndex", "more matches than the payload can hold")
    out, last = [], 0
    for _ in range(count):
        gap, distance, size = r.varint(), r.varint(), r.varint()
        out.append((last + gap - distance, last + gap, size))
        last += gap + size
    if r.at != offset + total:
        raise EngineError("CorruptIndex", "bytes behind the table")
    check_matches(out, n, cfg)
    return out


def _copy(history: np.ndarray, src: int, dst: int, at: int, n: int) -> None:
    """Writes [at, at + n) of the match dst <- src; a source that reaches its own copy repeats."""
    distance, offset = dst - src, at - dst
    if offset + n <= distance:
        history[at : at + n] = history[src + offset : src + offset + n]
    else:
        period = history[src:dst]
        history[at : at + n] = np.resize(np.roll(period, -(offset % distance)), n)


def decode(data: bytes, marks: Marks = Marks(), output_limit: int = MOST_POSITION) -> Archive:
    """The verified payload and matches of a container; any flaw raises an ``EngineError`` that tells its kind."""
    cfg, n = parse_header(data, marks)
    if n > output_limit:
        raise EngineError("OutputLimitExceeded", str(n))
    width, known = WIDTH[cfg.checksum], None
    end = len(data) - TAIL.size - 2 * width
    if cfg.layout == "index":
        end, offset, total, *_ = _tail(data, cfg, marks)
        known, end = _read_index(data, offset, total, cfg, n), offset
    r = _Reader(data, HEADER.size, len(data) if cfg.layout != "index" else end, "CorruptRecord")
    if n > 0 and n // max(1, cfg.block_size) > len(data):
        raise EngineError("TruncatedArchive", "blocks")
    try:
        history = np.zeros(n, np.uint8)
    except MemoryError as e:
        raise EngineError("MemoryBudgetExceeded", str(n)) from e
    matches: list[Match] = list(known or [])
    pending: list[Match] = []  # of future, not yet begun: a heap of (dst, src, -len)
    carried: Match | None = None
    k = 0
    for lo, hi in _block_of(n, cfg.block_size):
        at = lo
        if cfg.layout == "future":
            for _ in range(r.varint()):
                offset, distance, size = r.varint(), r.varint(), r.varint()
                if offset >= hi - lo or distance == 0:
                    raise EngineError("InvalidMatch", "register")
                check_matches([(lo + offset, lo + offset + distance, size)], n, cfg)
                heappush(pending, (lo + offset + distance, lo + offset, -size))
        while at < hi:
            if carried is None:
                if cfg.layout == "io":
                    tag = r.take(1)[0]
                    if tag == 1:
                        distance, size = r.varint(), r.varint()
                        carried = (at - distance, at, size)
                        check_matches([carried], n, cfg)
                        matches.append(carried)
                    elif tag == 0:
                        size = r.varint()
                        if not 0 < size <= hi - at or at > lo and literal:  # noqa: F821
                            raise EngineError("CorruptRecord", "literal")
                        history[at : at + size] = np.frombuffer(r.take(size), np.uint8)
                        at += size
                        literal = True  # noqa: F841
                        continue
                    else:
                        raise EngineError("CorruptRecord", "operation")
                else:
                    if cfg.layout == "index":
                        start = matches[k][1] if k < len(matches) else n
                    else:
                        start = pending[0][0] if pending else n
                    if start < at:
                        raise EngineError("InvalidMatch", "matches overlap")
                    if start > at:
                        size = min(start, hi) - at
                        history[at : at + size] = np.frombuffer(r.take(size), np.uint8)
                        at += size
                        continue
                    if cfg.layout == "index":
                        carried = matches[k]
                        k += 1
                    else:
                        dst, src, size = heappop(pending)
                        carried = (src, dst, -size)
                        matches.append(carried)
            literal = False
            src, dst, size = carried
            take = min(dst + size, hi) - at
            _copy(history, src, dst, at, take)
            at += take
            if at == dst + size:
                carried = None
        if struct.unpack("<I", r.take(4))[0] != crc32c(history[lo:hi].tobytes()):
            raise EngineError("ChecksumMismatch", f"block at {lo}")
    if pending or carried:
        raise EngineError("CorruptRecord", "a match is not complete")
    start, offset, total, plain, encoded = _tail(data, cfg, marks)
    if r.at != (offset if cfg.layout == "index" else start):
        raise EngineError("CorruptRecord", "bytes behind the blocks")
    payload = history.tobytes()
    if digest(cfg.checksum, marks.plaintext, payload) != plain:
        raise EngineError("ChecksumMismatch", "payload")
    if digest(cfg.checksum, marks.encoded, data[: len(data) - width]) != encoded:
        raise EngineError("ChecksumMismatch", "container")
    return Archive(cfg, payload, matches, len(data), offset or start, total)
