"""Containers: exact round trips in all layouts, and every flaw found."""

import random

import pytest

from echofold.functions.config import CHECKSUMS, LAYOUTS, MatchConfig, Overlay
from echofold.functions.container import HEADER, Marks, decode, encode, parse_header, put_varint, sniff
from echofold.functions.errors import EngineError

from .test_kernels import best


def samples():
    r = random.Random(2)
    yield b""
    yield b"abc"
    yield bytes(3000)
    for _ in range(12):
        base = [r.randbytes(r.randint(30, 300)) for _ in range(4)]
        yield b"".join(r.choice(base) for _ in range(r.randint(1, 30)))


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("method", ["m0", "m3", "m4", "m5"])
def test_round_trip(layout, method):
    seed = {"seed_size": 16} if method in ("m3", "m4") else {}
    for data in samples():
        cfg = MatchConfig(method, layout=layout, block_size=1024, min_match=32, **seed)
        _, matches = best(data, cfg)
        a = decode(encode(data, matches, cfg))
        assert a.payload == data and sorted(a.matches) == sorted(matches) and a.config == cfg


def test_layouts_hold_the_same_matches():
    data = b"".join(samples())
    made = []
    for layout in LAYOUTS:
        cfg = MatchConfig("m4", layout=layout, block_size=1024, min_match=32, seed_size=16)
        _, matches = best(data, cfg)
        made.append(sorted(decode(encode(data, matches, cfg)).matches))
    assert made[0] and made[0] == made[1] == made[2]


@pytest.mark.parametrize("checksum", CHECKSUMS)
def test_lengths_of_empty_containers(checksum):
    for layout, extra in (("index", 1), ("future", 0), ("io", 0)):
        size = len(encode(b"", [], MatchConfig(layout=layout, checksum=checksum)))
        assert size == {"xxh3": 156, "blake3": 188}[checksum] + extra


def test_literal_only_bodies():
    for layout, body in (("index", b"abc"), ("future", b"\0abc"), ("io", b"\0\3abc")):
        a = encode(b"abc", [], MatchConfig("m1", layout=layout, block_size=1024))
        assert a[80 : 80 + len(body)] == body


@pytest.mark.parametrize("layout", LAYOUTS)
def test_every_changed_bit_and_every_cut_is_found(layout):
    r = random.Random(3)
    data = r.randbytes(200) * 12
    cfg = MatchConfig("m4", layout=layout, block_size=1024, min_match=32, seed_size=16)
    _, matches = best(data, cfg)
    a = encode(data, matches, cfg)
    for i in range(len(a)):
        b = bytearray(a)
        b[i] ^= 1 << r.randrange(8)
        with pytest.raises(EngineError):
            decode(bytes(b))
        with pytest.raises(EngineError):
            decode(a[:i])
    with pytest.raises(EngineError):
        decode(a + b"\0")


def kind(data, **options):
    with pytest.raises(EngineError) as e:
        decode(data, **options)
    return e.value.kind


def test_kinds_of_errors():
    cfg = MatchConfig("m4", min_match=32, seed_size=16)
    a = bytearray(encode(b"x" * 100, [(0, 1, 99)], cfg))
    put = lambda at, v: bytes(a[:at]) + bytes([v]) + bytes(a[at + 1 :])
    assert kind(put(8, 4)) == "UnsupportedVersion" and kind(put(9, 1)) == "CorruptHeader" and kind(put(10, 9)) == "UnknownChecksum"
    assert kind(put(len(a) - 76 + 8, 9)) == "CorruptRecord" and kind(put(40, 1)) in ("CorruptHeader", "ChecksumMismatch")
    assert kind(put(len(a) - 1, a[-1] ^ 1)) == "ChecksumMismatch" and kind(bytes(a[:40])) == "TruncatedArchive" and kind(b"nonsense!") == "CorruptHeader"
    assert kind(bytes(a), output_limit=99) == "OutputLimitExceeded"
    for bad in ([(0, 0, 50)], [(0, 1, 20)], [(0, 1, 100)], [(0, 1, 40), (0, 30, 40)]):
        with pytest.raises(EngineError) as e:
            encode(b"x" * 100, bad, cfg)
        assert e.value.kind == "InvalidMatch"


def test_marks_and_varints():
    marks = Marks(b"OTHERMK\0", b"OTHERTL\0", b"P\0", b"E\0", (b"RETIRED\0",), (b"OLD0",))
    a = encode(b"abc", [], MatchConfig(), marks)
    assert decode(a, marks).payload == b"abc" and kind(a) == "CorruptHeader"
    assert [sniff(x, marks) for x in (a, b"RETIRED\0....", b"OLD0........", b"", b"OTH", b"zzzzzzzzz")] == ["own", "retired", "legacy", "truncated", "truncated", "corrupt"]
    assert kind(b"RETIRED\0....", marks=marks) == "UnsupportedVersion"
    assert [put_varint(v) for v in (0, 127, 128, 16384)] == [b"\0", b"\x7f", b"\x80\1", b"\x80\x80\1"] and HEADER.size == 80
    cfg = MatchConfig("m5", overlay=Overlay(64, 4096), max_distance=77)
    assert parse_header(encode(b"", [], cfg)) == (cfg, 0)
