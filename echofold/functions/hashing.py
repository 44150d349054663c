"""Hashes, in numpy over whole payloads where positions matter."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: Base of the polynomial hash modulo 2**64; fixed value.
BASE = 153191
_INVERSE = pow(BASE, -1, 1 << 64)
_CASTAGNOLI = 0x82F63B78


def as_bytes(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint8)


def poly_hash(data: bytes) -> int:
    """Sum of byte * BASE ** (bytes behind it), modulo 2**64."""
    h = 0
    for b in data:
        h = (h * BASE + b) & 0xFFFFFFFFFFFFFFFF
    return h


def powers(n: int, of: int = BASE) -> np.ndarray:
    """of ** 0 .. of ** n, modulo 2**64."""
    if n <= _KEPT:
        return _first_powers(of)[: n + 1]
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: As many powers are kept for the next payload.
_KEPT = 1 << 20


@lru_cache(2)
def _first_powers(of: int) -> np.ndarray:
    out = np.full(_KEPT + 1, of, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    out.flags.writeable = False
    return out


class PrefixHash:
    """The polynomial hash of any range of a payload from two prefix sums."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        self.power = powers(n)
        # with weights BASE ** -i a running sum gives all prefixes at once
        back = powers(n, _INVERSE)
        self.prefix = np.zeros(n + 1, np.uint64)
        if n:
            self.prefix[1:] = np.add.accumulate(s.astype(np.uint64) * back[1:]) * self.power[1:]

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return self.prefix[start + length] - self.prefix[start] * self.power[length]

    def windows(self, length: int) -> np.ndarray:
        """The hash of every window of ``length`` bytes, by start."""
        n = len(self.prefix) - 1 - length + 1
        return self.prefix[length:] - self.prefix[:n] * self.power[length] if n > 0 else np.zeros(0, np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many bytes from ``a`` and from ``b`` on agree, up to ``limit`` each, by halving."""
        lo, hi = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
        while True:
            live = lo < hi
            if not live.any():
                return lo
            mid = np.where(live, (lo + hi + 1) >> 1, lo)
            same = self.at(a, mid) == self.at(b, mid)
            lo, hi = np.where(live & same, mid, lo), np.where(live & ~same, mid - 1, hi)

    def common_back(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many bytes before ``a`` and before ``b`` agree."""
        lo, hi = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
        while True:
            live = lo < hi
            if not live.any():
                return lo
            mid = np.where(live, (lo + hi + 1) >> 1, lo)
            same = self.at(a - mid, mid) == self.at(b - mid, mid)
            lo, hi = np.where(live & same, mid, lo), np.where(live & ~same, mid - 1, hi)


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = (i >> 1) ^ (_CASTAGNOLI if i & 1 else 0)
        out.append(i)
    return out


#: Bytes whose CRC is made by one lookup each.
_PIECE = 1024


@lru_cache(1)
def _crc_places() -> np.ndarray:
    """[k, byte]: the register that ``byte`` leaves with ``_PIECE - 1 - k`` zero bytes behind it."""
    table = np.array(_crc_table(), np.uint32)
    out = np.empty((_PIECE, 256), np.uint32)
    out[-1] = table
    for k in range(_PIECE - 2, -1, -1):
        out[k] = table[out[k + 1] & np.uint32(255)] ^ (out[k + 1] >> np.uint32(8))
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C. It is linear: each byte's part depends on its place only, so the parts of a piece are looked up at once."""
    if len(data) < 4:
        crc, t = 0xFFFFFFFF, _crc_table()
        for b in bytes(data):
            crc = t[(crc ^ b) & 255] ^ (crc >> 8)
        return crc ^ 0xFFFFFFFF
    places, crc = _crc_places(), 0
    head = np.frombuffer(data, np.uint8, len(data) % _PIECE or _PIECE).copy()
    flip = min(4, len(head))
    head[:flip] ^= 255  # the register's first value, as if it stood in the first four bytes
    rest = np.frombuffer(data, np.uint8)[len(head) :]
    if flip < 4:
        rest = rest.copy()
        rest[: 4 - flip] ^= 255
    crc = int(np.bitwise_xor.reduce(places[np.arange(_PIECE - len(head), _PIECE), head]))
    step = np.arange(_PIECE)
    first = [places[i].tolist() for i in range(4)] if len(rest) else []
    for at in range(0, len(rest), 256 * _PIECE):
        rows = rest[at : at + 256 * _PIECE].reshape(-1, _PIECE)
        for own in np.bitwise_xor.reduce(places[step, rows], axis=1).tolist():
            crc = first[0][crc & 255] ^ first[1][crc >> 8 & 255] ^ first[2][crc >> 16 & 255] ^ first[3][crc >> 24] ^ own
    return crc ^ 0xFFFFFFFF


def xxh3_128(data: bytes) -> bytes:
    """XXH3-128 with seed 0: its low, then its high 64 bits, little-endian."""
    import xxhash

    return xxhash.xxh3_128_digest(data)[::-1]


# BLAKE3-256 from its published specification. Constants: the SHA-256 initial state and the message permutation.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _blake3_block(cv, words, counter: int, size: int, flags: int) -> list[int]:
    m32 = 0xFFFFFFFF
    v = [*cv, *_IV[:4], counter & m32, counter >> 32 & m32, size, flags]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS):
            for x, down, left in ((words[2 * k], 16, 12), (words[2 * k + 1], 8, 7)):
                v[a] = (v[a] + v[b] + x) & m32
                y = v[d] ^ v[a]
                v[d] = (y >> down | y << (32 - down)) & m32
                v[c] = (v[c] + v[d]) & m32
                y = v[b] ^ v[c]
                v[b] = (y >> left | y << (32 - left)) & m32
        words = [words[i] for i in _PERMUTATION]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3_256(data: bytes) -> bytes:
    """BLAKE3 with 32 bytes of output; plain Python, so for checking rather than for bulk."""

    def chunk(at: int, counter: int, root: int) -> list[int]:
        cv, part = list(_IV), data[at : at + 1024]
        pieces = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        for k, p in enumerate(pieces):
            last = k == len(pieces) - 1
            flags = (_START if k == 0 else 0) | (_END | root if last else 0)
            cv = _blake3_block(cv, struct.unpack("<16I", p.ljust(64, b"\0")), counter, len(p), flags)
        return cv

    def tree(first: int, count: int, root: int) -> list[int]:
        if count == 1:
            return chunk(first * 1024, first, root)
        left = 1 << ((count - 1).bit_length() - 1)
        words = tree(first, left, 0) + tree(first + left, count - left, 0)
        return _blake3_block(list(_IV), words, 0, 64, _PARENT | root)

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), _ROOT))


def siphash24(data: bytes, key: bytes = bytes(16)) -> int:
    """SipHash-2-4, as published."""
    m64 = 0xFFFFFFFFFFFFFFFF
    k0, k1 = struct.unpack("<2Q", key)
    v0, v1, v2, v3 = k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573
    rotl = lambda x, n: (x << n | x >> (64 - n)) & m64

    def rounds(n: int) -> None:
        nonlocal v0, v1, v2, v3
        for _ in range(n):
            v0 = (v0 + v1) & m64
            v1 = rotl(v1, 13) ^ v0
            v0 = rotl(v0, 32)
            v2 = (v2 + v3) & m64
            v3 = rotl(v3, 16) ^ v2
            v0 = (v0 + v3) & m64
            v3 = rotl(v3, 21) ^ v0
            v2 = (v2 + v1) & m64
            v1 = rotl(v1, 17) ^ v2
            v2 = rotl(v2, 32)

    whole = len(data) // 8 * 8
    for (m,) in struct.iter_unpack("<Q", data[:whole]):
        v3 ^= m
        rounds(2)
        v0 ^= m
    m = int.from_bytes(data[whole:], "little") | (len(data) & 255) << 56
    v3 ^= m
    rounds(2)
    v0 ^= m
    v2 ^= 255
    rounds(4)
    return v0 ^ v1 ^ v2 ^ v3


def digest(checksum: str, *parts: bytes) -> bytes:
    return (xxh3_128 if checksum == "xxh3" else blake3_256)(b"".join(parts))
