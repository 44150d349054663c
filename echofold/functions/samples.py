"""Reproducible byte streams with known repeats, to compare finders on.

Sizes, seeds, markers and recipe names are fixed values: other writers of these samples use
the same, and the digests of the streams tell whether two sets are equal.
"""

from __future__ import annotations

import numpy as np

KIB = 1 << 10
#: The samples: id -> (recipe, bytes, seed); fixed values.
SAMPLES = {
    f"{i:02d}": (recipe, size * KIB, 0x4100 + i - 1)
    for i, (recipe, size) in enumerate(
        [
            ("exact-repeat", 256), ("nonaligned-repeat", 512), ("insert-delete", 512), ("order1", 512), ("far-distance", 2048), ("multiversion-tree", 512),
            ("vm-disk-sparse", 512), ("compressed-block-repeat", 512), ("random-incompressible", 256), ("exact-repeat", 512), ("nonaligned-repeat", 512), ("multiversion-tree", 768),
        ],
        1,
    )
}
#: The linear congruential generator, and what its seed is combined with; fixed values.
FACTOR, STEP, WHITEN = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15


def noise(size: int, seed: int) -> bytes:
    """The fifth lowest byte of each state after the first; all states at once, as sums of powers modulo 2**64."""
    powers = np.multiply.accumulate(np.full(size, FACTOR, np.uint64))
    sums = np.add.accumulate(np.concatenate([[np.uint64(1)], powers[:-1]])) if size else powers
    states = powers * np.uint64((seed ^ WHITEN) & 0xFFFFFFFFFFFFFFFF) + sums * np.uint64(STEP)
    return (states >> np.uint64(32)).astype(np.uint8).tobytes()


def _cycled(size: int, period: bytes, lead: bytes = b"") -> bytes:
    return lead + np.resize(np.frombuffer(period, np.uint8), size - len(lead)).tobytes()


def _insert_delete(size: int, seed: int) -> bytes:
    """Four equal blocks, the same with an insertion in place of what precedes the middle, and the first again."""
    whole = 4 * noise(32 * KIB, seed)
    middle = len(whole) // 2
    changed = whole[: middle - 911] + b"INSERTED-REGION-v2\0" + noise(1237, seed + 1) + whole[middle:]
    return (whole + changed + whole)[:size].ljust(size, b"\0")


def _order1(size: int, seed: int) -> bytes:
    """Pairs of a state of five bits and its successor, whose rule changes each 4,096 pairs."""
    rules = [[(7 * x + 3 + phase) % 32 for x in range(32)] for phase in range(4)]
    path = [seed % 32]
    for i in range(size // 2):
        path.append(rules[i // 4096 % 4][path[-1]])
    each = np.array(path, np.uint8)
    return np.stack([each[:-1], each[1:]], axis=1).tobytes()[:size]


def _far(size: int, seed: int) -> bytes:
    end = noise(256 * KIB, seed)
    return end + noise(size - 2 * len(end), seed + 4) + end


def _tree(size: int, seed: int) -> bytes:
    """Versions of a tree of 32 blocks, each plain, inverted in every other bit, or turned by a byte."""
    plain = noise(4 * KIB, seed)
    kinds = {"p": plain, "x": bytes(b ^ 0x55 for b in plain), "t": plain[1:] + plain[:1]}
    versions = []
    for number, pattern in enumerate(("ppxp", "ptxp", "tptx"), 1):
        tree = b"".join(b"TREE-BLOCK" + i.to_bytes(2, "little") + len(plain).to_bytes(4, "little") + kinds[k] for i, k in enumerate(8 * pattern))
        versions.append(b"VERSION-%02d\0" % number + tree)
    return b"".join([*versions, versions[1]])[:size].ljust(size, b"\0")


def _sparse(size: int, seed: int) -> bytes:
    """Zeros with a marker at each 128 KiB."""
    return b"".join((b"VM-DISK-EXTENT-%08x-%08x\0" % (seed, at)).ljust(128 * KIB, b"\0") for at in range(0, size, 128 * KIB))[:size]


def _opaque(size: int, seed: int) -> bytes:
    """A block of noise behind a header of 16 bytes, again and again."""
    body = noise(64 * KIB - 16, seed)
    return _cycled(size, b"CBLKOPAQ" + len(body).to_bytes(4, "little") + (64 * KIB).to_bytes(4, "little") + body)


RECIPES = {
    "exact-repeat": lambda size, seed: _cycled(size, noise(64 * KIB, seed)),
    "nonaligned-repeat": lambda size, seed: _cycled(size, noise(64 * KIB, seed), noise(173, seed + 1)),
    "insert-delete": _insert_delete,
    "order1": _order1,
    "far-distance": _far,
    "multiversion-tree": _tree,
    "vm-disk-sparse": _sparse,
    "compressed-block-repeat": _opaque,
    "random-incompressible": noise,
}


def sample(name: str) -> bytes:
    recipe, size, seed = SAMPLES[name]
    return RECIPES[recipe](size, seed)
