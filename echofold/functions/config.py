"""The parameters of a search, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .errors import EngineError

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
MOST_POSITION = 2**63 - 1
#: A reference costs as much as this many literal bytes: shorter matches never pay.
MATCH_COST = 25
#: Names and aliases of the methods, layouts and digests with their numbers; fixed values.
METHODS = {"m0": 0, "m1": 1, "m2": 2, "m3": 3, "m4": 4, "m5": 5}
METHOD_ALIASES = {"rep": "m0", "rolling-cdc": "m1", "order1-cdc": "m2", "fixed-digest": "m3", "reread": "m4", "exhaustive": "m5"}
LAYOUTS = {"index": 1, "future": 2, "io": 3}
CHECKSUMS = {"xxh3": 1, "blake3": 2}


def _require(ok: bool, detail: str) -> None:
    if not ok:
        raise EngineError("InvalidConfiguration", detail)


def parse_size(text: str) -> int:
    """``4096``, ``4KiB``, ``2m``, ``1g``: binary units in any case, no fractions, no spaces."""
    m = re.fullmatch(r"(\d+)(?:(k|m|g|t)(?:i?b)?|b)?", text, re.I | re.A)
    _require(m is not None, f"size {text!r}")
    value = int(m[1]) << {"k": 10, "m": 20, "g": 30, "t": 40}.get((m[2] or "").lower(), 0)
    _require(value <= MOST_POSITION, f"size {text!r} is too large")
    return value


def parse_method(text: str) -> str:
    name = METHOD_ALIASES.get(text.lower(), text.lower())
    _require(name in METHODS, f"method {text!r}")
    return name


@dataclass(frozen=True)
class Overlay:
    """Candidates of m0 added to those of m3, m4 or m5."""

    min_match: int = 512
    distance: int = 512 * MIB

    def __post_init__(self):
        _require(2 <= self.min_match <= GIB, "overlay minimum match is 2 to 1 GiB")
        _require(0 < self.distance <= MOST_POSITION, "overlay distance is positive")


@dataclass(frozen=True)
class MatchConfig:
    """``min_match``, ``seed_size`` and ``target_chunk`` default by method; ``max_distance`` None or 0 is no limit."""

    method: str = "m3"
    layout: str = "index"
    checksum: str = "xxh3"
    block_size: int = 8 * MIB
    min_match: int | None = None
    seed_size: int | None = None
    target_chunk: int | None = None
    max_distance: int | None = None
    overlay: Overlay | None = None
    output_limit: int = field(default=MOST_POSITION)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("method", parse_method(self.method))
        chunked, seeded = self.method in ("m1", "m2"), self.method in ("m3", "m4")
        if self.min_match is None:
            put("min_match", 32 if chunked else 512)
        if self.seed_size is None and seeded:
            put("seed_size", 512)
        if self.target_chunk is None and chunked:
            put("target_chunk", 4096)
        _require(self.layout in LAYOUTS, f"layout {self.layout!r}")
        if self.checksum not in CHECKSUMS:
            raise EngineError("UnknownChecksum", repr(self.checksum))
        _require(KIB <= self.block_size <= GIB, "block size is 1 KiB to 1 GiB")
        _require(2 <= self.min_match <= GIB, "minimum match is 2 to 1 GiB")
        _require(0 <= (self.max_distance or 0) <= MOST_POSITION, "maximum distance is out of range")
        _require(seeded or self.seed_size is None, f"{self.method} takes no seed size")
        _require(chunked or self.target_chunk is None, f"{self.method} takes no target chunk")
        _require(not seeded or 1 <= self.seed_size <= GIB, "seed size is 1 to 1 GiB")
        _require(not chunked or 32 <= self.target_chunk <= GIB and self.target_chunk >= self.min_match, "target chunk is 32 to 1 GiB and at least the minimum match")
        _require(self.overlay is None or self.method in ("m3", "m4", "m5"), f"{self.method} takes no overlay")
        _require(0 < self.output_limit <= MOST_POSITION, "output limit is positive")

    @property
    def distance_cap(self) -> int:
        """0 for none."""
        return self.max_distance or 0

    @property
    def effective_min_match(self) -> int:
        return min(self.min_match, self.overlay.min_match) if self.overlay else self.min_match

    @property
    def seed(self) -> int:
        """Bytes that a seed of the method spans."""
        return {"m0": max(1, self.min_match // 8), "m1": 48, "m2": 0, "m5": exhaustive_seed(self.min_match)}.get(self.method, self.seed_size)


def exhaustive_seed(min_match: int) -> int:
    """The largest power of two of which every run of ``min_match`` bytes holds a whole aligned piece."""
    return 1 << ((min_match + 1).bit_length() - 2)
