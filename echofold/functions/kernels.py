"""Scans and candidate search within payloads, in numpy: many short ones are searched at once.

Positions are byte offsets. A candidate (src, dst, len) says that the ``len`` bytes at ``dst``
are those from ``src`` on, where a source that runs into its own copy goes on periodically;
as the bytes of the payload already are that copy, this is plain equality at distance
dst - src. So for one distance, what can be grown from seeds are the runs of positions that
equal the position a distance behind: each such run is found once, from its first seed.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from .config import MATCH_COST, MatchConfig, exhaustive_seed
from .hashing import PrefixHash, as_bytes

M1_WINDOW = 48
#: Multipliers of the order-1 hash for a byte not predicted, and for one predicted; fixed values.
MISS, HIT = 271828182, 314159265
#: Pairs of seed and target that are looked at together.
PAIRS = 1 << 20
#: Bytes of payloads that are searched at once, about.
GROUP = 1 << 19
#: Bytes that the order-1 hash reads at a time of each block.
STEP = 128
#: Bytes of a block that are read one after the other, the segments of a block side by side.
SEGMENT = 2048
#: Rows that are not worth numpy's calls.
FEW = 3
#: An odd number that spreads hashes over a table: 2**64 by the golden ratio.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


# -- scans ---------------------------------------------------------------------------------


def representatives(h: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, first target that may see it) of each whole region's window of largest hash, ties to the first.

    ``h`` has the unsigned hash of the window at each position. The last, cut off region is
    never seen, as no target lies behind it.
    """
    whole = len(h) // region
    if not whole:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best = h[: whole * region].reshape(whole, region).argmax(axis=1)
    start = np.arange(whole, dtype=np.int64) * region
    return start + best, start + region


def rolling_cuts(j: Joined, cfg: MatchConfig) -> np.ndarray:
    """Where chunks end within their blocks: before byte p if the window that ends with p hashes high enough.

    The window is that of the last 48 bytes of the block, whatever was cut before, so all
    hashes are made at once and only the least chunk length is followed in order.
    """
    limit = np.uint64(2**64 - 1 - (2**64 - 1) // cfg.target_chunk)
    p = np.flatnonzero(j.hash.windows(M1_WINDOW) > limit) + M1_WINDOW - 1
    begins = j.blocks(cfg.block_size)[:, 0]
    block = np.searchsorted(begins, p, "right") - 1
    inside = p - begins[block] >= M1_WINDOW
    ends, of, last = [], -1, 0
    for at, k in zip(p[inside].tolist(), block[inside].tolist(), strict=True):
        if k != of:
            of, last = k, int(begins[k])
        if at - last >= cfg.min_match:
            ends.append(at)
            last = at
    return np.array(ends, np.int64)


def order1_cuts(j: Joined, cfg: MatchConfig) -> np.ndarray:
    """Where chunks end within their blocks, by a hash that weighs whether each byte follows the last as it did before.

    A cut is made before the byte at which the hash is high enough. That byte then starts
    the next chunk but is not read again: the state after a cut is the empty one.

    What follows a cut does not depend on what was before it. So blocks are read from the start
    of every ``SEGMENT`` on, as if a chunk began there, all side by side; each is read on behind
    its end up to a cut that the reading there has made as well, and the true cuts are those
    along this way. Where none is met soon, the true way is read on alone.
    """
    n = len(j.s)
    if not n:
        return np.zeros(0, np.int64)
    walk, spans = _order1_walk(j.s, cfg), j.blocks(cfg.block_size)
    count = -(-(spans[:, 1] - spans[:, 0]) // SEGMENT)
    first = np.cumsum(count) - count
    seg = np.repeat(spans[:, 0] - SEGMENT * first, count) + SEGMENT * np.arange(count.sum())
    hi, known = np.repeat(spans[:, 1], count), np.zeros(n, bool)
    stop = np.minimum(seg + SEGMENT, hi)
    row, cut = walk(seg, seg, hi, stop, known)
    own = cut < stop[row]
    known[cut[own]] = True
    behind = {r: [p] for r, p in zip(row[~own].tolist(), cut[~own].tolist(), strict=True)}
    row, cut = row[own], cut[own]
    lost = np.array([(r, p[0]) for r, p in behind.items() if not known[p[0]]], np.int64).reshape(-1, 2)
    more, at = walk(lost[:, 1] + 1, lost[:, 1], hi[lost[:, 0]], lost[:, 1] + 2 * SEGMENT, known)
    for r, p in zip(lost[more, 0].tolist(), at.tolist(), strict=True):
        behind[r].append(p)
    found, edge = [cut[(count == 1)[np.searchsorted(first, row, "right") - 1]]], np.searchsorted(row, np.arange(len(seg) + 1))
    for k in np.flatnonzero(count > 1).tolist():
        r, entry = int(first[k]), -1
        while True:
            mine = cut[edge[r] : edge[r + 1]]
            found.append(mine[np.searchsorted(mine, entry, "right") :])
            if r not in behind:
                break
            found.append(np.array(behind[r], np.int64))
            if not known[found[-1][-1]]:
                p = found[-1][-1:]
                found.append(walk(p + 1, p, hi[[r]], hi[[r]], known)[1])
                if not len(found[-1]) or not known[found[-1][-1]]:
                    break
            entry = int(found[-1][-1])
            r = int(first[k]) + (entry - int(spans[k, 0])) // SEGMENT
    return np.sort(np.concatenate(found))


def _order1_walk(s: np.ndarray, cfg: MatchConfig):
    """A function that reads on, side by side, from places at which the state is empty, ``STEP`` bytes of each at a time.

    Whether a byte was predicted depends on the chunk only by where that begins: the last
    place of the byte before has to lie within. A byte changes the hash h to a * h + b, and
    such changes are joined by doubling.
    """
    n, limit = len(s), np.uint32(2**32 - 1 - (2**32 - 1) // cfg.target_chunk)
    # near: the last place before p - 1 with the byte of p - 1, if what follows there is the byte of p
    kind = np.int32 if n < 2**31 - STEP else np.int64
    order = np.argsort(s, kind="stable").astype(kind)
    sorted_bytes, place = s[order], np.empty(n, kind)
    place[order[:1]] = -1
    place[order[1:]] = np.where(sorted_bytes[1:] == sorted_bytes[:-1], order[:-1], kind(-1))
    last_of = np.concatenate([np.full(1, -1, kind), place[:-1]])
    near = np.where(s[last_of + kind(1)] == s, last_of, kind(-1))
    view = lambda x: np.lib.stride_tricks.sliding_window_view(np.concatenate([x, np.zeros(STEP, x.dtype)]), STEP)
    near, bytes_at = view(near), view(s)
    zeros, data = bool((s == 0).any()), s.data

    def alone(begin: int, last: int, hi: int, stop: int, known: np.ndarray) -> list[int]:
        found, follows, before, h, most = [], [0] * 256, 0, 0, int(limit)
        for p, c in enumerate(data[begin:hi], begin):
            h = ((h + c + 1) * (HIT if follows[before] == c else MISS)) & 0xFFFFFFFF
            follows[before] = c
            before = c
            if h > most and p - last >= cfg.min_match:
                found.append(p)
                if p >= stop or known[p]:
                    break
                last, follows, before, h = p, [0] * 256, 0, 0
        return found

    def walk(at: np.ndarray, last: np.ndarray, hi: np.ndarray, stop: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cut), sorted: of each row up to its first cut from ``stop`` on or at a ``known`` place, or to ``hi``."""
        row, begin, last, h = np.arange(len(at)), at.copy(), last.copy(), np.zeros(len(at), np.uint32)
        rows, cuts = [row[:0]], [row[:0]]
        live = at < hi
        while live.any():
            if not live.all():
                row, begin, last, at, h, hi, stop = (x[live] for x in (row, begin, last, at, h, hi, stop))
            if len(at) <= FEW:
                for i in range(len(at)):
                    found = alone(int(begin[i]), int(last[i]), int(hi[i]), int(stop[i]), known)
                    rows.append(np.full(len(found), row[i]))
                    cuts.append(np.array(found, np.int64))
                break
            c = bytes_at[at]
            hit = near[at] >= begin.astype(kind)[:, None]
            if zeros:
                # no byte before counts as byte 0, and what follows a byte not seen yet as 0 too
                where = at[:, None] + np.arange(STEP)
                first = where == begin[:, None]
                before = np.where(first, 0, s[np.clip(where - 1, 0, n - 1)])
                new = ~first & (last_of[np.minimum(where, n - 1)] < begin[:, None])
                hit = np.where(first, c == 0, np.where(new, np.where(before == 0, s[np.minimum(begin, n - 1)][:, None] == c, c == 0), hit))
            by = np.ascontiguousarray(np.where(hit, np.uint32(HIT), np.uint32(MISS)).T)
            hs = np.ascontiguousarray(c.T).astype(np.uint32) + np.uint32(1)
            for x, m in zip(hs, by, strict=True):
                x += h
                x *= m
                h = x
            k, r = np.divmod(np.flatnonzero(hs.ravel() > limit), len(at))
            order = np.argsort(r, kind="stable")
            r, p = r[order], (at[r] + k)[order]
            ok = (p - last[r] >= cfg.min_match) & (p < hi[r])
            r, p = r[ok], p[ok]
            one = np.flatnonzero(np.diff(r, prepend=-1))
            r, p = r[one], p[one]
            rows.append(row[r])
            cuts.append(p)
            at, h = at + STEP, h.copy()
            last[r], begin[r], at[r], h[r] = p, p + 1, p + 1, 0
            live = at < hi
            live[r[(p >= stop[r]) | known[p]]] = False
        row, cut = np.concatenate(rows), np.concatenate(cuts)
        order = np.lexsort((cut, row))
        return row[order], cut[order]

    return walk


def chunk_ends(j: Joined, cfg: MatchConfig) -> np.ndarray:
    """Ends of all chunks, in order; state starts anew in every block."""
    cuts = (rolling_cuts if cfg.method == "m1" else order1_cuts)(j, cfg)
    return np.sort(np.concatenate([cuts, j.blocks(cfg.block_size)[:, 1]]))


def chunks(payload: bytes, cfg: MatchConfig) -> list[tuple[int, int, int]]:
    """(block, start, end) of every chunk."""
    ends = chunk_ends(Joined([payload]), cfg).tolist()
    return [(start // cfg.block_size, start, end) for start, end in zip([0, *ends], ends, strict=False)]


# -- candidates ----------------------------------------------------------------------------


def together(sizes: list[int]) -> list[range]:
    """Ranges of payloads of these sizes to be searched at once, of about ``GROUP`` bytes; a longer payload is alone."""
    out, first, size = [], 0, 0
    for i, n in enumerate(sizes):
        if i > first and size + n > GROUP:
            out.append(range(first, i))
            first, size = i, 0
        size += n
    return [*out, range(first, len(sizes))] if sizes else out


class Joined:
    """Payloads one behind the other, so that a numpy call serves them all.

    Positions are those of the whole; ``local`` gives those of each payload. What would cross
    from one payload to the next is never looked at.
    """

    def __init__(self, payloads: list[bytes]):
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in payloads])]).astype(np.int64)
        self.data = payloads[0] if len(payloads) == 1 else b"".join(payloads)
        self.s = as_bytes(self.data)
        self._all: tuple | None = None

    @cached_property
    def hash(self) -> PrefixHash:
        return PrefixHash(self.s)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def local(self, at: np.ndarray) -> np.ndarray:
        return at - self.start[self.owner(at)]

    def grid(self, step: int, count: np.ndarray | None = None) -> np.ndarray:
        """Starts of each payload's whole aligned pieces of ``step`` bytes, or of its first ``count``."""
        n = np.diff(self.start) // step if count is None else count
        return np.repeat(self.start[:-1] - step * (np.cumsum(n) - n), n) + step * np.arange(n.sum())

    def blocks(self, size: int) -> np.ndarray:
        """[start, end) of each payload's blocks of ``size`` bytes, the last one shorter."""
        lo = self.grid(size, -(-np.diff(self.start) // size))
        return np.stack([lo, np.minimum(lo + size, self.start[self.owner(lo) + 1])], axis=1)

    def each(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` by payload; ``at`` is sorted."""
        sums = np.concatenate([[0], np.cumsum(values)])
        edge = np.searchsorted(at, self.start, "left")
        return sums[edge[1:]] - sums[edge[:-1]]

    def runs(self, least: int, seed: int, cap: int) -> Found:
        """Runs of ``least`` bytes or more that equal those a distance before, sorted by source; with ``seed`` those that hold a whole aligned seed.

        A run of ``least`` bytes holds a whole aligned piece half as long, so with shorter seeds
        all runs are asked for. These are kept for the next call, of another method.
        """
        whole = exhaustive_seed(least)
        cap = cap if cap < np.diff(self.start).max(initial=0) else 0
        if self._all is None or self._all[0] > least or self._all[1] and not 0 < cap <= self._all[1]:
            found = _runs(self, max(whole, seed), max(least, seed), cap)
            if seed > whole:
                return found
            self._all = least, cap, found
        f = self._all[2]
        ok = f.length >= max(least, seed)
        if cap:
            ok &= f.dst - f.src <= cap
        if seed > whole:
            lo = self.local(f.src)
            ok &= (lo + f.length) // seed > -(-lo // seed)
        return Found(f.src[ok], f.dst[ok], f.length[ok], 0, 0)


@dataclass
class Found:
    """Distinct candidates, and how many (seed, target) events gave them, both in each payload where these are joined.

    Where only the best were asked for, those of a smaller source stand for all of a
    destination and length, and ``distinct`` still counts all.
    """

    src: np.ndarray
    dst: np.ndarray
    length: np.ndarray
    raw: int | np.ndarray
    distinct: int | np.ndarray

    def best(self) -> Found:
        """Of each destination and length the smallest source."""
        order = np.lexsort((self.src, self.length, self.dst))
        d, n = self.dst[order], self.length[order]
        keep = order[np.concatenate([[True], (d[1:] != d[:-1]) | (n[1:] != n[:-1])])] if len(d) else order
        return Found(self.src[keep], self.dst[keep], self.length[keep], self.raw, self.distinct)


def _heads(j: Joined, seed: int, cap: int):
    """(seed, target) with equal hashes, the target behind the seed and in its payload, in bounded batches.

    Of pairs at one distance whose seeds follow each other within one run of equal bytes only
    the first is given: all would grow to the same run. So repetitive data, in which almost
    every pair has such a predecessor, costs a lookup a pair and nothing after.

    Most targets are ruled out by a table of some bits of the seeds' hashes. Seeds are sorted
    by hash and payload, then position; those of a target are one range, so batches are cut by
    target without ever holding all pairs.
    """
    seeds = j.grid(seed)
    if not len(seeds):
        return
    p, h, own = j.hash, j.hash.windows(seed), j.owner(seeds)
    bits = (16 * len(seeds)).bit_length()
    some = ((h * SPREAD) >> np.uint64(64 - bits)).view(np.int64)
    table = np.zeros(1 << bits, bool)
    table[some[seeds]] = True
    targets = np.flatnonzero(table[some])
    of = j.owner(targets)
    inside = targets + seed <= j.start[of + 1]
    targets, of = targets[inside], of[inside]
    key = lambda at, k: h[at] ^ (k.astype(np.uint64) * SPREAD)
    keys, wanted = key(seeds, own), key(targets, of)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    lo, hi = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    live = hi > lo
    targets, of, lo, hi = targets[live], of[live], lo[live], hi[live]
    ends, at = np.cumsum(hi - lo), 0
    while at < len(targets):
        done = int(ends[at - 1]) if at else 0
        take = max(1, int(np.searchsorted(ends, done + PAIRS, "right")) - at)
        n = (hi - lo)[at : at + take]
        t = np.repeat(targets[at : at + take], n)
        k = order[np.repeat(lo[at : at + take], n) + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)]
        ok = (seeds[k] < t) & (own[k] == np.repeat(of[at : at + take], n))
        at += take
        if cap:
            ok &= t - seeds[k] <= cap
        k, t = k[ok], t[ok]
        after = np.flatnonzero((k > 0) & (own[k - 1] == own[k]))
        a, d = seeds[k[after] - 1], (t - seeds[k])[after]
        first = np.ones(len(k), bool)
        if len(after):
            first[after[p.at(a, 2 * seed) == p.at(a + d, 2 * seed)]] = False
        yield seeds[k[first]], t[first]


def _equal(data: bytes, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ranges are equal byte for byte: what hashes say is never taken on trust."""
    return np.fromiter((data[x : x + m] == data[y : y + m] for x, y, m in zip(a.tolist(), b.tolist(), n.tolist(), strict=True)), bool, len(a))


def _runs(j: Joined, seed: int, least: int, cap: int) -> Found:
    """The runs of equal bytes around aligned seeds: what growing a seed to both sides finds."""
    p, parts = j.hash, [np.zeros((3, 0), np.int64)]
    for a, b in _heads(j, seed, cap):
        own = j.owner(b)
        back = p.common_back(a, b, a - j.start[own])
        size = back + p.common(a, b, j.start[own + 1] - b)
        ok = size >= least
        parts.append(_distinct(np.stack([a - back, b - back, size])[:, ok]))
    rows = _distinct(np.concatenate(parts, axis=1))
    rows = rows[:, _equal(j.data, *rows)]
    return Found(*rows, 0, 0)


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Runs sorted by source and destination, each once."""
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    return rows[:, np.concatenate([[True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)])] if rows.shape[1] else rows


def _grown(j: Joined, least: int, seed: int, cap: int) -> Found:
    """m4 and m5: runs around aligned seeds; an event is a seed within."""
    f = j.runs(least, seed, cap)
    lo = j.local(f.src)
    return Found(f.src, f.dst, f.length, j.each(f.src, (lo + f.length) // seed - -(-lo // seed)), j.each(f.src, np.ones(len(lo), np.int64)))


def _quanta(j: Joined, least: int, seed: int, cap: int, best: bool) -> Found:
    """From each seed on, as many whole seeds as its run holds: a family for each run, all ending in its last seed.

    With ``best``, families are written out a bounded number of rows at a time, and of each
    destination and length the smallest source is kept, so memory follows these and not the
    families.
    """
    few = -(-least // seed)
    runs = j.runs(few * seed, seed, cap)
    skip = -j.local(runs.src) % seed
    tail = runs.length - skip
    count = np.maximum(tail // seed - few + 1, 0)
    ends = np.cumsum(count)
    kept, begin = Found(*np.zeros((3, 0), np.int64), 0, 0), 0
    while begin < len(skip):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right"))) if best else len(skip)
        own = np.arange(begin, end)
        which = np.repeat(own, count[own])
        k = np.arange(len(which)) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
        src = (runs.src + skip)[which] + k * seed
        found = Found(src, src + (runs.dst - runs.src)[which], (tail[which] - k * seed) // seed * seed, 0, 0)
        if best:
            found = found.best()
            found = Found(*(np.concatenate([getattr(x, c) for x in (kept, found)]) for c in ("src", "dst", "length")), 0, 0).best() if begin else found
        kept, begin = found, end
    total = j.each(runs.src, count)
    return Found(kept.src, kept.dst, kept.length, total, total)


def regions(j: Joined, min_match: int, cap: int) -> Found:
    """m0, also the overlay: runs that hold a representative of a region of an eighth of the minimum, which their target can see.

    An event is such a representative.
    """
    region = max(1, min_match // 8)
    f = j.runs(min_match, 0, cap)
    if not len(f.src):
        return Found(f.src, f.dst, f.length, *[np.zeros(len(j.start) - 1, np.int64)] * 2)
    # only those of the payloads that have runs
    has = np.zeros(len(j.start) - 1, bool)
    has[j.owner(f.src)] = True
    start = j.grid(region, np.where(has, np.maximum(np.diff(j.start) - region + 1, 0) // region, 0))
    at = start + j.hash.windows(region)[start[:, None] + np.arange(region)].argmax(axis=1)
    late = start + region - at
    lo = np.searchsorted(at, f.src, "left")
    hi = np.maximum(np.searchsorted(at, f.src + f.length - region, "right"), lo)
    count, distance = hi - lo, f.dst - f.src
    for d in np.unique(distance[distance < region]).tolist():
        seen, own = np.concatenate([[0], np.cumsum(late <= d)]), distance == d
        count[own] = seen[hi[own]] - seen[lo[own]]
    ok = count > 0
    return Found(f.src[ok], f.dst[ok], f.length[ok], j.each(f.src[ok], count[ok]), j.each(f.src[ok], np.ones(int(ok.sum()), np.int64)))


def find(j: Joined, cfg: MatchConfig, best: bool = False) -> Found:
    """The base candidates of ``cfg.method`` (without overlay); with ``best`` the smallest source of each destination and length."""
    least, seed, cap = cfg.min_match, cfg.seed, cfg.distance_cap
    if cfg.method in ("m1", "m2"):
        return _chunk_candidates(j, cfg, best)
    if cfg.method == "m3":
        return _quanta(j, least, seed, cap, best)
    found = regions(j, least, cap) if cfg.method == "m0" else _grown(j, least, seed, cap)
    return found.best() if best else found


def find_overlay(j: Joined, cfg: MatchConfig, best: bool = False) -> Found:
    """The candidates of the overlay of ``cfg``."""
    found = regions(j, cfg.overlay.min_match, min(c for c in (cfg.distance_cap, cfg.overlay.distance) if c))
    return found.best() if best else found


def candidates(payload: bytes, cfg: MatchConfig, best: bool = False) -> Found:
    """``find`` in a single payload."""
    f = find(Joined([payload]), cfg, best)
    return Found(f.src, f.dst, f.length, int(f.raw[0]), int(f.distinct[0]))


def _chunk_candidates(j: Joined, cfg: MatchConfig, best: bool) -> Found:
    """Every earlier chunk of equal bytes within reach for every chunk, or, with ``best``, the first of them."""
    ends = chunk_ends(j, cfg)
    starts = np.concatenate([[0], ends])[:-1]
    long = ends - starts >= cfg.min_match
    data, seen, of = j.data, {}, -1
    rows, total = [], np.zeros(len(j.start) - 1, np.int64)
    for own, start, end in zip(j.owner(starts[long]).tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        if own != of:
            seen, of = {}, own
        earlier = seen.setdefault(data[start:end], [])
        if earlier:
            first = bisect_left(earlier, start - cfg.distance_cap) if cfg.distance_cap else 0
            total[own] += len(earlier) - first
            rows += [(at, start, end - start) for at in earlier[first : first + 1 if best else None]]
        earlier.append(start)
    return Found(*np.array(sorted(rows), np.int64).reshape(-1, 3).T, total, total)


# -- selection -----------------------------------------------------------------------------


def chosen(j: Joined, cfg: MatchConfig) -> Found:
    """The matches of each payload, in order: the best set of its candidates and its overlay's. No counts.

    The best set of payloads joined is that of each, as no interval crosses a border.
    """
    found = [find_overlay(j, cfg, True)] if cfg.overlay else []
    found.append(find(j, cfg, True))
    f = Found(*(np.concatenate([getattr(x, c) for x in found]) for c in ("src", "dst", "length")), 0, 0)
    f = f.best() if cfg.overlay else f
    pays = np.flatnonzero(f.length > MATCH_COST)
    keep = pays[select(f.dst[pays], f.src[pays], f.length[pays], MATCH_COST)]
    return Found(f.src[keep], f.dst[keep], f.length[keep], 0, 0)


def select(dst: np.ndarray, src: np.ndarray, length: np.ndarray, cost: int) -> np.ndarray:
    """Indices, in order, of the best set of intervals [dst, dst + length) that do not overlap.

    Best is the largest sum of length - cost; then most covered; then fewest; then the chain
    that comes first by (dst, src, -length). With the intervals in that order, the best of
    all from one on is either without it or with it and the best from its end on; where both
    are worth the same, with it comes first.
    """
    order = np.lexsort((-length, src, dst))
    d, n = dst[order], length[order]
    after = np.searchsorted(d, d + n, "left").tolist()
    size = n.tolist()
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (len(d) + 1)
    take = [False] * len(d)
    for i in range(len(d) - 1, -1, -1):
        gain, covered, few = best[after[i]]
        own = (gain + size[i] - cost, covered + size[i], few - 1)
        take[i] = own >= best[i + 1]
        best[i] = own if take[i] else best[i + 1]
    out, i = [], 0
    while i < len(d):
        if take[i]:
            out.append(int(order[i]))
            i = after[i]
        else:
            i += 1
    return np.array(out, np.int64)
