"""Finders and selection against brute force, and known counters."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.functions.config import MATCH_COST, MatchConfig, Overlay, exhaustive_seed, parse_method, parse_size
from echofold.functions.errors import EngineError
from echofold.functions.hashing import PrefixHash, as_bytes, blake3_256, crc32c, poly_hash, siphash24, xxh3_128
from echofold.functions.kernels import HIT, MISS, Joined, candidates, chunk_ends, chunks, find, find_overlay, select


def best(data, cfg):
    found = candidates(data, cfg)
    least: dict = {}
    for s, d, n in zip(found.src.tolist(), found.dst.tolist(), found.length.tolist(), strict=True):
        if n > MATCH_COST:
            least[d, n] = min(s, least.get((d, n), s))
    d, n = (np.array([k[i] for k in least], np.int64) for i in (0, 1))
    s = np.array(list(least.values()), np.int64)
    keep = select(d, s, n, MATCH_COST)
    return found, [(int(s[i]), int(d[i]), int(n[i])) for i in keep]


@pytest.mark.parametrize(
    "data, cfg, raw, selected, covered",
    [
        (bytes(range(24)) * 10, MatchConfig("m3", min_match=16, seed_size=16), 65, 1, 208),
        (bytes(range(24)) * 10, MatchConfig("m4", min_match=16, seed_size=16), 65, 1, 216),
        (b"abc" * 20 + b"XYZ" * 7 + b"abc" * 20, MatchConfig("m3", min_match=7, seed_size=3), 640, 2, 117),
    ],
)
def test_known_counters(data, cfg, raw, selected, covered):
    found, chosen = best(data, cfg)
    assert (found.raw, len(chosen), sum(m[2] for m in chosen)) == (raw, selected, covered)


def test_region_events():
    found = candidates(b"0123456701234567", MatchConfig("m0", min_match=8))
    assert found.raw == 8 and (found.src.tolist(), found.dst.tolist(), found.length.tolist()) == ([0], [8], [8])


def brute(data, cfg):
    n, m, seed, cap = len(data), cfg.method, cfg.seed, cfg.distance_cap
    if m == "m0":
        whole = max(0, n - seed + 1) // seed
        h = lambda i: poly_hash(data[i : i + seed])
        seeds = [(max(range(k * seed, (k + 1) * seed), key=lambda i: (h(i), -i)), (k + 1) * seed) for k in range(whole)]
    else:
        seeds = [(k, 0) for k in range(0, n - seed + 1, seed)]
    rows, raw = set(), 0
    for t in range(n - seed + 1):
        for s, visible in seeds:
            if s < t and visible <= t and not (cap and t - s > cap) and data[s : s + seed] == data[t : t + seed]:
                ahead = 0
                while t + ahead < n and data[s + ahead] == data[t + ahead]:
                    ahead += 1
                a, b = s, t
                if m == "m3":
                    size = ahead // seed * seed
                    ok = size // seed >= -(-cfg.min_match // seed)
                else:
                    while a > 0 and data[a - 1] == data[b - 1]:
                        a, b = a - 1, b - 1
                    size = ahead + t - b
                    ok = size >= cfg.min_match
                if ok:
                    rows.add((a, b, size))
                    raw += 1
    return rows, raw


@settings(max_examples=250, deadline=None)
@given(st.sampled_from(["m0", "m3", "m4", "m5"]), st.lists(st.integers(0, 2), max_size=70), st.integers(1, 9), st.integers(2, 20), st.integers(1, 9), st.one_of(st.none(), st.integers(1, 30)), st.booleans())
def test_finders_against_brute_force(method, values, period, least, seed, cap, periodic):
    data = bytes(values)
    if periodic:
        data = (data[:period] * 40)[:70]
    cfg = MatchConfig(method, min_match=least, max_distance=cap, **({"seed_size": seed} if method in ("m3", "m4") else {}))
    found = candidates(data, cfg)
    rows, raw = brute(data, cfg)
    assert set(zip(found.src.tolist(), found.dst.tolist(), found.length.tolist(), strict=True)) == rows
    assert len(found.src) == len(rows) and found.raw == raw


def brute_cuts(data, cfg):
    out = []
    for k, lo in enumerate(range(0, len(data), cfg.block_size)):
        hi, last = min(len(data), lo + cfg.block_size), lo
        follows, before, h = [0] * 256, 0, 0
        for p in range(lo, hi):
            if cfg.method == "m1":
                cut = hi - lo > 48 and p >= lo + 48 and poly_hash(data[p - 47 : p + 1]) > 2**64 - 1 - (2**64 - 1) // cfg.target_chunk
            else:
                c = data[p]
                h = (h + c + 1) * (HIT if follows[before] == c else MISS) % 2**32
                follows[before], before = c, c
                cut = h > 2**32 - 1 - (2**32 - 1) // cfg.target_chunk
            if cut and p - last >= cfg.min_match:
                out.append((k, last, p))
                last = p
                follows, before, h = [0] * 256, 0, 0
        if last < hi:
            out.append((k, last, hi))
    return out


@pytest.mark.parametrize("method", ["m1", "m2"])
def test_chunks_against_brute_force(method):
    r = random.Random(4)
    for n in (0, 1, 47, 48, 49, 80, 1023, 1024, 1025, 1072, 1073, 5000):
        data = bytes(r.randint(0, 255) if n % 2 else r.randint(97, 100) for _ in range(n))
        cfg = MatchConfig(method, min_match=8, target_chunk=32, block_size=1024)
        found = chunks(data, cfg)
        assert found == brute_cuts(data, cfg)
        assert b"".join(data[a:e] for _, a, e in found) == data


def test_chunk_candidates_are_all_earlier_equal_chunks():
    data = bytes(range(200)) * 20
    cfg = MatchConfig("m1", min_match=8, target_chunk=32, block_size=1024)
    found = candidates(data, cfg)
    bounds = [(a, e) for _, a, e in chunks(data, cfg)]
    want = {(a, b, e - a) for (a, e), (b, f) in combinations(bounds, 2) if data[a:e] == data[b:f] and e - a >= 8}
    assert want and set(zip(found.src.tolist(), found.dst.tolist(), found.length.tolist(), strict=True)) == want


def test_payloads_are_searched_together(monkeypatch):
    from echofold.functions import kernels

    made = []
    monkeypatch.setattr(kernels, "PrefixHash", lambda s: made.append(len(s)) or PrefixHash(s))
    r = random.Random(5)
    for _ in range(60):
        docs = [bytes(r.randint(0, w) for _ in range(r.choice([0, 1, 9, 40, 70]))) for w in r.choices([0, 1, 2], k=5)]
        docs.append(docs[1])  # equal to another: no match crosses payloads
        j, made[:] = Joined(docs), []
        for method in ("m0", "m3", "m4", "m5"):
            cfg = MatchConfig(method, min_match=r.randint(2, 20), max_distance=r.choice([None, 7]), **({"seed_size": r.randint(1, 9)} if method in ("m3", "m4") else {}))
            found, want = find(j, cfg), [brute(d, cfg) for d in docs]
            assert {(s - j.start[k], d - j.start[k], n, k) for s, d, n, k in zip(found.src, found.dst, found.length, j.owner(found.dst), strict=True)} == {(*row, k) for k, w in enumerate(want) for row in w[0]}
            assert found.raw.tolist() == [w[1] for w in want] and found.distinct.tolist() == [len(w[0]) for w in want]
        cfg = MatchConfig("m4", min_match=16, seed_size=8, overlay=Overlay(8, 1000))
        found = find_overlay(j, cfg)
        assert len(found.src) == sum(len(brute(d, MatchConfig("m0", min_match=8))[0]) for d in docs)
        assert made == [len(j.s)]  # once for all methods and payloads


def test_overlay_and_base_share_one_search(monkeypatch):
    from echofold.functions import kernels

    heads, pairs = kernels._heads, []
    monkeypatch.setattr(kernels, "_heads", lambda *a: (pairs.append(len(x[0])) or x for x in heads(*a)))
    words = [bytes(random.Random(i).choices(b"abcdefghij", k=7)) for i in range(50)]
    r = random.Random(8)
    text = b" ".join(r.choices(words, k=3000))
    docs = [text + text[:500], b"", text[100:900] * 2]
    cfg = MatchConfig("m4", min_match=128, seed_size=64, overlay=Overlay(64, 1 << 20))
    j = Joined(docs)
    rows = kernels.chosen(j, cfg)
    assert list(zip(j.local(rows.src).tolist(), j.local(rows.dst).tolist(), rows.length.tolist(), strict=True)) == [(0, len(text), 500), (0, 800, 800)]
    # no pair for each place at which a word is seen again, and none anew for the base
    assert len(pairs) == 1 and pairs[0] <= 10


@pytest.mark.parametrize("method", ["m1", "m2"])
def test_chunks_of_payloads_together(method):
    r = random.Random(6)
    for _ in range(40):
        docs = [bytes(r.randint(lo, lo + w) for _ in range(r.choice([0, 1, 200, 1500]))) for lo, w in r.choices([(0, 0), (0, 3), (97, 1), (97, 25), (0, 255)], k=5)]
        cfg = MatchConfig(method, min_match=r.choice([2, 8, 32]), target_chunk=r.choice([32, 300]), block_size=1024)
        j = Joined(docs)
        assert chunk_ends(j, cfg).tolist() == [j.start[k] + e for k, d in enumerate(docs) for _, _, e in brute_cuts(d, cfg)]


def score(rows, chosen):
    pick = sorted((rows[i] for i in chosen), key=lambda m: m[1])
    return (-sum(m[2] - MATCH_COST for m in pick), -sum(m[2] for m in pick), len(pick), [(m[1], m[0], -m[2]) for m in pick])


def exhaustive(rows):
    out = []
    for k in range(len(rows) + 1):
        for c in combinations(range(len(rows)), k):
            at = sorted((rows[i][1], rows[i][1] + rows[i][2]) for i in c)
            if all(a[1] <= b[0] for a, b in zip(at, at[1:], strict=False)):
                out.append(c)
    return min(out, key=lambda c: score(rows, c))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 60), st.integers(26, 60)), max_size=9, unique_by=lambda m: (m[1], m[2])), st.randoms())
def test_selection_is_the_best_of_all_subsets_in_any_order(rows, r):
    want = sorted(rows[i] for i in exhaustive(rows))
    for _ in range(2):
        s, d, n = (np.array([m[i] for m in rows], np.int64) for i in range(3))
        assert sorted(rows[i] for i in select(d, s, n, MATCH_COST)) == want
        r.shuffle(rows)


def test_selection_is_not_longest_first():
    assert select(np.array([30, 70, 30]), np.array([0, 30, 0]), np.array([40, 40, 81]), MATCH_COST).tolist() == [2]


def test_repetitive_payloads_stay_fast():
    import time

    begin = time.perf_counter()
    found = candidates(bytes(20_000), MatchConfig("m4", min_match=64, seed_size=64))
    assert found.raw == sum((20_000 - t) and min(t, 20_000) // 64 + (t % 64 > 0) for t in range(20_000 - 63)) and time.perf_counter() - begin < 30


def test_hashes():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and poly_hash(b"abc") == 2276360813474
    assert blake3_256(b"").hex().startswith("af1349b9f5f9a1a6") and len(xxh3_128(b"")) == 16
    assert siphash24(bytes(range(15)), bytes(range(16))) == 0xA129CA6149BE45E5
    data = bytes(random.Random(1).randbytes(3000))
    h = PrefixHash(as_bytes(data)).windows(9)
    assert [int(x) for x in h[:40]] == [poly_hash(data[i : i + 9]) for i in range(40)]
    slow = 0xFFFFFFFF
    for b in data:
        slow ^= b
        for _ in range(8):
            slow = slow >> 1 ^ (0x82F63B78 if slow & 1 else 0)
    assert crc32c(data) == slow ^ 0xFFFFFFFF


def test_parameters():
    assert [exhaustive_seed(m) for m in (2, 7, 15, 16, 512)] == [1, 4, 8, 8, 256]
    assert [parse_size(x) for x in ("4096", "4KiB", "2m", "1g")] == [4096, 4096, 2 << 20, 1 << 30] and parse_method("reread") == "m4"
    assert MatchConfig("m4", overlay=Overlay(64, 100)).effective_min_match == 64
    for bad in ({"block_size": 1}, {"min_match": 1}, {"method": "m9"}, {"method": "m0", "seed_size": 4}, {"method": "m3", "target_chunk": 64}, {"method": "m1", "min_match": 64, "target_chunk": 32}, {"method": "m1", "overlay": Overlay()}, {"layout": "x"}):
        with pytest.raises(EngineError) as e:
            MatchConfig(**bad)
        assert e.value.code == 2
    for bad in ("", "1.5k", "1 k", "-1", "k"):
        with pytest.raises(EngineError):
            parse_size(bad)
