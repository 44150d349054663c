import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from echofold.llm.source_mix import mix_sources, sainte_lague, take_mix, targets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=9), st.integers(0, 40))
def test_seats_go_to_the_highest_quotient(parties, seats):
    w, most = (np.array(x) for x in zip(*parties, strict=True))
    got = np.zeros(len(w), int)
    for _ in range(seats):
        q = np.where((got < most) & (w > 0), w / (2 * got + 1), -1.0)
        if q.max() < 0:
            break
        got[int(np.argmax(q))] += 1
    assert sainte_lague(w.astype(float), seats, most).tolist() == got.tolist()


def test_targets():
    assert targets({"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    t = targets({"a": 10, "b": 1000, "c": 1000, "d": 0})
    assert t["a"] == 30 and t["d"] == 0 and abs(sum(t.values()) - 2010) < 1e-6 and abs(t["b"] / t["c"] - 2) < 1e-9
    assert all(v <= 3 * s + 1e-9 for v, s in [(targets({"x": s, "y": 7})["x"], s) for s in (0, 1, 5, 900)]) and targets({}) == {}


def rows_of(n=3000):
    r = np.random.default_rng(2)
    source = lambda i: None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}"
    return [(i, " ".join("w" * 1 for _ in range(int(r.integers(0, 300)))), source(i)) for i in range(n)]


def test_mix_comes_near_its_targets(spark):
    rows = rows_of()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(df, shard_rows=300).collect()
    size = {i: len(WORDS.findall(t)) for i, t, _ in rows}
    total, taken, goal = defaultdict(int), defaultdict(int), {}
    for i, _, s in rows:
        total[s] += size[i]
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] and r.source_size == total[r.source]
    want = targets(dict(total))
    assert all(abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= max(0.02 * want[s], 16 * 11) for s in want)
    assert sorted(map(tuple, mix_sources(df.repartition(7), shard_rows=300).collect())) == sorted(map(tuple, got))


def taken_by_brute_force(rows, shard_rows, seed, hashes, whole, block=16, cap=3):
    """Row by row as the docstring says; ``hashes`` has each row's place, part hash and source hash."""
    size = [len(WORDS.findall(t or "")) for _, t, _ in rows]
    total, n = defaultdict(int), defaultdict(int)
    for k, (_, _, s) in enumerate(rows):
        total[s] += size[k]
        n[s] += 1
    goal, shards = targets(dict(total)), max(1, -(-len(rows) // shard_rows))
    cells = defaultdict(list)
    for k, (i, _, s) in enumerate(rows):
        place, part, of_source = hashes[k]
        cells[(part % -(-n[s] // shard_rows) + of_source % shards) % shards, s].append((place, str(i), k))
    taken = [0] * len(rows)
    for shard in range(shards):
        own = sorted((s for h, s in cells if h == shard), key=lambda s: (s is None, s or ""))
        words = [sum(size[k] for *_, k in cells[shard, s]) for s in own]
        share = [sum(size[k] * (goal[s] / max(total[s], 1)) for *_, k in cells[shard, s]) for s in own]
        got = [0] * len(own)
        for _ in range(round(sum(share) / block)):
            q = [x / (2 * g + 1) if x > 0 and g < -(-cap * w // block) else -1 for x, g, w in zip(share, got, words, strict=True)]
            if max(q) >= 0:
                got[q.index(max(q))] += 1
        for s, w, g in zip(own, words, got, strict=True):
            quota, first = min(g * block, cap * w), None
            laps, left = divmod(quota, w) if w else (0, 0)
            for *_, k in sorted(cells[shard, s]):
                taken[k] += laps * size[k]
                if size[k] <= left:
                    taken[k] += size[k]
                    left -= size[k]
                elif first is None or size[k] < size[first]:
                    first = k
            if first is not None:
                taken[first] += left if not whole else size[first] if 2 * left > size[first] else 0
    return taken


def test_taken_words_against_brute_force(spark):
    from pyspark.sql import functions as F

    rows = rows_of(700)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    place = F.xxhash64("doc_id", "text", F.lit(11))
    source = F.coalesce("source", F.lit(""))
    hashed = {r.doc_id: (r.place, r.part, r.of) for r in df.select("doc_id", place.alias("place"), F.xxhash64(place, F.lit(11)).alias("part"), F.xxhash64(F.col("source").isNull(), source).alias("of")).collect()}
    for whole in (False, True):
        got = {r.doc_id: r.taken for r in mix_sources(df, shard_rows=100, whole=whole).collect()}
        assert [got[i] for i, _, _ in rows] == taken_by_brute_force(rows, 100, 11, [hashed[i] for i, _, _ in rows], whole)


def test_the_mix_itself(spark):
    rows = rows_of(600)
    df = spark.createDataFrame([(*r, i, -1) for i, r in enumerate(rows)], "doc_id long, text string, source string, size int, taken int")
    plan = {r.doc_id: r.taken // max(1, len(WORDS.findall(rows[r.doc_id][1]))) for r in mix_sources(df, whole=True).collect()}
    out = take_mix(df)
    found = defaultdict(int)
    for r in out.collect():
        found[r.doc_id] += 1
        assert (r.text, r.source) == rows[r.doc_id][1:] and (r.size, r.taken) == (r.doc_id, -1)
    assert out.columns == df.columns and found == {i: n for i, n in plan.items() if n}


def test_a_rare_source_gets_its_share(spark):
    rows = [(i, "one two three four five", "big") for i in range(4000)] + [(9000 + i, "a b", "rare") for i in range(40)]
    df = spark.createDataFrame([(*r, "s", True, "k", 1, 2) for r in rows], "doc_id long, text string, source string, shard string, is_null boolean, source_key string, __size int, __place int")
    got = mix_sources(df, shard_rows=100)
    sums: dict = defaultdict(int)
    for r in got.collect():
        sums[r.source] += r.taken
        assert r.shard == "s" and r["__size"] == 1
    goal = targets({"big": 20_000, "rare": 80})
    assert abs(sums["rare"] - goal["rare"]) <= 16 and abs(sums["big"] - goal["big"]) <= 0.01 * goal["big"]


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, None, None), (1, "", "a"), (1, "", "a"), (2, "one two three", "a"), (2, "one two three", "a"), (3, "é x y", None)], "doc_id long, text string, source string")
    got = sorted(((r.doc_id or 0, r["size"], r.taken) for r in mix_sources(df).collect()))
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (1, 0), (2, 3), (2, 3), (3, 2)] and all(t <= 3 * s for _, s, t in got)
    assert mix_sources(df.limit(0)).count() == 0 and take_mix(df.limit(0)).count() == 0
    assert mix_sources(df.where("doc_id = 1")).count() == 2
