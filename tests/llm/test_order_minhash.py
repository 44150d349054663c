import random
import tracemalloc

import numpy as np
import pytest

from echofold.llm.order_minhash import _crowd_pairs, _runs, BANDS, anchored_at_most, alike, alike_pairs, banded_distance, components, edit_similarity, keep_one, labelled_kmers, lone_runs, lost_share, near_duplicates, order_sketch, parities, rarest, word_hashes


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(r, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words) + 1)
        kind = r.random()
        if kind < 0.4 or k == len(words):
            words.insert(k, r.choice(vocabulary))
        elif kind < 0.7:
            words.pop(k)
        else:
            words[k] = r.choice(vocabulary)
    return words


def test_banded_alignment_is_the_edit_distance():
    r = random.Random(3)
    for _ in range(500):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = edited(r, a, r.randint(0, 6), [0, 1, 2, 3]) if a else [1]
        want = levenshtein(a, b)
        for most in (0, 1, 2, 4, 20):
            assert banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == min(want, most + 1)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert anchored_at_most([(x, y)])[0] >= want and alike(x, y) == (not max(len(a), len(b)) or 1 - want / max(len(a), len(b)) >= 0.8 - 1e-9)
    assert edit_similarity(np.array([], np.uint64), np.array([], np.uint64)) == 1 and edit_similarity(word_hashes("a b"), word_hashes("c d")) == 0


def test_alignments_in_lanes_are_those_one_by_one():
    r = random.Random(4)
    pairs = []
    for vocabulary, longest, n in ((3, 20, 300), (60, 90, 300), (4000, 90, 300), (4000, 1500, 12), (4000, 5000, 4)):
        for _ in range(n):
            a = [r.randrange(vocabulary) for _ in range(r.randint(longest // 2 * (longest > 100), longest))]
            b = edited(r, a, int(r.uniform(0, 0.35) * len(a)), range(vocabulary)) if a else [1]
            pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    pairs.append((np.array([], np.uint64),) * 2)
    got = alike_pairs(pairs)
    one_by_one = [anchored_at_most([p])[0] for p in pairs]
    assert anchored_at_most(pairs).tolist() == one_by_one
    assert got.tolist() == [alike(a, b) for a, b in pairs] and 300 < got.sum() < len(pairs) - 100
    assert alike_pairs([]).tolist() == []


@pytest.mark.parametrize("likeness", [0.8, 0.85, 0.9, 0.95])
def test_planted_pairs_by_likeness(spark, likeness):
    # words changed at random places: 0.912, 0.998 and twice 1.000 of 500 pairs share a value
    r = random.Random(int(100 * likeness))
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for i in range(100):
        a = [r.choice(vocabulary) for _ in range(200)]
        b = list(a)
        for k in r.sample(range(200), round(200 * (1 - likeness))):
            b[k] = f"n{r.randrange(4000)}"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert len(set(got.values())) >= 100 and all(got[i] in (i, i - 1) for i in got)
    assert sum(got[2 * i + 1] == 2 * i for i in range(100)) >= 90


def test_sketch_keeps_order_and_counts_occurrences():
    words = word_hashes(" ".join(f"w{i}" for i in range(60)))
    assert (order_sketch(words) == order_sketch(words.copy())).all()
    assert len(set(labelled_kmers(word_hashes("a b c d e " * 10)).tolist())) == 46
    halves = np.concatenate([words[30:], words[:30]])  # nearly the same k-mers, in another order
    assert (order_sketch(words) == order_sketch(halves)).mean() < 0.5
    import echofold.llm.order_minhash as m

    whole = order_sketch(words)
    cells, m.CELLS = m.CELLS, 100
    assert (order_sketch(words) == whole).all()
    m.CELLS = cells


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    line = " ".join(r.choice(vocabulary) for _ in range(14))
    texts = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(30, 200))]
        for _ in range(r.randint(1, 6)):
            texts.append(" ".join(edited(r, base, r.randint(0, len(base) // 25), vocabulary)))
        texts.append(" ".join(r.choice(vocabulary) for _ in range(30)) + " " + line)
    texts += [texts[0]] * 5 + ["same words same words"] * 3 + ["", "x", "x y"]
    return texts


def classes_by_brute_force(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = [word_hashes(t) for t in texts]
    both = [(i, j) for i in range(len(texts)) for j in range(i)]
    for i, j in (ij for ij, same in zip(both, alike_pairs([(words[i], words[j]) for i, j in both]), strict=True) if same):
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return [find(i) for i in range(len(texts))]


def test_classes_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_texts_unlike_their_leader_are_looked_at_again(spark):
    # all share a long passage, so many of their values; likeness holds in pairs only
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(8):
        own = [r.choice(vocabulary) for _ in range(40)]
        texts += [" ".join(own + shared), " ".join(edited(r, own, 1, vocabulary) + shared)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == classes_by_brute_force(texts) and len(set(got.values())) == 8


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[100 + i] for i in range(1, 30)} == {100}


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (3, None), (2, ""), (None, "a b c"), (None, "a b c"), (5, "q"), (5, "q")], "doc_id long, text string")
    assert sorted(((r.doc_id or -1), (r.class_id or -1)) for r in near_duplicates(df).collect()) == [(-1, -1), (-1, -1), (-1, 2), (2, 2), (3, 2), (5, 5), (5, 5)]
    assert sorted((r.doc_id or -1, r.text) for r in keep_one(df).collect()) == [(-1, "a b c"), (2, ""), (5, "q")]
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    r = random.Random(1)
    words = [f"v{r.randrange(5000)}" for _ in range(60_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited(r, words, 200, ["new"])))], "doc_id long, text string")
    assert {x.class_id for x in near_duplicates(df).collect()} == {1}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_short_texts(n):
    assert len(order_sketch(word_hashes(" ".join("abcd"[:n])))) == BANDS


def with_passages(r, base, n, vocabulary, least=0.14, most=0.18):
    """``base`` and ``n`` copies, each with a passage of its own at another place: alike ``base``, mostly not each other."""
    texts = [" ".join(base)]
    for i in range(n):
        at = (i + 1) * len(base) // (n + 2)
        own = [r.choice(vocabulary) for _ in range(int(len(base) * r.uniform(least, most)))]
        texts.append(" ".join(base[:at] + own + base[at:]))
    return texts


def test_copies_alike_only_a_member_of_the_leaders_class(spark):
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    texts = with_passages(r, [r.choice(vocabulary) for _ in range(300)], 60, vocabulary)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df).collect()}
    assert all(alike(word_hashes(texts[0]), word_hashes(t)) for t in texts) and set(got.values()) == {0}


def test_a_value_of_many_texts_is_cut_over_tasks(spark):
    """Every text has the value 1, every two neighbours one of their own; heads lead to one text of each value."""
    n = 5_000
    rows = [(i, 100, [1, 10 + i // 2, -i - 1]) for i in range(n)]
    runs = _runs(spark.createDataFrame(rows, "uid long, n long, sketch array<long>").repartition(3))[0].collect()
    head: dict = {}
    for r in runs:
        head.setdefault(r.key, {})[r.uid] = head.get(r.key, {}).get(r.uid, set()) | {r.head}
    assert set(head) == {1} | {10 + i for i in range(n // 2)}
    for key, of in head.items():
        assert set(of) == ({2 * (key - 10), 2 * (key - 10) + 1} if key > 1 else set(range(n)))
        reach = {min(of)}
        while True:
            more = {u for u, hs in of.items() if hs & reach} | {h for u, hs in of.items() if u in reach for h in hs}
            if more <= reach:
                break
            reach |= more
        assert reach == set(of)


def test_likes_among_texts_of_a_common_passage(spark):
    # 200 texts are half one passage; pairs of them are alike by what stands outside of it
    r = random.Random(12)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [r.choice(vocabulary) for _ in range(80)]
    texts = []
    for _ in range(100):
        own = [r.choice(vocabulary) for _ in range(80)]
        texts += [" ".join(own + shared), " ".join(edited(r, own, 16, vocabulary) + shared)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df, rest=8).collect()}
    want = classes_by_brute_force(texts)
    assert all(got[i] >= want[i] for i in got) and sum(got[i] == want[i] for i in got) >= 0.97 * len(got)


def test_equal_ids_and_clashing_columns(spark):
    rows = [(1, "a b c", "y", 1), (1, "a b c", "x", 2), (1, "other words here", "z", 3), (2, "a b c", "w", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, uid long")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", "x", 2), (1, "other words here", "z", 3)]


def passage_and_few_words(pairs=40):
    """Texts of a passage of 120 words and 40 of their own, of which two at a time have every fourth in common: alike, though they share no run outside of the passage."""
    r = random.Random(31)
    vocabulary = [f"v{i}" for i in range(600)]
    shared = [r.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(pairs):
        own = [r.choice(vocabulary) for _ in range(40)]
        texts += [" ".join(shared + own), " ".join(shared + [w if i % 4 == 3 else r.choice(vocabulary) for i, w in enumerate(own)])]
    return texts


@pytest.mark.parametrize("options", [{"rest": 2}, {"rest": 2, "hot": 1}])
def test_no_like_is_lost_among_many_texts_of_a_passage(spark, options):
    texts = passage_and_few_words()
    want = classes_by_brute_force(texts)
    assert len(set(want)) == 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_duplicates(df, **options).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_alike_texts_share_one_of_their_rarest_words():
    r = random.Random(6)
    seen = np.array([r.randrange(50) for _ in range(1 << 16)])
    n = 0
    for vocabulary, longest in ((3, 20), (60, 90), (4000, 400)):
        for _ in range(300):
            a = [r.randrange(vocabulary) for _ in range(r.randint(1, longest))]
            a, b = (np.array(x, np.uint64) for x in (a, edited(r, a, int(r.uniform(0, 0.3) * len(a)), range(vocabulary))))
            if alike(a, b):
                n += 1
                assert set(rarest(a, seen, 0.8).tolist()) & set(rarest(b, seen, 0.8).tolist())
    assert n > 400


def test_texts_that_share_a_rare_word_only_do_not_meet(spark):
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(600)}"
    passage = [word() for _ in range(40)]
    texts = [[*passage, *(word() for _ in range(58)), f"tag{i % 4}", f"mark{i % 6}"] for i in range(240)]
    for i in range(0, 40, 2):  # alike, and not at its ends
        texts[i + 1] = [*texts[i][:50], *(word() for _ in range(12)), *texts[i][62:]]
    hashes = [word_hashes(" ".join(t)) for t in texts]
    nodes = spark.createDataFrame([(i, h.astype("uint32").view("int32").tolist()) for i, h in enumerate(hashes)], "uid long, words array<int>")
    crowd = spark.createDataFrame([(key, i, i) for i in range(len(texts)) for key in (1, 2)], "key long, uid long, root long")
    for hot in (2, 128):
        pairs, n = _crowd_pairs(crowd, nodes, 0.8, hot)
        found = {(r["a"], r["b"]) for r in pairs.collect()}
        assert {(i, i + 1) for i in range(0, 40, 2)} <= found
        assert n == len(found) <= 40  # thousands share one of their rarest words


def test_parities_differ_by_no_more_than_the_words_that_differ():
    rng = random.Random(24)
    for n in (0, 1, 30, 300, 3000):
        a = word_hashes(" ".join(f"w{rng.randrange(n + 1)}" for _ in range(n)))
        b = word_hashes(" ".join(f"w{rng.randrange(n + 1)}" for _ in range(n)))
        differ = len(set(labelled_kmers(a, 1).tolist()) ^ set(labelled_kmers(b, 1).tolist()))
        assert int(np.bitwise_count((parities(a) ^ parities(b)).view(np.uint64)).sum()) <= differ


def test_many_alignments_take_little_memory():
    r = np.random.default_rng(25)
    pairs = []
    for _ in range(6_000):
        a = r.integers(0, 1 << 32, 200, dtype=np.uint64)
        b = a.copy()
        b[[0, 60, 120, 199]] = r.integers(0, 1 << 32, 4, dtype=np.uint64)
        pairs.append((a, b))
    tracemalloc.start()
    assert alike_pairs(pairs).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_alike_texts_lack_few_runs_of_each_other():
    r = random.Random(26)
    for k in (1, 2, 3):
        n = 0
        for vocabulary, longest in ((3, 20), (60, 90), (4000, 400)):
            for _ in range(200):
                a = [r.randrange(vocabulary) for _ in range(r.randint(k, longest))]
                a, b = (np.array(x, np.uint64) for x in (a, edited(r, a, int(r.uniform(0, 0.3) * len(a)), range(vocabulary))))
                if min(len(a), len(b)) >= k and alike(a, b):
                    n += 1
                    for x, y in ((a, b), (b, a)):
                        assert len(set(labelled_kmers(x, k).tolist()) - set(labelled_kmers(y, k).tolist())) <= int(lost_share(k, 0.8) * len(x) + 1e-9)
        assert n > 250
    assert lone_runs(np.array([5, 7, 5, 9, 7], np.int64), np.array([1, 2, 1, 3, 4])).tolist() == [True, False, True, True, False]


def crowd_of(spark, texts, keys):
    hashes = [word_hashes(" ".join(t)) for t in texts]
    nodes = spark.createDataFrame([(i, h.astype("uint32").view("int32").tolist()) for i, h in enumerate(hashes)], "uid long, words array<int>")
    return spark.createDataFrame([(key, i, i) for i in range(len(texts)) for key in keys], "key long, uid long, root long"), nodes


def stashed(monkeypatch):
    import echofold.llm.order_minhash as m

    seen, stash = {}, m.stash

    def counted(df, name):
        out = stash(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(m, "stash", counted)
    return seen


def test_texts_without_a_partner_bring_no_words(spark, monkeypatch):
    rng = random.Random(27)
    word = lambda: f"w{rng.randrange(600)}"
    passage = [word() for _ in range(30)]
    texts = [[*passage, *(word() for _ in range(70))] for _ in range(400)]
    for i in range(0, 20, 2):
        texts[i + 1] = [*texts[i][:50], *(word() for _ in range(14)), *texts[i][64:]]
    crowd, nodes = crowd_of(spark, texts, (1, 2))
    seen = stashed(monkeypatch)
    pairs, n = _crowd_pairs(crowd, nodes, 0.8, 128)
    assert {(i, i + 1) for i in range(0, 20, 2)} <= {(r["a"], r["b"]) for r in pairs.collect()}
    assert seen["rare-words"] <= 21 * 60  # 21 of each of 400 texts before


@pytest.mark.parametrize("batch", [3, 10_000])
def test_classes_of_a_crowd_keep_their_partners(spark, batch):
    # classes in any batches: runs that only texts of one class have count as lacked, those of two do not
    rng = random.Random(28)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    texts = [edited(rng, b, 4, ["x", "y"]) for b in base for _ in range(4)]
    crowd, nodes = crowd_of(spark, texts, (1,))
    crowd = crowd.selectExpr("key", "uid", "CASE WHEN uid % 4 < 2 THEN uid - uid % 4 WHEN uid < 24 THEN uid ELSE uid - uid % 4 END AS root")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        pairs, _ = _crowd_pairs(crowd, nodes, 0.8, 128)
        got = {(r["a"], r["b"]) for r in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    roots = {r["uid"]: r["root"] for r in crowd.collect()}
    hashes = [word_hashes(" ".join(t)) for t in texts]
    like = {(i, j) for j in range(len(texts)) for i in range(j) if roots[i] != roots[j] and alike(hashes[i], hashes[j])}
    assert like and like <= got and all(j < 24 for _, j in got)


def test_values_are_not_counted_where_they_cannot_make_fewer_pairs(spark, monkeypatch):
    texts = [t.split() for t in passage_and_few_words(20)]
    seen = stashed(monkeypatch)
    crowd, nodes = crowd_of(spark, texts, range(5))  # all share all values: no word has fewer pairs by them
    _crowd_pairs(crowd, nodes, 0.8, 2)
    assert seen["used-words"] > 0 and seen["maybe-valued"] == 0
    crowd, nodes = crowd_of(spark, texts, (0,))
    crowd = crowd.selectExpr("uid DIV 2 AS key", "uid", "root")
    pairs, _ = _crowd_pairs(crowd, nodes, 0.8, 2)
    assert seen["maybe-valued"] > 0 and seen["valued-words"] > 0
    assert {(2 * i, 2 * i + 1) for i in range(20)} <= {(r["a"], r["b"]) for r in pairs.collect()}
