"""Near-duplicate documents by Order MinHash and banded alignment.

The words of a text in runs of five are its k-mers, each labelled with how often the same run
occurred before it. Under each of ``bands`` hash functions the ``order`` smallest labelled
k-mers are taken, in the order in which they stand in the text: texts share such a value with
a chance that grows with their edit similarity, as it asks for the same k-mers in the same
order. Texts that share a value are compared by an alignment of their words in a band of
diagonals as wide as the similarity allows; those of at least ``similarity`` are linked, and
the connected texts are one class.

Equal texts are one node from the start. The texts of a value stand in one sorted run, cut
over tasks by value and text, so that no value is too common for a task. First each is
compared with the first text of its run. Then, class by class, the texts that are outside the
main class of a run are compared with all others of it. Runs that hold more than ``REST`` such
texts have a passage in common and little else: of their pairs across classes those are compared
that share one of their rarest words, a fifth of each text and one. Others cannot be alike, as
too few words are left to share, so no pair of such a run is lost. Pairs are made
where parities of the counts of all their words allow the likeness, mostly at one of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, short_batches, stash

WORDS, BANDS, ORDER, SIMILARITY = 5, 88, 2, 0.8
#: Texts of a run outside its main class that are compared with the whole run.
REST = 32
#: Counters that tell rare words from frequent ones; texts of a word from which on its pairs are counted, with and without values.
COUNTERS, HOT = 1 << 16, 128
#: Longs of a text's parities; its last words, and least values, by which a pair is told to meet at another one.
PARITIES, LATER = 16, 64
#: Words of the runs by which texts without any partner are told, and runs of words that a task looks at together.
RUN, PART = 2, 1 << 18
#: Words of texts that are anchored together.
ANCHORED = 1 << 18
#: Cells of a sketch, and of an alignment, that are made together.
CELLS, LANES = 1 << 18, 1 << 16
#: Rows of small columns for each task of a table that is read again.
ROWS = 1 << 16
#: Buckets of words for the bound that spares most alignments.
BUCKETS = 256
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS = _mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    """A 32-bit hash of each word, in order; words lie between white space."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint64, len(words))


def labelled_kmers(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Hashes of runs of ``k`` words and of how often each occurred before; a shorter text is one run."""
    n = len(words) - k + 1
    if n < 1:
        words, n = np.concatenate([words, np.full(k - len(words), len(words), np.uint64)]), 1
    mixed, h = _mix(words + _M2), np.zeros(n, np.uint64)
    for i in range(k):
        h += mixed[i : i + n] * _POWERS[i % 64]
    ranked = np.sort(h)
    if (ranked[1:] == ranked[:-1]).any():
        order = np.argsort(h, kind="stable")
        s = h[order]
        first = np.concatenate([[True], s[1:] != s[:-1]])
        nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = nth.astype(np.uint64)
        h = h + occurrence * np.uint64(0x9E3779B97F4A7C15)
    return _mix(h)


def order_sketch(words: np.ndarray, bands: int = BANDS, order: int = ORDER, k: int = WORDS, first: int = 0) -> np.ndarray:
    """One 64-bit value a band: its ``order`` smallest labelled k-mers in text order (all, if fewer).

    The bands are those from number ``first`` on. They are hashed together as far as ``CELLS``
    allow, so a very long text takes no more memory.
    """
    kmers = labelled_kmers(words, k)
    seeds = _mix(np.arange(first + 1, first + bands + 1, dtype=np.uint64))
    n, out, step = len(kmers), [], max(1, CELLS // len(kmers))
    short = (kmers >> np.uint64(32)).astype(np.uint32)
    for i in range(0, bands, step):
        seed = seeds[i : i + step]
        if n <= order:
            places = np.broadcast_to(np.arange(n), (len(seed), n))
        else:
            h = short[None, :] * (seed | np.uint64(1)).astype(np.uint32)[:, None]
            h ^= np.uint32(1 << 31)  # signed order is that of the unsigned product
            h, rows, found = h.view(np.int32), np.arange(len(seed)), []
            for _ in range(order):
                found.append(h.argmin(1))
                h[rows, found[-1]] = np.iinfo(np.int32).max
            places = np.sort(np.stack(found, 1), axis=1)
        v = _mix(seed)
        for j in range(places.shape[1]):
            v = _mix(v * np.uint64(31) + kmers[places[:, j]])
        out.append(v)
    return np.concatenate(out)


def _extend(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, pa_: np.ndarray, pb: np.ndarray, power: np.ndarray) -> np.ndarray:
    """How far a[i:] and b[j:] agree, for arrays of i and j: by halving over prefix hashes, then exactly as those say."""
    lo, hi = np.zeros(len(i), np.int64), np.minimum(len(a) - i, len(b) - j)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = np.where(open_, (lo + hi + 1) // 2, lo)
        same = pa_[i + mid] - pa_[i] * power[mid] == pb[j + mid] - pb[j] * power[mid]
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of ``a`` and ``b``, or ``most + 1`` if it is larger.

    Only the diagonals within ``most`` of the ends are followed. For each number of edits the
    furthest cell of each diagonal is kept, all diagonals at once.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if n == m and (a == b).all():
        return 0
    longest = max(n, m)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.ones(longest + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(longest, base, np.uint64))

    def prefix(x: np.ndarray) -> np.ndarray:
        # p[k] = x[0] * base**(k-1) + ... + x[k-1]; as sums of x[i] / base**i, times base**(k-1)
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.ones(len(x) + 1, np.uint64)
        back[1:] = np.multiply.accumulate(np.full(len(x), inv, np.uint64))
        return np.concatenate([[np.uint64(0)], np.add.accumulate(x * back[1:])]).astype(np.uint64) * power[: len(x) + 1]

    pa_, pb = prefix(a), prefix(b)
    goal = m - n  # the diagonal j - i of the last cell
    far = np.array([-1], np.int64)  # furthest i on diagonals lo .. hi
    lo = hi = 0
    far[0] = _extend(a, b, np.zeros(1, np.int64), np.zeros(1, np.int64), pa_, pb, power)[0]
    for e in range(most + 1):
        if lo <= goal <= hi and far[goal - lo] >= n:
            return e
        if e == most:
            break
        slack = most - e - 1
        new_lo, new_hi = max(lo - 1, goal - slack, -n), min(hi + 1, goal + slack, m)
        if new_lo > new_hi:
            break
        d = np.arange(new_lo, new_hi + 1)
        pad = np.full(len(far) + 4, -2, np.int64)
        pad[2:-2] = far
        at = d - lo + 2
        get = lambda k: np.where((k >= 0) & (k < len(pad)), pad[np.clip(k, 0, len(pad) - 1)], -2)  # noqa: B023, E731
        i = np.maximum(np.maximum(get(at) + 1, get(at + 1) + 1), get(at - 1))  # change, delete from a, insert from b
        i = np.minimum(np.minimum(i, n), m - d)
        ok = (i >= 0) & (i + d >= 0)
        start = np.where(ok, i, 0)
        j = np.where(ok, i + d, 0)
        far = np.where(ok, start + _extend(a, b, start, j, pa_, pb, power), -2)
        lo, hi = new_lo, new_hi
    return most + 1


def edit_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """1 - distance / the longer length."""
    longest = max(len(a), len(b))
    return 1 - banded_distance(a, b, longest) / longest if longest else 1.0


def anchored_at_most(pairs: list[tuple[np.ndarray, np.ndarray]], k: int = 3) -> np.ndarray:
    """Upper bounds of the edit distances of ``pairs``: of alignments along the runs of ``k`` words that both have once.

    Kept are those runs that stand in one order with all others. What lies between two of
    them costs the longer side; all pairs are treated together.
    """
    sides = []
    for texts in zip(*pairs, strict=True):
        size = np.array([len(x) for x in texts], np.int64)
        end = np.cumsum(size)
        words, of = np.concatenate(texts).astype(np.uint64), np.repeat(np.arange(len(texts)), size)
        place = np.arange(len(words)) - np.repeat(end - size, size)
        h = _mix(of.astype(np.uint64) + _M1)
        for i in range(k):
            h = _mix(h * np.uint64(31) + np.roll(words, -i))
        own = np.flatnonzero(place + k <= size[of])
        by = own[np.argsort(h[own], kind="stable")]
        s = h[by]
        differ = s[1:] != s[:-1]
        alone = np.ones(len(s), bool)
        alone[1:] &= differ
        alone[:-1] &= differ
        once = by[alone]
        sides.append((size, h[once], place[once], of[once]))
    (n, ha, ia, of), (m, hb, jb, _) = sides
    if not len(ha) or not len(hb):
        return np.maximum(n, m)
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    of, i, j = of[both], ia[both], jb[at[both]]
    by = np.lexsort((i, of))
    of, i, j = of[by], i[by], j[by]
    # pair by pair, as the offsets keep pairs apart
    wide = j + of * (int(max(m.max(), 1)) + 1)
    ok = (np.maximum.accumulate(wide) == wide) & (np.minimum.accumulate(wide[::-1])[::-1] == wide)
    of, i, j = of[ok], i[ok], j[ok]
    if not len(of):
        return np.maximum(n, m)
    di, dj, same = np.diff(i), np.diff(j), of[1:] == of[:-1]
    # a run matches all its words, or only its first where the next overlaps it on another diagonal
    cost = np.where((di == dj) | (np.minimum(di, dj) >= k), np.maximum(np.maximum(di, dj) - k, 0), np.maximum(di, dj) - 1)
    out = np.bincount(of[1:][same], cost[same], len(pairs)).astype(np.int64)
    first, last = np.flatnonzero(np.concatenate([[True], ~same])), np.flatnonzero(np.concatenate([~same, [True]]))
    out[of[first]] += np.maximum(i[first], j[first])
    out[of[last]] += np.maximum(n[of[last]] - i[last], m[of[last]] - j[last]) - k
    none = np.bincount(of, minlength=len(pairs)) == 0
    return np.where(none, np.maximum(n, m), out)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether 1 - distance / the longer length is at least ``least``; two empty texts are alike.

    Bounds from below and above decide most pairs; only between them is the distance made.
    """
    longest = max(len(a), len(b))
    if longest == 0:
        return True
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # words that the other lacks have to go or change, each for one edit at least
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if longest - int(np.minimum(ca[ia], cb[ib]).sum()) > most:
        return False
    return int(anchored_at_most([(a, b)])[0]) <= most or banded_distance(a, b, most) <= most


def _bags(words: list[np.ndarray], buckets: int) -> np.ndarray:
    """How many words of each text fall in each bucket."""
    sizes = np.array([len(x) for x in words], np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * buckets + (np.concatenate(words) % np.uint64(buckets)).astype(np.int64)
    return np.bincount(at, minlength=len(words) * buckets).reshape(len(words), buckets).astype(np.int32)


def _gap(one: list[np.ndarray], other: list[np.ndarray], buckets: int) -> np.ndarray:
    """For each pair the larger count of those that the other lacks, as far as buckets tell them apart."""
    gap = _bags(one, buckets) - _bags(other, buckets)
    return np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))


def _inner(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of both without their common start and end; the edit distance is the same."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def aligned_within(pairs: list[tuple[np.ndarray, np.ndarray]], most: np.ndarray) -> np.ndarray:
    """Which pairs have a word edit distance of at most their ``most``: alignments row by row, a pair a lane.

    Only the diagonals that a path of ``most`` edits can reach are followed. Lanes whose row
    has no cell within their bound end early. The first text of a pair is the shorter one.
    """
    out = np.zeros(len(pairs), bool)
    n = np.array([len(a) for a, _ in pairs], np.int64)
    m = np.array([len(b) for _, b in pairs], np.int64)
    goal = m - n
    slack = (most - goal) // 2
    by = np.argsort(n * (most + 1), kind="stable")
    at = 0
    while at < len(by):
        width = int((goal + 2 * slack + 1)[by[at]])
        take = max(1, LANES // max(1, width))
        own = by[at : at + take]
        at += take
        own = own[slack[own] >= 0]
        if not len(own):
            continue
        low, width = int(slack[own].max()), int((goal + slack)[own].max() + slack[own].max() + 1)
        rows = int(n[own].max())
        high = int(max(rows + width + 1, m[own].max() + low + 1))
        kind = np.int16 if high + rows < 12_000 else np.int32
        a = np.full((rows, len(own)), -1, np.int64)
        b = np.full((high, len(own)), -2, np.int64)
        for lane, p in enumerate(own):
            a[: n[p], lane] = pairs[p][0]
            b[low : low + m[p], lane] = pairs[p][1]
        a, b = a.astype(np.int32), b.astype(np.int32)  # the lower 32 bits tell words apart
        step = np.arange(width, dtype=kind)[:, None]
        far = kind(10_000 if kind is np.int16 else 1 << 29)
        row = np.where(step >= low, step - kind(low), far) + np.zeros((1, len(own)), kind)
        lanes, bound, length = np.arange(len(own)), most[own].astype(kind), n[own]
        for i in range(rows + 1):
            ends = length == i
            if ends.any():
                done = lanes[ends]
                out[own[done]] = row[goal[own[done]] + low, np.flatnonzero(ends)] <= most[own[done]]
            if i % 16 == 15 or ends.any():
                keep = ~ends & (row.min(0) <= bound)
                if not keep.all():
                    lanes, row, bound, length, a, b = lanes[keep], row[:, keep], bound[keep], length[keep], a[:, keep], b[:, keep]
            if not len(lanes) or i == rows:
                break
            new = row + (a[i] != b[i : i + width])
            np.minimum(new[:-1], row[1:] + kind(1), out=new[:-1])
            new -= step
            np.minimum.accumulate(new, axis=0, out=new)
            new += step
            np.minimum(new, far, out=new)
            row = new
    return out


def _blocks(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ends of consecutive blocks of at most ``most`` together, or of one that is larger."""
    starts, total = [0], 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            starts.append(i)
            total = 0
        total += size
    return list(zip(starts, [*starts[1:], len(sizes)], strict=True))


def alike_pairs(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """For each pair of word hashes whether 1 - distance / the longer length is at least ``least``.

    Two empty texts are alike. Words that one text lacks have to go or change, each for one
    edit at least: counts of words in buckets decide most pairs that are not alike, and
    alignments along common runs most of those that are. The others are aligned in full.
    """
    longest = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    most = ((1 - least) * longest + 1e-9).astype(np.int64)
    out = longest == 0
    left = np.array([i for i, (a, b) in enumerate(pairs) if longest[i] and abs(len(a) - len(b)) <= most[i]], np.int64)
    two = lambda w: w[:-1] * _M1 + w[1:] >> np.uint64(40)  # noqa: E731  an edit changes two of these at most
    for form, edits, buckets, from_, step in ((lambda w: w, 1, BUCKETS, 1, 1024), (two, 2, 16 * BUCKETS, 512, 64)):
        some, rest = left[longest[left] >= from_], left[longest[left] < from_]
        ok = [block[_gap(*([form(pairs[i][side]) for i in block] for side in (0, 1)), buckets) <= edits * most[block]] for block in (some[k : k + step] for k in range(0, len(some), step))]
        left = np.concatenate([rest, *ok])
    inner = [_inner(*pairs[i]) for i in left]
    if len(left):
        at_most = np.concatenate([anchored_at_most(inner[i:j]) for i, j in _blocks([len(a) + len(b) for a, b in inner], ANCHORED)])
        out[left] = np.minimum(at_most, [max(len(a), len(b)) for a, b in inner]) <= most[left]
        inner, left = [p for p, same in zip(inner, out[left], strict=True) if not same], left[~out[left]]
    if len(left):
        out[left] = aligned_within([(a, b) if len(a) <= len(b) else (b, a) for a, b in inner], most[left])
    return out


def _nodes(docs: DataFrame, id_col: str, text_col: str, bands: int, order: int, k: int) -> DataFrame:
    """(uid, node, least, n, words, sketch): a row for each distinct text, with its smallest id. ``uid`` is a number of its own."""

    def run(batches):
        for b in batches:
            words = [word_hashes(t) for t in b["text"].to_pylist()]
            sketch = np.array([order_sketch(w, bands, order, k) for w in words], np.uint64).reshape(-1)
            yield pa.RecordBatch.from_arrays([b["node"], b["least"], pa.array([len(w) for w in words], pa.int64()), _lists(words, np.int32), _lists(sketch.reshape(len(words), -1), np.int64)], ["node", "least", "n", "words", "sketch"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("node"))
    texts = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("text").alias("text"))
    return texts.mapInArrow(run, "node binary, least long, n long, words array<int>, sketch array<long>").withColumn("uid", F.monotonically_increasing_id())


def _lists(rows, kind) -> pa.Array:
    """A list of unsigned numbers for each row, as signed ones of the same bits."""
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.astype(np.uint32 if kind is np.int32 else np.uint64).view(kind)))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in as many tasks as its number of ``rows`` asks for, at most those it has: rounds over small tables cost their tasks."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def _counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """``df`` stashed, and its number of rows, counted while it is written."""
    seen = Observation()
    out = stash((df if rows is None else _few(df, rows)).observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def _runs(sketches: DataFrame) -> tuple[DataFrame, int]:
    """(key, uid, n, head, head_n), and about how many such rows, for each text of each value (``sketch``) that several texts have; ``head`` is one of them.

    Rows are sorted by value and text and cut anywhere, so a value of very many texts is
    spread over tasks. ``head`` is the first of its value in the task. A value at either end
    of a task's rows may go on in the next: its heads there are told apart by ``edge`` rows,
    from which they get a head in common.
    """
    keyed = sketches.select("uid", "n", F.explode("sketch").alias("key"))
    ranged = keyed.repartitionByRange("key", "uid").sortWithinPartitions("key", "uid")

    def run(batches):
        head = None  # (key, uid, n) of the run that is open, and whether it has its own row already
        first, shown = True, False
        names = ["key", "uid", "n", "head", "head_n", "edge"]

        def batch(cols, edge):
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([edge] * len(cols[0]), pa.bool_())], names)

        for b in batches:
            if not b.num_rows:
                continue
            key, uid, n = (b[c].to_numpy(zero_copy_only=False) for c in ("key", "uid", "n"))
            if head is not None:
                if not shown:  # the run's first row waits for a second
                    key, uid, n = (np.concatenate([[h], x]) for h, x in zip(head, (key, uid, n), strict=True))
                elif key[0] == head[0]:
                    go = int(np.argmax(key != head[0])) if (key != head[0]).any() else len(key)
                    yield batch([key[:go], uid[:go], n[:go], np.full(go, head[1]), np.full(go, head[2])], False)
                    key, uid, n = key[go:], uid[go:], n[go:]
                    if not len(key):
                        continue
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            if first:
                yield batch([key[:1], uid[:1], n[:1], uid[:1], n[:1]], True)
                first = False
            of = np.repeat(start, size)
            in_run = np.repeat(size > 1, size)
            if in_run.any():
                yield batch([key[in_run], uid[in_run], n[in_run], uid[of[in_run]], n[of[in_run]]], False)
            head, shown = (key[start[-1]], uid[start[-1]], n[start[-1]]), bool(size[-1] > 1)
        if head is not None:
            yield batch([np.array([x]) for x in (*head, *head[1:])], True)

    cut, rows = _counted(ranged.mapInArrow(run, "key long, uid long, n long, head long, head_n long, edge boolean"), "runs")
    ends = _few(cut.where("edge").select("key", "uid", "n"), rows).distinct()
    joint = ends.groupBy("key").agg(F.min(F.struct("uid", "n")).alias("least"), F.count(F.lit(1)).alias("heads")).where("heads > 1")
    linked = ends.join(joint.hint("merge"), "key").select("key", "uid", "n", F.col("least.uid").alias("head"), F.col("least.n").alias("head_n"))
    linked = stash(_few(linked, 1), "edges-of-tasks")
    return cut.where("NOT edge").drop("edge").unionByName(linked), rows


def _words_of(b: pa.RecordBatch, col: str = "words") -> list[np.ndarray]:
    at, flat = b[col].offsets.to_numpy(), b[col].values.to_numpy().view(np.uint32)
    return [flat[at[i] : at[i + 1]].astype(np.uint64) for i in range(b.num_rows)]


def _near(least: float, a: str, b: str):
    """Whether lengths ``a`` and ``b`` allow the likeness."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-6


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) of at least ``least``. Words are fetched by sort-merge joins, whose hot keys Spark splits."""
    left = nodes.select(F.col("uid").alias("a"), F.col("words").alias("words_a"))
    right = nodes.select(F.col("uid").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")

    def run(batches):
        for b in batches:
            keep = alike_pairs(list(zip(_words_of(b, "words_a"), _words_of(b, "words_b"), strict=True)), least)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node is connected to; each round is a written table.

    Large-star and small-star: every node hands its larger, then its smaller neighbours to
    the smallest node it knows, until nothing changes. Neighbours are never gathered: a
    node's smallest is an aggregate, which each task forms in part, and is joined back.
    """

    def written(df: DataFrame, name: str, rows: int):
        seen = Observation()
        out = stash(_few(df, rows).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
        return out, (seen.get["n"], seen.get["h"])

    linked, rows = _counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), "links")
    edges, before = written(_few(linked, rows).distinct(), "edges", rows)
    discard(linked)
    while True:
        rows = 2 * before[0]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low.hint("merge"), F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stash(_few(_few(large, rows).distinct(), rows), "large")
        low_again = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = large.join(low_again.hint("merge"), F.col("u") == F.col("n")).select("u", "v", "m")
        each = _few(small, rows).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        new, after = written(each.distinct(), "edges", rows)
        discard(edges, large)
        if after == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges, before = new, after


def _second_looks(runs: DataFrame, n_rows: int, roots: DataFrame, rest: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) across classes in runs of at most ``rest`` texts outside the main class, and (key, uid, root) of the other runs."""
    classed = runs.select("key", "uid", "n").join(roots.hint("merge"), F.col("uid") == F.col("node"), "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root"))
    rows = stash(_few(classed, n_rows), "classed")
    sizes = _few(rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")), n_rows).groupBy("key").agg(F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("c"))
    mixed = stash(_few(sizes.where("c > main.c").select("key", F.col("main.root").alias("main"), (F.col("c") - F.col("main.c")).alias("others")), n_rows), "mixed")
    few = mixed.where(F.col("others") <= rest).select("key", "main")
    around = rows.join(few.hint("merge"), "key")
    outside = around.where("root <> main").select("key", F.col("uid").alias("x"), F.col("n").alias("n_x"), F.col("root").alias("root_x"))
    both = around.join(outside.hint("merge"), "key").where("root <> root_x AND (root = main OR uid < x)").where(_near(least, "n", "n_x"))
    pairs = both.select(F.least("x", "uid").alias("a"), F.greatest("x", "uid").alias("b"))
    return _few(pairs, n_rows), _few(rows.join(mixed.where(F.col("others") > rest).select("key").hint("merge"), "key", "left_semi"), n_rows).select("key", "uid", "root")


def rarest(words: np.ndarray, seen: np.ndarray, least: float) -> np.ndarray:
    """The rarest words, rarest first, of which a text of likeness ``least`` has one among its own rarest.

    Words are told apart by how often they occurred before. Alike texts share all words of the
    longer one but as many as it allows edits; with one more of the first in any order that holds
    for all texts, each has one that they share. ``seen`` are the counters that make the order.
    """
    words_ = labelled_kmers(words, 1)
    return words_[np.lexsort((words_, seen[words_ >> np.uint64(48)]))[: int((1 - least) * len(words) + 1e-9) + 1]]


def parities(words: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """A bit for each of 64 * ``longs`` buckets: whether it has an odd number of the labelled words.

    Bits that differ between two texts are at most the words that one has and the other lacks.
    """
    odd = np.bincount((labelled_kmers(words, 1) % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def lost_share(k: int, least: float) -> float:
    """How many runs of ``k`` words a text has at most that one of likeness ``least`` lacks, as a share of its words.

    A change or a removal costs ``k`` runs, an added word ``k - 1``: a longer text allows more
    edits, but as many of them are additions as it is longer.
    """
    each = k * (1 - least)
    return each + max(0.0, each - 1) * (1 / least - 1)


def lone_runs(kmers: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """For each of ``kmers``, found in a text of class ``roots``, whether no other class has it."""
    by = np.argsort(kmers, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], kmers[by][1:] != kmers[by][:-1]]))
    low, high = (f.reduceat(roots[by], starts) for f in (np.minimum, np.maximum))
    out = np.empty(len(kmers), bool)
    out[by] = np.repeat(low == high, np.diff(np.append(starts, len(by))))
    return out


def _partnered(texts: DataFrame, sizes: tuple[int, int], least: float) -> tuple[DataFrame, tuple[int, int]]:
    """Those of ``texts`` (uid, words, root) that may be alike one of another class, and ``sizes``: how many, and of how many words.

    A text of which all other classes together lack more runs of ``RUN`` words than the likeness
    allows is alike none of them. Runs are sent in arrays by their hash; those that several
    classes of a batch have go once, without their texts, so that no run is too common for a task.
    What is left is looked at again, as long as a fourth or more of it goes.
    """
    while sizes[0]:
        parts = sizes[1] // PART + 1  # a text has a row of each

        def spread(batches, parts=parts):
            for b in batches:
                if not b.num_rows:
                    continue
                runs = [labelled_kmers(w, RUN) for w in _words_of(b)]
                uid, root = (np.repeat(b[c].to_numpy(), [len(r) for r in runs]) for c in ("uid", "root"))
                runs = np.concatenate(runs)
                lone = lone_runs(runs, root)
                shared, at = np.unique(runs[~lone], return_index=True)
                low, at_other = root[~lone][at], np.full(len(shared), -1)
                # another class of the batch than the first one's, for runs that several have
                differs = np.flatnonzero(~lone)[root[~lone] != low[np.searchsorted(shared, runs[~lone])]]
                at_other[np.searchsorted(shared, runs[differs])] = differs
                runs = np.concatenate([runs[lone], shared, shared])
                root = np.concatenate([root[lone], low, root[at_other]])
                uid = np.concatenate([uid[lone], np.full(2 * len(shared), -1)])
                part = (runs % np.uint64(parts)).astype(np.int64)
                by = np.argsort(part, kind="stable")
                has, start = np.unique(part[by], return_index=True)
                ends = pa.array(np.append(start, len(by)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(has), *(pa.ListArray.from_arrays(ends, pa.array(x[by].view(np.int64))) for x in (runs, uid, root))], ["part", "runs", "uids", "roots"])

        def lacking(table: pa.Table) -> pa.Table:
            runs, uid, root = (np.concatenate([c.flatten().to_numpy() for c in table[name].chunks]) for name in ("runs", "uids", "roots"))
            lone, n = np.unique(uid[lone_runs(runs, root) & (uid >= 0)], return_counts=True)
            return pa.table({"node": pa.array(lone, pa.int64()), "lacks": pa.array(n, pa.int64())})

        sent = texts.mapInArrow(spread, "part long, runs array<long>, uids array<long>, roots array<long>")
        lacks = sent.groupBy("part").applyInArrow(lacking, "node long, lacks long").groupBy("node").agg(F.sum("lacks").alias("lacks"))
        bound = F.floor(F.size("words") * lost_share(RUN, least) + 1e-9)
        left = texts.join(lacks.hint("merge"), F.col("uid") == F.col("node"), "left").where(F.coalesce("lacks", F.lit(0)) <= bound)
        before = sizes[0]
        left, sizes = _sized(left.select("uid", "words", "root"), "partnered-texts")
        discard(texts)
        texts = left
        if 4 * sizes[0] > 3 * before:
            break
    return texts, sizes


def _sized(texts: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """``texts`` stashed, how many they are, and how many words they have."""
    seen = Observation()
    out = stash(texts.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("words")), name)
    return out, (seen.get["n"], seen.get["words"])


def _crowd_pairs(crowd: DataFrame, nodes: DataFrame, least: float, hot: int) -> tuple[DataFrame, int]:
    """Pairs (a, b), and how many, across classes in the runs of ``crowd`` (key, uid, root), but for those whose words exclude the likeness.

    Texts meet by their rarest words. A word of more than ``hot`` texts brings together only
    those that share a value as well, if that makes fewer pairs. Pairs of which one lacks too
    many words of the other, as told by parities, are not made. A pair that shares one of the last
    ``LATER`` of such words of both is not made at the words before it, and likewise for values:
    it is always made at its last word and, if asked for, its least value.
    """
    of = crowd.select("uid", "root").distinct()
    texts, sizes = _sized(nodes.select("uid", "words").join(of.hint("merge"), "uid"), "crowded-texts")
    texts, _ = _partnered(texts, sizes, least)
    values = stash(crowd.select("uid", "key").join(texts.select("uid").hint("merge"), "uid", "left_semi").distinct(), "crowd-values")

    def count(batches):
        seen = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for w in _words_of(b):
                np.add.at(seen, (labelled_kmers(w, 1) >> np.uint64(48)).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "n"])

    counted = texts.select("words").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(COUNTERS, np.int64)
    seen[counted["at"].to_numpy()] = counted["n"].to_numpy()

    odd = [f"odd{i}" for i in range(PARITIES)]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            words = _words_of(b)
            first = [rarest(w, seen, least) for w in words]
            sizes = [len(f) for f in first]
            whole = np.repeat([len(w) for w in words], sizes)
            place = np.concatenate([np.arange(k) for k in sizes])
            uid, root = (np.repeat(b[c].to_numpy(), sizes) for c in ("uid", "root"))
            word = np.concatenate(first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (word, uid, root, whole, place)], ["word", "uid", "root", "n", "place"])

    def mark(batches):
        for b in batches:
            words = _words_of(b)
            bits = np.array([parities(w) for w in words], np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays([b["uid"], *(pa.array(x) for x in bits.T)], ["uid", *odd])

    words = stash(texts.mapInArrow(run, "word long, uid long, root long, n long, place long"), "rare-words")
    use = words.groupBy("word").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("word", "c")
    used = stash(words.join(use.hint("merge"), "word"), "used-words")
    marks = stash(texts.mapInArrow(mark, "uid long, " + ", ".join(f"{c} long" for c in odd)), "marks")
    discard(texts, words)
    # of the words' texts and values, squares sum up to no less than those of even parts
    kinds, each = values.select("key").distinct().count(), values.groupBy("uid").agg(F.count(F.lit(1)).alias("v"))
    hots = used.where(F.col("c") > hot).join(each.hint("merge"), "uid").groupBy("word").agg(F.sum("v").cast("double").alias("v"), F.first("c").cast("double").alias("c"))
    maybe = stash(hots.where(F.col("v") * F.col("v") < F.col("c") * F.col("c") * kinds).select("word"), "maybe-valued")
    by_value = used.join(maybe.hint("merge"), "word", "left_semi").join(values.hint("merge"), "uid").groupBy("word", "key").agg(F.count(F.lit(1)).cast("double").alias("k"), F.first("c").cast("double").alias("c"))
    fewer = stash(by_value.groupBy("word").agg(F.sum(F.col("k") * F.col("k")).alias("k"), F.first("c").alias("c")).where("k < c * c").select("word", F.lit(True).alias("fewer")), "valued-words")
    lasts = used.groupBy("uid").agg(F.expr(f"slice(sort_array(collect_list(struct(place, word)), false), 1, {LATER})").alias("lasts"))
    whole = used.drop("c").join(marks.join(lasts.hint("merge"), "uid").hint("merge"), "uid")
    whole = whole.withColumn("words", F.expr("transform(filter(lasts, x -> x.place > place), x -> x.word)"))
    marked = whole.select("word", "uid", "root", "n", "words", *odd).join(fewer.hint("merge"), "word", "left")
    none = F.array().cast("array<long>")
    smallest = values.groupBy("uid").agg(F.expr(f"slice(sort_array(collect_list(key)), 1, {LATER})").alias("smallest"))
    valued = marked.where("fewer").join(values.join(smallest.hint("merge"), "uid").hint("merge"), "uid")
    valued = valued.withColumn("word", F.xxhash64("word", "key")).withColumn("values", F.expr("filter(smallest, x -> x < key)"))
    plain = marked.where("fewer IS NULL").withColumn("values", none)
    columns = ["word", "uid", "root", "n", "words", "values", *odd]
    slots = plain.select(columns).unionByName(valued.select(columns))
    one, other = (slots.select("word", *(F.col(c).alias(f"{c}_{side}") for c in columns[1:])) for side in "ab")
    longer, differ = F.greatest("n_a", "n_b"), sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in odd), F.lit(0))
    edits = F.floor((1 - least) * longer + 1e-9)
    met = one.join(other.hint("merge"), "word").where("uid_a < uid_b AND root_a <> root_b").where(_near(least, "n_a", "n_b"))
    met = met.where(differ <= F.col("n_a") + F.col("n_b") - 2 * (longer - edits))
    met = met.where(~F.arrays_overlap("words_a", "words_b") & ~F.arrays_overlap("values_a", "values_b"))
    pairs, n = _counted(met.select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b")).distinct(), "crowd-pairs")
    discard(used, marks, maybe, fewer, values)
    return pairs, n


def near_links(nodes: DataFrame, least: float, rest: int = REST, hot: int = HOT) -> DataFrame:
    """(node, root) of the linked among ``nodes`` (uid, n, words, sketch), each a distinct text."""
    runs, n = _runs(nodes.select("uid", "n", "sketch"))
    star = runs.where("uid <> head").where(_near(least, "n", "head_n")).select(F.least("head", "uid").alias("a"), F.greatest("head", "uid").alias("b"))
    asked, n_asked = _counted(_few(star, n).distinct(), "pairs", n)
    found = stash(_verified(asked, nodes, least), "links")
    roots = components(found)
    pairs, crowd = _second_looks(runs, n, roots, rest, least)
    crowd, n_crowd = _counted(crowd, "crowd", n)
    if n_crowd:
        met, m = _crowd_pairs(crowd, nodes, least, hot)
        pairs, n = pairs.unionByName(met), n + m
    pairs = _few(pairs.distinct(), n).join(asked.hint("merge"), ["a", "b"], "left_anti")
    pairs, _ = _counted(pairs, "pairs", n)
    links = stash(_verified(pairs, nodes, least), "links")
    discard(asked, crowd, pairs)
    return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, bands: int = BANDS, order: int = ORDER, similarity: float = SIMILARITY, rest: int = REST, hot: int = HOT) -> DataFrame:
    """(doc_id, node, root, class_id) of every row: rows of one class are connected by likeness.

    ``node`` is the MD5 of the text, ``root`` tells classes apart, ``class_id`` is the smallest
    id of the class, null if all its ids are. Null and empty texts are equal and so one class.
    Texts with fewer than ``k`` words have one k-mer. Repeated rows are rows of one class; an
    empty table gives none. Only the two named columns are read, so others cannot clash.

    All texts of different classes that share a value are compared, unless their words exclude
    the likeness. Pairs share one with a chance that grows with their likeness: with the defaults, of pairs
    of 200 words with changes at random places, more than 0.9 at a likeness of 0.8 and all but
    one in 10,000 from 0.88 on.
    """
    short_batches(docs.sparkSession)
    nodes, n = _counted(_nodes(docs, id_col, text_col, bands, order, k), "nodes")
    roots = near_links(nodes, similarity, rest, hot)
    placed = nodes.select("uid", F.col("node").alias("md5"), "least").join(roots.hint("merge"), F.col("uid") == F.col("node"), "left").select("md5", "least", F.coalesce("root", "uid").alias("root"))
    placed = stash(_few(placed, n), "placed")
    discard(nodes)
    ids = placed.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = stash(_few(placed.join(ids.hint("merge"), "root").select("md5", "root", "class_id"), n), "classes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"))
    return rows.join(classes.hint("merge"), F.col("node") == F.col("md5")).select("doc_id", "node", "root", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each class, with its columns: that of the smallest id and, of equal ids, the smallest MD5.

    Of rows that are equal in both, the other columns are compared as JSON, so reruns keep the same.
    """
    classes = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("node"))
    kept = stash(classes.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.doc_id").alias("id"), F.col("first.node").alias("node")), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    others = F.to_json(F.struct(*(docs[c] for c in docs.columns if c != text_col)))
    whole = docs.select(F.unhex(F.md5(text)).alias("own"), F.col(id_col).cast("long").alias("own_id"), others.alias("others"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = whole.join(kept.hint("merge"), (F.col("own") == F.col("node")) & F.col("own_id").eqNullSafe(F.col("id")))
    one = found.groupBy("own").agg(F.min_by("row", "others").alias("row"))
    return one.select("row.*")
