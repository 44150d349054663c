"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins. Shallow trees, fitted to the gradient one feature
after the other and round by round with a small step, add up to a lookup table per feature;
then, with those fixed, the pairs of features that explain most of what is left get tables of
their own from trees that cut both. A score is a sum of table entries: bins are found for a
whole batch at once, and the entries added.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

#: Labelled rows that a model is fitted on, at most; drawn by a seeded hash of the id.
SAMPLE_ROWS = 20_000
FOLDS, THRESHOLD = 5, 0.3
FEATURES = (
    "log_chars", "log_words", "upper", "lower", "digit", "space", "newline", "sentence_end", "comma", "symbol", "bang", "pipe", "non_ascii",
    "byte_entropy", "mean_word", "distinct_words", "top_word", "repeated_pairs", "symbol_words", "upper_words", "capital_words", "short_words", "log_line", "distinct_lines", "deflated",
)
_BYTES = {name: np.array([ok(b) for b in range(256)], bool) for name, ok in {
    "upper": lambda b: 65 <= b <= 90, "lower": lambda b: 97 <= b <= 122, "digit": lambda b: 48 <= b <= 57, "space": lambda b: b in (9, 32), "newline": lambda b: b == 10,
    "sentence_end": lambda b: b in b".?", "comma": lambda b: b in b",;:", "symbol": lambda b: b in b"#$%&*+<=>@\\^_`{}~/[]", "bang": lambda b: b == 33, "pipe": lambda b: b == 124, "non_ascii": lambda b: b >= 128,
}.items()}
_SYMBOLS = frozenset("#$%&*!|<>=@^~_{}[]\\/+")
DEFLATE_BLOCK = 1 << 14


def features(text: str | None) -> list[float]:
    """The whole text's features, in the order of ``FEATURES``; null is the empty text, whose shares are 0."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    share = {k: float(seen[m].sum()) / n for k, m in _BYTES.items()}
    p = seen[seen > 0] / n
    words = text.split()
    m = max(1, len(words))
    count = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = text.split("\n")
    deflated = sum(len(zlib.compress(raw[i : i + DEFLATE_BLOCK], 1)) for i in range(0, len(raw), DEFLATE_BLOCK))
    symbols = upper = capital = short = letters = 0
    for w, c in count.items():
        symbols += c * (w[-1] in _SYMBOLS)
        upper += c * (len(w) > 1 and w.isupper())
        capital += c * w[0].isupper()
        short += c * (len(w) <= 2)
        letters += c * len(w)
    return [
        np.log1p(len(text)), np.log1p(len(words)), *share.values(), float(-(p * np.log2(p)).sum()), letters / m, len(count) / m, max(count.values(), default=0) / m,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, symbols / m, upper / m, capital / m, short / m, np.log1p(len(text) / len(lines)), len(set(lines)) / len(lines), deflated / n,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AdditiveModel:
    """``base + sum of tables[j][bin j] + sum of pair tables[bin j, bin k]``, as log odds."""

    def __init__(self, n_features: int, base: float = 0.0):
        self.base, self.cuts = base, [np.array([])] * n_features
        self.tables = [np.zeros(1)] * n_features
        self.pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for table, bins in zip(self.tables, self._bins(x, self.cuts), strict=True):
            out += table[bins]
        for j, k, cj, ck, table in self.pairs:
            out += table[np.searchsorted(cj, x[:, j], side="right"), np.searchsorted(ck, x[:, k], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x)) if len(x) else np.array([])


def _quantile_cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher")) if len(v) else np.array([])


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A step for each bin from a tree with so many leaves: the best cut first."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    gain = lambda a, b: a * a / (b + l2)

    def best(lo: int, hi: int):
        if hi - lo < 2:
            return 0.0, lo
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        ga, hb = g[lo:hi].sum(), h[lo:hi].sum()
        won = gain(a, b) + gain(ga - a, hb - b) - gain(ga, hb)
        won[(b < 0.5) | (hb - b < 0.5)] = 0
        i = int(np.argmax(won))
        return float(won[i]), lo + i + 1

    for _ in range(leaves - 1):
        won, cut, i = max(((*best(*p), i) for i, p in enumerate(parts)), key=lambda x: (x[0], -x[2]))
        if won <= 1e-9:
            break
        lo, hi = parts[i]
        parts[i : i + 1] = [(lo, cut), (cut, hi)]
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + l2)
    return out


def _cross(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best cut of each axis together, and the step for each cell: a tree with four leaves."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ga, hb = a[-1, -1], b[-1, -1]
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    q = lambda s: [s[:-1, :-1], s[:-1, -1:] - s[:-1, :-1], s[-1:, :-1] - s[:-1, :-1], s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + s[:-1, :-1]]
    won = sum(x * x / (y + l2) for x, y in zip(q(a), q(b), strict=True)) - ga * ga / (hb + l2)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    out = np.zeros(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 32, rounds: int = 120, rate: float = 0.12, leaves: int = 3, pair_bins: int = 8, n_pairs: int = 8, pair_rounds: int = 40, l2: float = 1.0) -> AdditiveModel:
    """Fitted to labels 0 and 1. Without both labels the score is the share of 1, smoothed, for all texts."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1)
    model = AdditiveModel(x.shape[1], float(np.log(prior / (1 - prior))))
    if n == 0 or y.min() == y.max():
        return model
    model.cuts = [_quantile_cuts(x[:, j], bins) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    at = model._bins(x, model.cuts)
    f = np.full(n, model.base)

    def gradients():
        p = _sigmoid(f)
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(at):
            if len(model.tables[j]) > 1:
                g, h = gradients()
                size = len(model.tables[j])
                step = rate * _tree(np.bincount(b, g, size), np.bincount(b, h, size), leaves, l2)
                model.tables[j] = model.tables[j] + step
                f += step[b]
    coarse = [_quantile_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    rough = model._bins(x, coarse)
    cell = lambda j, k: (rough[j] * (len(coarse[k]) + 1) + rough[k], (len(coarse[j]) + 1, len(coarse[k]) + 1))
    total = lambda v, c, shape: np.bincount(c, v, shape[0] * shape[1]).reshape(shape)
    g, h = gradients()
    ranked = sorted(((-_cross(total(g, *cell(j, k)), total(h, *cell(j, k)), l2)[0], j, k) for j, k in combinations(range(x.shape[1]), 2)))
    chosen = [(j, k) for won, j, k in ranked[:n_pairs] if won < 0]
    tables = {jk: np.zeros(cell(*jk)[1]) for jk in chosen}
    for _ in range(pair_rounds):
        for jk in chosen:
            c, shape = cell(*jk)
            g, h = gradients()
            step = rate * _cross(total(g, c, shape), total(h, c, shape), l2)[1]
            tables[jk] += step
            f += step.ravel()[c]
    model.pairs = [(j, k, coarse[j], coarse[k], tables[j, k]) for j, k in chosen]
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; null for null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _feature_rows(batch, text_col: str) -> np.ndarray:
    return np.array([features(t) for t in batch[text_col].to_pylist()], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> AdditiveModel:
    """A model of ``label_col`` from rows whose fold is not 0; the only inputs are features of the text.

    At most ``sample_rows`` labelled ids, by a seeded hash, are used; null ids and labels are
    not. Of an id with several labels or texts the smallest counts.
    """
    short_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("y")).where("l_id IS NOT NULL AND y IN (0, 1)").where(fold(F.col("l_id")) != 0)
    sample = usable.groupBy("l_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("l_id", F.lit(seed)), "l_id").limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), F.col("id") == F.col("l_id")).groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            x = _feature_rows(b, "text")
            yield pa.RecordBatch.from_arrays([b["id"], b["y"], pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = sorted((r["id"], r["y"], tuple(r["x"])) for r in found.mapInArrow(run, "id long, y int, x array<double>").collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in rows], float))


def add_scores(docs: DataFrame, model: AdditiveModel, *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the model's score (0 to 1) of each whole text; an equally named column is replaced."""
    short_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(_feature_rows(b, text_col)), pa.float64())], [*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a null id is not held out."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return add_scores(base, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not predicted 0, with their columns, whatever these are called."""
    out_col = "score"
    while out_col in docs.columns:
        out_col += "_"
    scored = add_scores(docs, train(docs, labels, **options), out_col=out_col)
    return scored.where(F.col(out_col) >= THRESHOLD).drop(out_col)
