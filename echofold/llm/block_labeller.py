"""HTML extraction by a recurrent block labeller.

A page is its sequence of leaf blocks. Each block is a vector: the tags above it and hashed
words of their classes, hashed words of its text, and a few counts. A bidirectional LSTM, in
numpy, reads the sequence from both ends, so each block is labelled knowing the whole page;
blocks labelled as article are the text. The network is trained here, on made-up pages of
known labels, from a fixed seed.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches
from .html_blocks import HINTS, TAGS, blocks
from .html_samples import labelled

WORDS, COUNTS, HIDDEN = 32, 10, 24
PATH = 2 * len(TAGS) + HINTS
#: Pages and epochs of training; pages labelled together.
SAMPLE_PAGES, EPOCHS, BATCH = 2_400, 6, 64


def path_vector(key: tuple[int, int, int]) -> np.ndarray:
    """Of ``Open.key()``: the tags above, the innermost one, the hints."""
    tags, hints, inner = key
    v = np.zeros(PATH, np.float32)
    v[[i for i in range(len(TAGS)) if tags >> i & 1]] = 1
    v[[2 * len(TAGS) + i for i in range(HINTS) if hints >> i & 1]] = 1
    if inner >= 0:
        v[len(TAGS) + inner] = 1
    return v


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS
        return out


_bucket = _Buckets()


class Features:
    """Of the blocks of some pages: a row of ``paths`` each (as an index), shares of word buckets, counts."""

    def __init__(self, pages: list[list]):
        known: dict = {}
        at, rows, counts, lengths = [], [], [], []
        for page in pages:
            n = len(page)
            for i, (text, path, links) in enumerate(page):
                at.append(known.setdefault(path.key(), len(known)))
                words = text.split(" ")
                rows.append([_bucket[w] for w in words])
                size = len(text)
                counts.append((len(words), size, links, i, n, text.count(".") + text.count("?") + text.count("!"), text.count(","), text[-1] in ".!?…\"'", text[0].isupper(), "©" in text or "|" in text))
            lengths.append(n)
        self.lengths = np.array(lengths, np.int64)
        self.path_of = np.array(at, np.int64)
        self.paths = np.array([path_vector(p) for p in known], np.float32).reshape(-1, PATH)
        m = len(at)
        sizes = np.array([len(r) for r in rows], np.int64)
        flat = np.array([w for r in rows for w in r], np.int64)
        self.words = (np.bincount(np.repeat(np.arange(m), sizes) * WORDS + flat, minlength=m * WORDS).reshape(m, WORDS) / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        c = np.array(counts, float).reshape(-1, 10)
        n_words, size, links, i, n, ends, commas, ended, upper, marks = c.T
        self.counts = np.stack([np.log1p(n_words) / 4, np.log1p(size) / 6, np.minimum(links / np.maximum(size, 1), 1), (i + 1) / np.maximum(n, 1), np.log1p(n) / 4, np.minimum(ends / np.maximum(n_words, 1), 1) * 4, np.minimum(commas / np.maximum(n_words, 1), 1) * 4, ended, upper, marks], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Weights of the two LSTMs and of the label."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        size = PATH + WORDS + COUNTS
        w = lambda *s: (r.standard_normal(s) * np.sqrt(1.0 / s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {"W" + d: w(size, 4 * HIDDEN), "U" + d: w(HIDDEN, 4 * HIDDEN), "c" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["c" + d][HIDDEN : 2 * HIDDEN] = 1  # remembers at first
        self.p |= {"V": w(2 * HIDDEN, 1), "v": np.zeros(1, np.float32)}

    def _inputs(self, x: Features, d: str) -> np.ndarray:
        w = self.p["W" + d]
        return (x.paths @ w[:PATH])[x.path_of] + x.words @ w[PATH : PATH + WORDS] + x.counts @ w[PATH + WORDS :] + self.p["c" + d]

    @staticmethod
    def _places(lengths: np.ndarray):
        """For each block its page and its place from the start and from the end."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return page, place, lengths[page] - 1 - place

    def _run(self, z: np.ndarray, u: np.ndarray, keep: bool):
        """The states of sequences (time, page, 4 * hidden), left-aligned; what lies behind an end is not used."""
        t, n, _ = z.shape
        h = np.zeros((n, HIDDEN), np.float32)
        c = np.zeros((n, HIDDEN), np.float32)
        out = np.zeros((t, n, HIDDEN), np.float32)
        saved = []
        for k in range(t):
            a = z[k] + h @ u
            i, f, o = (_sigmoid(a[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, c = c, f * c + i * g
            q = np.tanh(c)
            h_before, h = h, o * q
            out[k] = h
            if keep:
                saved.append((i, f, o, g, before, q, h_before))
        return out, saved

    def forward(self, x: Features, keep: bool = False):
        page, first, last = self._places(x.lengths)
        t, n = int(x.lengths.max(initial=0)), len(x.lengths)
        states = []
        for d, place in (("f", first), ("b", last)):
            z = np.zeros((t, n, 4 * HIDDEN), np.float32)
            z[place, page] = self._inputs(x, d)
            states.append(self._run(z, self.p["U" + d], keep))
        both = np.concatenate([states[0][0][first, page], states[1][0][last, page]], axis=1) if len(page) else np.zeros((0, 2 * HIDDEN), np.float32)
        return (both @ self.p["V"])[:, 0] + self.p["v"][0], (page, first, last, states, both)

    def probabilities(self, x: Features) -> np.ndarray:
        return _sigmoid(self.forward(x)[0])

    def gradients(self, x: Features, y: np.ndarray) -> tuple[float, dict]:
        """Loss of each block on average, and its gradients, back through time."""
        logits, (page, first, last, states, both) = self.forward(x, keep=True)
        p = _sigmoid(logits)
        loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())
        e = ((p - y) / len(y)).astype(np.float32)[:, None]
        g = {"V": both.T @ e, "v": e.sum(0)}
        back = e @ self.p["V"].T
        for d, place, (out, saved), part in (("f", first, states[0], back[:, :HIDDEN]), ("b", last, states[1], back[:, HIDDEN:])):
            u = self.p["U" + d]
            dout = np.zeros_like(out)
            dout[place, page] = part
            dz = np.zeros((*out.shape[:2], 4 * HIDDEN), np.float32)
            dh = np.zeros(out.shape[1:], np.float32)
            dc = np.zeros(out.shape[1:], np.float32)
            du = np.zeros_like(u)
            for k in range(len(saved) - 1, -1, -1):
                i, f, o, gg, before, q, h_before = saved[k]
                dh = dh + dout[k]
                dc = dc + dh * o * (1 - q * q)
                a = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * q * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz[k] = a
                du += h_before.T @ a
                dh, dc = a @ u.T, dc * f
            at = dz[place, page]
            of_path = np.zeros((len(x.paths), 4 * HIDDEN), np.float32)
            np.add.at(of_path, x.path_of, at)
            g |= {"W" + d: np.concatenate([x.paths.T @ of_path, x.words.T @ at, x.counts.T @ at]), "U" + d: du, "c" + d: at.sum(0)}
        return loss, g


def train(n_pages: int = SAMPLE_PAGES, epochs: int = EPOCHS, batch: int = 24, rate: float = 6e-3, seed: int = 1) -> BlockLabeller:
    """Adam over made-up pages; the same arguments give the same network."""
    pages = [x for x in (labelled(1_000_003 * seed + i, blocks) for i in range(n_pages)) if x[0]]
    sets = [pages[i : i + batch] for i in range(0, len(pages), batch)]
    ready = [(Features([p for p, _ in s]), np.array([v for _, y in s for v in y], np.float32)) for s in sets]
    model = BlockLabeller(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    r, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        for i in r.permutation(len(ready)):
            step += 1
            _, g = model.gradients(*ready[i])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * (0.5 ** max(0, epoch - epochs // 2)) * min(1.0, 1.0 / (norm + 1e-9))
            for k, v in g.items():
                m[k] = 0.9 * m[k] + 0.1 * v
                s2[k] = 0.999 * s2[k] + 0.001 * v * v
                model.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.999**step)) + 1e-8)
    return model


@lru_cache(2)
def trained(seed: int = 1) -> BlockLabeller:
    return train(seed=seed)


def main_texts(pages: list[str | None], model: BlockLabeller, threshold: float = 0.5) -> list[str]:
    """The article of each page: its blocks in page order, two line ends between them."""
    found = [blocks(p) for p in pages]
    out: list[str] = [""] * len(pages)
    order = sorted((i for i in range(len(found)) if found[i]), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        # pages of like lengths together, and fewer of long ones: memory follows the blocks of one set
        take = max(1, min(BATCH, 8_192 // max(1, len(found[order[min(at + BATCH, len(order)) - 1]]))))
        own = order[at : at + take]
        at += take
        p = model.probabilities(Features([found[i] for i in own]))
        k = 0
        for i in own:
            n = len(found[i])
            out[i] = "\n\n".join(t for (t, _, _), q in zip(found[i], p[k : k + n], strict=True) if q >= threshold)
            k += n
    return out


def extract_text(pages: DataFrame, *, html_col: str = "html", out_col: str = "text", model: BlockLabeller | None = None) -> DataFrame:
    """``pages`` with the main text of each whole page in ``out_col``; the empty text if there is none.

    Null pages are empty. Row by row: nothing is shuffled; repeated rows give repeated rows,
    an empty table none. An equally named column is replaced, all others are kept.
    """
    from pyspark.sql import types as T

    short_batches(pages.sparkSession)
    pages = pages.drop(out_col) if out_col != html_col else pages
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for b in batches:
            texts = pa.array(main_texts(b[html_col].to_pylist(), sent.value), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, out_col])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out_col, T.StringType())]))


def page_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return extract_text(base, **options).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
