"""Document quality by histogram gradient-boosted trees over document statistics.

The statistics are cut into quantile bins; each round grows one tree level by
level from gradient histograms. The fitted trees are flattened into arrays, and a
batch of documents walks all trees at once."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import LOWER, per_text

#: Statistics of a text, in the order of the columns the trees see.
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "long_words", "short_words", "upper", "digits", "exclaim", "pipes", "symbols", "space",
    "beyond_ascii", "distinct_words", "top_word", "repeated_next", "distinct_pairs", "marked_words", "lines", "distinct_lines", "entropy",
)
BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 64, 60, 5, 0.15, 1.0, 5.0
_CLASS = np.zeros(256, np.int64)
for _i, _codes in enumerate(([*range(65, 91)], [*range(48, 58)], [33], [124], [32, 9, 10, 11, 12, 13], [*range(128, 256)]), 1):
    _CLASS[_codes] = _i
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum() and b not in (33, 124, 44, 46, 39, 45)]] = 7
#: Characters taken off the end of a word before its mark is judged.
_PLAIN_ENDS = b".,;:?!'\"()-"


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text; all zero when it is empty."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    codes = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = np.bincount(_CLASS, codes, 8) / size
    share = codes[codes > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    lower = text.translate(LOWER).split()
    places: dict[bytes, int] = {}
    number = np.fromiter((places.setdefault(w, len(places)) for w in lower), np.int64, n)
    often = np.bincount(number)
    pairs = number[:-1] * len(places) + number[1:]
    lines = [x for x in text.split(b"\n") if x.strip()]
    marked = sum(1 for w in words if w.rstrip(_PLAIN_ENDS)[-1:] in b"*$%&#@^~|+=<>" and len(w) > 1)
    return [
        np.log1p(size), np.log1p(n), lengths.mean(), (lengths > 14).mean(), (lengths < 4).mean(), classes[1], classes[2], classes[3],
        classes[4], classes[7], classes[5], classes[6], len(places) / n, often.max() / n, (number[:-1] == number[1:]).mean() if n > 1 else 0.0,
        len(np.unique(pairs)) / len(pairs) if n > 1 else 1.0, marked / n, len(lines) / n, len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts], np.float64).reshape(-1, len(STATISTICS))


class BoostedTrees:
    """Flattened trees: node arrays per tree, leaves pointing at themselves."""

    def __init__(self, edges, feature, threshold, left, right, value, base):
        self.edges, self.feature, self.threshold = edges, feature, threshold
        self.left, self.right, self.value, self.base = left, right, value, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of every row: all rows step down all trees together."""
        rows = np.arange(len(x))[:, None]
        trees = np.arange(self.feature.shape[0])[None, :]
        node = np.zeros((len(x), self.feature.shape[0]), np.int64)
        for _ in range(DEPTH):
            go = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(go, self.left[trees, node], self.right[trees, node])
        return self.base + self.value[trees, node].sum(1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> BoostedTrees:
    """Fit on a bounded sample. Without both classes there is nothing to learn and
    every score is the share of ones (one half without rows)."""
    features = x.shape[1]
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    size = 2 ** (DEPTH + 1) - 1
    shape = (max(trees, 1), size)
    feature, threshold = np.zeros(shape, np.int64), np.zeros(shape)
    itself = np.tile(np.arange(size), (shape[0], 1))
    left, right, value = itself.copy(), itself.copy(), np.zeros(shape)
    flat = BoostedTrees(None, feature, threshold, left, right, value, base)
    if len(y) == 0 or y.min() == y.max():
        return flat
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)], 1)
    offsets = np.arange(features) * BINS
    raw = np.full(len(y), base)
    for tree in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH + 1):
            first, wide = 2 ** depth - 1, 2 ** depth
            local = node - first
            live = (local >= 0) & (local < wide)
            at = local[live]
            gs, hs = np.bincount(at, g[live], wide), np.bincount(at, h[live], wide)
            value[tree, first:first + wide] = np.where(hs > 0, -RATE * gs / (hs + RIDGE), 0)
            if depth == DEPTH:
                break
            cell = (at[:, None] * features * BINS + offsets + binned[live]).ravel()
            hist = [np.bincount(cell, np.repeat(v[live], features), wide * features * BINS).reshape(wide, features, BINS).cumsum(2) for v in (g, h)]
            gl, hl = hist
            gr, hr = gs[:, None, None] - gl, hs[:, None, None] - hl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gs**2 / (hs + RIDGE))[:, None, None]
            gain[(hl < LEAST * 0.25) | (hr < LEAST * 0.25)] = -1
            for f in range(features):
                gain[:, f, len(edges[f]):] = -1
            best = gain.reshape(wide, -1).argmax(1)
            split = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-6
            f, cut = best // BINS, best % BINS
            for k in np.flatnonzero(split):
                here = first + k
                feature[tree, here], threshold[tree, here] = f[k], edges[f[k]][cut[k]]
                left[tree, here], right[tree, here] = 2 * here + 1, 2 * here + 2
            moves = live.copy()
            moves[live] = split[at]
            mine = local[moves]
            node[moves] = 2 * node[moves] + 1 + (binned[moves, f[mine]] > cut[mine])
        raw += value[tree, node]
    return flat


def fit(sample: DataFrame) -> bytes:
    """Packed trees from a labelled sample (doc_id, text, label), whose bound its
    maker states. The statistics are taken in Spark; the driver gets one short row
    per sampled document."""
    names = list(STATISTICS)
    shape = "doc_id long, " + ", ".join(f"{c} double" for c in names)

    def make():
        return lambda texts: [pa.array(c, pa.float64()) for c in matrix(texts).T]
    ids = sample.select("doc_id", "label").distinct()
    rows = per_text(sample, shape, names, make).join(F.broadcast(ids), "doc_id").orderBy("doc_id", *names).toArrow()
    x = np.stack([rows.column(c).to_numpy() for c in names], 1) if rows.num_rows else np.zeros((0, len(names)))
    return pickle.dumps(grow(x, rows.column("label").to_numpy().astype(float) if rows.num_rows else np.zeros(0)))


def scored(docs: DataFrame, model: bytes, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, score (likelihood of label 1) and predicted.

    Null and empty texts have all statistics zero and are scored like any other;
    repeated rows get equal scores. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = pickle.loads(shared.value)

        def step(texts: list[bytes | None]) -> list:
            score = trees.scores(matrix(texts))
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
        return step
    return per_text(docs, "doc_id long, score double, predicted int", ["score", "predicted"], make)
