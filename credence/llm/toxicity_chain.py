"""Toxicity by a chain of linear classifiers.

The labels know one class, ``toxic``. Its training documents are graded by how
many of their words are marked, which gives the categories of the chain, in this
order:

* ``severe``: toxic, and more marked words than the median toxic document;
* ``mild``: toxic, and not severe;
* ``toxic``: the label itself.

Each category has a logistic model over the presence of marked words and word
beginnings, and over the probabilities of the categories before it. While the
chain is fitted, these come from models that have not seen the document
(out-of-fold); when it is applied, from the final models."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import byte_column, keep_rows, mapped, per_text, slices

CATEGORIES = ("severe", "mild", "toxic")
#: Lengths in bytes of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)
#: Features kept, at most; the least count of labelled documents that have one;
#: and the least likelihood ratio (G squared) between the classes.
MOST_FEATURES, LEAST_DOCUMENTS, LEAST_RATIO = 4096, 4, 25.0
STEPS, RATE, RIDGE = 300, 0.3, 1e-4
REMEMBERED = 100_000
#: ASCII punctuation and white space end a word; A-Z become a-z.
_CUT = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_set(text: bytes) -> set[bytes]:
    return set(text.translate(_CUT).split())


def features(word: bytes) -> list[bytes]:
    """What a word is known by: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) > k)]


def counted(sample: DataFrame) -> DataFrame:
    """(feature, ones, zeros): the labelled documents of either class that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            labels = batch.column(batch.schema.get_field_index("label")).to_pylist()
            for text, label in zip(byte_column(batch, "text"), labels, strict=True):
                counts[label].update({f for w in word_set(text or b"") for f in features(w)})
        names = sorted({*counts[0], *counts[1]})
        for start in range(0, len(names), 50_000):
            some = names[start:start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), *(pa.array([counts[c][f] for f in some], pa.int64()) for c in (1, 0))], ["feature", "ones", "zeros"])
    return mapped(sample.select("text", "label"), run, "feature binary, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


class Chain:
    """Feature numbers and one weight vector per category."""

    def __init__(self, names: list[bytes], marks: np.ndarray):
        self.number = {f: i for i, f in enumerate(names)}
        self.marks = marks
        self.weights: list[np.ndarray] = []
        self.threshold = 0.5
        self._seen: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}}

    def present(self, text: bytes | None) -> list[int]:
        """Numbers of the known features of a text."""
        seen, found = self._seen, set()
        for word in word_set(text or b""):
            got = seen.get(word)
            if got is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                got = seen[word] = tuple(self.number[f] for f in features(word) if f in self.number)
            if got:
                found.update(got)
        return sorted(found)

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One column per category, each fed the columns before it."""
        out = np.zeros((len(rows), len(CATEGORIES)))
        sparse = Sparse(rows)
        for c, weights in enumerate(self.weights):
            out[:, c] = sparse.apply(weights, out[:, :c])
        return out

    def rejects(self, probability: np.ndarray) -> np.ndarray:
        return probability[:, -1] >= self.threshold


class Sparse:
    """Rows of feature numbers; the dense columns of a chain are handed in apart."""

    def __init__(self, rows: list[list[int]]):
        self.rows = len(rows)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]).astype(np.int64)
        self.column = np.array([f for r in rows for f in r], np.int64)

    def apply(self, weights: np.ndarray, dense: np.ndarray) -> np.ndarray:
        wide = dense.shape[1]
        raw = weights[-1] + np.bincount(self.row, weights[self.column], self.rows) + dense @ weights[len(weights) - 1 - wide:len(weights) - 1]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, width: int, dense: np.ndarray, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        """Weights of a ridge-penalised logistic model over the rows in ``use``
        (features, dense columns, intercept), by Adam over all of them."""
        share = np.clip(y[use].mean() if use.any() else 0.0, 1e-3, 1 - 1e-3)
        weights = np.zeros(width + dense.shape[1] + 1)
        weights[-1] = np.log(share / (1 - share))
        m, v, total = np.zeros_like(weights), np.zeros_like(weights), max(int(use.sum()), 1)
        for step in range(1, STEPS + 1):
            off = np.where(use, self.apply(weights, dense) - y, 0) / total
            gradient = np.concatenate([np.bincount(self.column, off[self.row], width), dense.T @ off, [off.sum()]])
            gradient[:-1] += RIDGE * weights[:-1]
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            weights -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return weights


def threshold_of(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut of out-of-fold scores with the most documents of class one above it
    less those of class zero; it lies midway, on the scale of the logarithm, to the
    next score below."""
    order = np.argsort(-scores, kind="stable")
    scores, gain = scores[order], np.cumsum(np.where(y[order] > 0, 1, -1))
    last = np.append(scores[1:] < scores[:-1], True) if len(scores) else np.zeros(0, bool)
    if not last.any() or gain[last].max() <= 0:
        return 0.5
    best = np.flatnonzero(last)[gain[last].argmax()]
    below = scores[best + 1] if best + 1 < len(scores) else 0.0
    return float(min(0.5, np.sqrt(scores[best] * max(below, 1e-6))))


def select(table: pa.Table, ones: int, zeros: int, most: int) -> tuple[list[bytes], np.ndarray]:
    """The features that part the classes the most surely, by name, and
    which of them mark the class of ones."""
    name = table.column("feature").to_pylist()
    a, b = (table.column(c).to_numpy().astype(float) for c in ("ones", "zeros"))
    share = ones / max(ones + zeros, 1)
    there, away = a + b, ones + zeros - a - b
    sure = np.zeros(len(name))
    for seen, fair in ((a, there * share), (b, there * (1 - share)), (ones - a, away * share), (zeros - b, away * (1 - share))):
        sure += 2 * seen * np.log(np.maximum(seen, 1e-9) / np.maximum(fair, 1e-9))
    sure = np.where(a > there * share, sure, -sure)
    good = [i for i in np.flatnonzero(np.abs(sure) >= LEAST_RATIO)]
    good = sorted(sorted(good, key=lambda i: (-abs(sure[i]), name[i]))[:most], key=lambda i: name[i])
    return [name[i] for i in good], np.array([sure[i] > 0 for i in good], bool)


def fit(sample: DataFrame, most_features: int = MOST_FEATURES) -> bytes:
    """A packed chain from a labelled sample (doc_id, text, label, part).

    Features are counted and rows encoded in Spark; the driver gets the counts of
    the features that pass and, for each sampled row, the numbers of those it has.
    Both are bounded by the sample. Without both classes the chain has no features
    and gives the share of toxic rows to every text."""
    counts = sample.groupBy().agg(F.sum("label").alias("ones"), F.count("label").alias("rows")).first()
    ones, zeros = int(counts.ones or 0), int(counts.rows) - int(counts.ones or 0)
    # the odds are judged on the driver; features too rare to pass stay behind
    names, marks = select(counted(sample).where(F.col("ones") + F.col("zeros") >= LEAST_DOCUMENTS).toArrow(), ones, zeros, most_features)
    chain = Chain(names, marks)
    packed = sample.sparkSession.sparkContext.broadcast(pickle.dumps(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed.value)
        for batch in slices(batches):
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "label", "part")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([own.present(t) for t in byte_column(batch, "text")], pa.list_(pa.int32()))], ["doc_id", "label", "part", "found"])
    rows = mapped(sample, run, "doc_id long, label int, part int, found array<int>").orderBy("doc_id", "found").toArrow()
    found = rows.column("found").to_pylist()
    label, part = (rows.column(c).to_numpy().astype(int) for c in ("label", "part"))
    sparse, width = Sparse(found), len(names)
    marked = np.array([int(marks[f].sum()) for f in found]) if found else np.zeros(0, int)
    middle = np.median(marked[label == 1]) if (label == 1).any() else 0
    targets = {"severe": (label == 1) & (marked > middle), "mild": (label == 1) & (marked <= middle), "toxic": label == 1}
    before = np.zeros((len(found), 0))
    for category in CATEGORIES:
        y = targets[category].astype(float)
        unseen = np.zeros(len(found))
        for k in range(5):
            weights = sparse.fit(width, before, y, part != k)
            unseen[part == k] = sparse.apply(weights, before)[part == k]
        chain.weights.append(sparse.fit(width, before, y, np.ones(len(found), bool)))
        before = np.column_stack([before, unseen])
    if len(found):
        chain.threshold = threshold_of(before[:, -1], label)
    return pickle.dumps(chain)


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, p_severe, p_mild, score (probability of toxic)
    and predicted (1 from the threshold that the out-of-fold scores gave on).

    Null and empty texts have no features and get the scores that the intercepts
    give; repeated rows get equal scores. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        chain = pickle.loads(shared.value)

        def step(texts: list[bytes | None]) -> list:
            p = chain.probabilities([chain.present(t) for t in texts])
            return [*(pa.array(p[:, c], pa.float64()) for c in range(len(CATEGORIES))), pa.array(chain.rejects(p).astype(np.int32))]
        return step
    return per_text(docs, "doc_id long, p_severe double, p_mild double, score double, predicted int", ["p_severe", "p_mild", "score", "predicted"], make)


def kept(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        chain = pickle.loads(shared.value)
        return lambda texts: ~chain.rejects(chain.probabilities([chain.present(t) for t in texts]))
    return keep_rows(docs, make)
