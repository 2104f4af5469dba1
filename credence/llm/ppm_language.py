"""Language identification by prediction by partial matching over bytes.

Each language has a tree of byte contexts of up to three bytes. A byte costs
``-log2`` of its probability in the longest context of the tree that ends just
before it; a byte that context has never seen is paid for by an escape and coded
in the next shorter one, where everything the longer context has seen is excluded
(escape method C). The statistics are frozen, so the code length of a text is a
sum over its bytes, and the language with the shortest code wins.

The trees of all languages share their contexts. Every (context, byte) has its
code length worked out beforehand, one figure per language, and scoring is three
table look-ups per byte."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import LOWER, byte_column, fold, keep_rows, mapped, per_text, slices

#: What stands before the first byte of a text.
LEAD = b"\n\n\n"
#: Training documents a language is expected to have in the sample.
DOCUMENTS_PER_LANGUAGE = 400
#: Times a context must have been met to become a node of the tree.
LEAST_COUNT = 4
#: Bytes scored at once, and contexts worked out at once.
WINDOW, CHUNK = 1 << 19, 2048
#: Code lengths are held in 1024ths of a bit; a byte costs at most 64 bits.
UNIT = 1024
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}").search
SPREAD = 1 << 20


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct four-byte windows (three of context and one coded) and their counts."""
    parts = [np.empty(0, np.uint32)]
    for text in texts:
        b = np.frombuffer(LEAD + text.translate(LOWER), np.uint8).astype(np.uint32)
        if len(b) > 3:
            parts.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
    return np.unique(np.concatenate(parts), return_counts=True)


def counted(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over a sample with the columns lang and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            texts = byte_column(batch, "text")
            for lang in sorted(set(langs)):
                keys, n = grams([t for t, other in zip(texts, langs, strict=True) if other == lang])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])
    return mapped(sample.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Counts of all languages; the cost tables are built where they are needed."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, least: int = LEAST_COUNT):
        self.languages = languages
        self.lang, self.gram, self.n = lang.astype(np.int16), gram.astype(np.uint32), n.astype(np.int64)
        self.least = least

    def build(self) -> ContextTrees:
        """Context tables and code lengths of every context, byte and language."""
        key = self.gram.astype(np.int64)
        levels = [np.zeros(1, np.int64), np.arange(256)]
        for size in (2, 3):
            context = (key >> 8) & ((1 << 8 * size) - 1)
            seen, at = np.unique(context, return_inverse=True)
            levels.append(seen[np.bincount(at, self.n, len(seen)) >= self.least])
        count = len(self.languages)
        starts = np.cumsum([0, *(len(level) for level in levels)])
        costs = np.zeros((int(starts[-1]), 256, count), np.uint16)
        for language in range(count):
            mine = self.lang == language
            above_cost = above_rest = above_n = None
            for size, contexts in enumerate(levels):
                parent = np.zeros(1, np.int64) if size == 0 else np.searchsorted(levels[size - 1], contexts & ((1 << 8 * (size - 1)) - 1))
                parts = []
                for begin in range(0, len(contexts), CHUNK):
                    some = slice(begin, begin + CHUNK)
                    n = self._dense(key[mine], self.n[mine], size, contexts[some])
                    cost, rest = self._level(n, parent[some], above_n, above_cost, above_rest)
                    costs[starts[size] + begin:starts[size] + begin + len(n), :, language] = np.minimum(np.rint(cost * UNIT), 65535)
                    if size < 3:  # nothing stands below the longest contexts
                        parts.append((n, cost, rest))
                if parts:
                    above_n, above_cost, above_rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.costs = costs.reshape(costs.shape[0] * 256, count)
        self.starts = starts.astype(np.int32)
        self.second = np.full(65536, -1, np.int32)
        self.second[levels[2]] = np.arange(len(levels[2]), dtype=np.int32) + self.starts[2]
        heads, of = np.unique(levels[3] >> 8, return_inverse=True)
        self.head = np.zeros(65536, np.int32)
        self.head[heads] = np.arange(1, len(heads) + 1, dtype=np.int32)
        self.third = np.full((len(heads) + 1) * 256, -1, np.int32)
        self.third[(of + 1) * 256 + (levels[3] & 255)] = np.arange(len(levels[3]), dtype=np.int32) + self.starts[3]
        return self

    @staticmethod
    def _dense(key: np.ndarray, n: np.ndarray, size: int, contexts: np.ndarray) -> np.ndarray:
        context = (key >> 8) & ((1 << 8 * size) - 1)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1) if len(contexts) else np.zeros(len(key), np.int64)
        known = contexts[at] == context if len(contexts) else np.zeros(len(key), bool)
        flat = np.bincount(at[known] * 256 + (key[known] & 255), n[known], len(contexts) * 256)
        return flat.reshape(-1, 256).astype(np.float32)

    @staticmethod
    def _level(n, parent, above_n, above_cost, above_rest):
        """Code lengths in these contexts, and those after an escape from them
        (``rest``), given the level above (the next shorter contexts)."""
        total, kinds = n.sum(1), (n > 0).sum(1)
        whole = np.maximum(total + kinds, 1)[:, None]
        if above_n is None:
            rest = np.full_like(n, np.log2(np.maximum(256 - kinds, 1))[0])
            fresh = np.full_like(n, 8.0)
        else:
            over = above_n[parent]
            left = np.where(n > 0, 0, over)
            left_total, left_kinds = left.sum(1), (left > 0).sum(1)
            left_whole = (left_total + left_kinds)[:, None]
            escape = np.where(left_whole > 0, -np.log2(np.maximum(left_kinds[:, None], 1e-9) / np.maximum(left_whole, 1)), 0)
            escape = np.where((left_whole > 0) & (left_kinds[:, None] == 0), 0, escape)
            rest = np.where(left > 0, -np.log2(np.maximum(left, 1) / np.maximum(left_whole, 1)), escape + above_rest[parent])
            fresh = above_cost[parent]
        with np.errstate(divide="ignore"):
            inside = -np.log2(np.maximum(n, 1e-9) / whole)
            out = -np.log2(np.maximum(kinds, 1)[:, None] / whole) + rest
        cost = np.where(n > 0, inside, out)
        empty = (total == 0)[:, None]
        return np.where(empty, fresh, cost).astype(np.float32), np.where(empty, fresh if above_n is None else above_rest[parent], rest).astype(np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length in bits of every text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        if not self.languages:
            return out
        joined = b"".join([LEAD + t for t in texts]).translate(LOWER)
        lengths = np.array([len(t) + 3 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        b = np.frombuffer(joined, np.uint8)
        for begin in range(3, len(b), WINDOW):
            stop = min(begin + WINDOW, len(b))
            part = b[begin - 3:stop].astype(np.int32)
            pair = (part[:-1] << 8) | part[1:]
            row = self.third[(self.head[pair[:-2]] << 8) | part[2:-1]]
            short = self.second[pair[1:-1]]
            row = np.where(row >= 0, row, np.where(short >= 0, short, part[2:-1] + self.starts[1]))
            cost = self.costs[(row.astype(np.int64) << 8) | part[3:]]
            owner = np.searchsorted(ends, np.arange(begin, stop), side="right")
            lead = np.arange(begin, stop) - (ends - lengths)[owner] < 3
            cost[lead] = 0
            first, at = np.unique(owner, return_index=True)
            out[first] += np.add.reduceat(cost, at, axis=0, dtype=np.int64) / UNIT
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, its share of the evidence, and bits a byte, of every text."""
        known = [t or b"" for t in texts]
        bits = self.bits(known)
        names, scores, rates = [], [], []
        for text, row in zip(known, bits, strict=True):
            if not self.languages or not LETTER(text.decode("utf-8", "replace")):
                names.append(UNKNOWN)
                scores.append(0.0)
                rates.append(0.0)
                continue
            best = int(row.argmin())
            names.append(self.languages[best])
            scores.append(float(1 / np.exp2(-np.minimum(row - row[best], 1000)).sum()))
            rates.append(float(row[best] / len(text)))
        return names, scores, rates


_BUILT: dict[str, ContextTrees] = {}


def trees_of(packed: bytes) -> ContextTrees:
    """Cost tables, built once per worker process and model."""
    key = hashlib.sha256(packed).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = pickle.loads(packed).build()
    return _BUILT[key]


def fit(docs: DataFrame, learn: Column, per_language: int = DOCUMENTS_PER_LANGUAGE) -> bytes:
    """A packed model from the rows of ``docs`` (doc_id, text, lang) where ``learn``
    holds and lang is not null.

    The sample takes each row by a hash of its id, at a rate per language that is
    expected to give ``per_language`` rows: the bound of what is learned from and
    of what reaches the driver, which is counts of byte windows only."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows_of_lang"))
    # one row per language, as many as the model has columns
    picked = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)) * F.col("rows_of_lang") < per_language * SPREAD)
    found = counted(picked).toArrow()
    lang, gram, n = (found.column(c).to_pylist() for c in ("lang", "gram", "n"))
    names = sorted(set(lang))
    number = {name: i for i, name in enumerate(names)}
    order = sorted(range(len(lang)), key=lambda i: (lang[i], gram[i]))
    trees = ContextTrees(names, np.array([number[lang[i]] for i in order], np.int16), np.array([gram[i] for i in order], np.uint32), np.array([n[i] for i in order], np.int64))
    return pickle.dumps(trees)


def predicted(docs: DataFrame, model: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score and bits_per_byte.

    Texts that are null or have no letter get ``und``, score 0 and 0 bits, and so
    does everything when nothing was learned. Equal code lengths go to the first
    language by name. Other columns of ``docs`` play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = trees_of(shared.value)

        def step(texts: list[bytes | None]) -> list:
            names, scores, rates = trees.predict(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
        return step
    return per_text(docs, "doc_id long, lang_pred string, score double, bits_per_byte double", ["lang_pred", "score", "bits_per_byte"], make)


def kept(docs: DataFrame, model: bytes) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in some language: those
    predicted ``und`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        trees = trees_of(shared.value)
        return lambda texts: np.array([name != UNKNOWN for name in trees.predict(texts)[0]])
    return keep_rows(docs, make)


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id modulo 4 is 2."""
    return F.coalesce(fold(key, 4) == 2, F.lit(False))
