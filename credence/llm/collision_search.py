"""Approximate nearest neighbours by collision counting.

Every vector is projected on a few random lines; each line has one sorted array of
the projections. A query opens a window around its own projection on every line.
Widening all windows together, by the radius they stand for, takes the place of
hashing again for each radius. A vector that lies in the windows of enough lines
is verified by its exact score. A query ends once its k-th best verified vector is
as near as the radius allows, or when everything has been verified: candidates are
never capped.

Largest inner product becomes smallest distance by one more component,
``sqrt(M^2 - |x|^2)`` for the largest norm ``M``, and queries scaled to ``M``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.vector_blocks import best, top, usable

#: Lines; lines whose windows must hold a vector; half a window for radius 1 (a
#: vector at the radius lies in it nine times of ten); first radius as a share of
#: the largest norm, and its growth, which is also the slack of the ending.
LINES, COLLISIONS, HALF, FIRST, GROWTH = 12, 6, 1.645, 0.2, 2.0
#: The widest radius: all distances are at most twice the largest norm.
LEVELS = 5


def lines(size: int) -> np.ndarray:
    """The lines for vectors of ``size`` components, the same everywhere."""
    return np.random.default_rng([20, size]).standard_normal((size + 1, LINES))


class Index:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        self.ids, self.norm = ids, norm
        self.vectors, self.single = vectors.astype(np.float64), vectors.astype(np.float32)
        rest = np.sqrt(np.maximum(norm**2 - (self.vectors**2).sum(1), 0))
        self.lines = lines(vectors.shape[1])
        projected = np.column_stack([self.vectors, rest]) @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(projected, axis=0).T.copy()

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query: the best verified rows of the block, the query's own apart."""
        q = queries.astype(np.float64)
        size = np.sqrt((q**2).sum(1))
        centre = (q * (self.norm / size)[:, None]) @ self.lines[:-1]
        radii = FIRST * self.norm * GROWTH ** np.arange(LEVELS)
        low, high = (np.stack([[np.searchsorted(self.sorted[j], centre[:, j] + sign * HALF * r, side) for j in range(LINES)] for r in radii]).transpose(2, 0, 1)
                     for sign, side in ((-1, "left"), (1, "right")))
        n = len(self.ids)
        for i, query_id in enumerate(query_ids):
            met, done = np.zeros(n, np.int64), self.ids == query_id
            own = done.copy()
            scores = np.full(n, -np.inf, np.float32)
            single = q[i].astype(np.float32)
            left = right = None
            for level, radius in enumerate(radii):
                a, b = low[i, level], high[i, level]
                if left is None:
                    new = [self.order[j, a[j]:b[j]] for j in range(LINES)]
                else:
                    new = [self.order[j, x:y] for j in range(LINES) for x, y in ((a[j], left[j]), (right[j], b[j])) if y > x]
                left, right = a, b
                if new:
                    met += np.bincount(np.concatenate(new), minlength=n)
                fresh = np.flatnonzero((met >= COLLISIONS) & ~done) if level < LEVELS - 1 else np.flatnonzero(~done)
                if len(fresh):
                    scores[fresh] = self.single[fresh] @ single
                    done[fresh] = True
                # distance^2 = 2 M^2 - 2 M score / |q|
                within = self.norm * size[i] * (1 - (GROWTH * radius / self.norm) ** 2 / 2)
                if done.all() or (scores >= within).sum() >= k:
                    break
            at = np.flatnonzero(done & ~own)
            if len(at) > k:  # single precision decides only what is clearly too far
                edge = np.partition(scores[at], len(at) - k)[len(at) - k]
                at = at[scores[at] >= edge - 1e-5 * self.norm * size[i]]
            yield int(query_id), *top(self.ids[at], (self.vectors[at] * q[i]).sum(1), k)


def nearest(vectors: DataFrame, query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score (inner product in double precision on the
    original vectors) of the ``k`` nearest rows found for every row where ``query``
    holds, among all other rows.

    Vectors that are null, empty, all zero or hold null or non-finite components
    take no part, nor do rows without an id. Repeated rows count once; equal vectors
    under different ids are ties and go by id. A table without queries gives no
    rows; other columns are ignored."""
    rows = usable(vectors, zero=False)
    norm = rows.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()[0] or 1.0
    norm *= 1 + 1e-9

    def search(ids, data, query_ids, queries):
        return Index(ids, data, norm).search(query_ids, queries, k)
    return best(rows, query, k, search, "double")
