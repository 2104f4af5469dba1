"""Exact top-k inner products by elimination with a pivot table.

Every vector's distances to a fixed set of pivots are known. For a query, the
largest difference between its own and a vector's distances to a pivot is a lower
bound of their distance, and so an upper bound of their inner product. Vectors are
evaluated in the order of that bound, and a query ends when the next bound is below
its k-th best score: nothing that could still enter is left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.vector_blocks import arrays, best, top, usable

#: Pivots: the rows with the smallest hashes of their ids, a bounded set.
PIVOTS = 32
#: Vectors evaluated before the bound is looked at again.
STEP = 128


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(1024 * vectors.astype(np.float64)).astype(np.int64)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, p = vectors.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1) - 2 * v @ p.T, 0))


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its ``k`` best rows of the block, its own apart."""
    table, asked = distances(vectors, pivots), distances(queries, pivots)
    square, own = (vectors.astype(np.float64)**2).sum(1), (queries.astype(np.float64)**2).sum(1)
    for i, query_id in enumerate(query_ids):
        apart = np.abs(table - asked[i]).max(1) if len(pivots) else np.zeros(len(ids))
        together = square + own[i]
        # the slack covers the rounding of the roots
        bound = (together - np.maximum(apart - 1e-6 * np.sqrt(together), 0)**2) / 2 + 1e-9 * together + 1
        order = np.argsort(-bound, kind="stable")
        order = order[ids[order] != query_id]
        kept_ids, kept = ids[:0], np.empty(0, np.int64)
        for start in range(0, len(order), STEP):
            if len(kept) == k and bound[order[start]] < kept[-1]:
                break
            some = order[start:start + STEP]
            kept_ids, kept = top(np.concatenate([kept_ids, ids[some]]), np.concatenate([kept, vectors[some] @ queries[i]]), k)
        yield int(query_id), kept_ids, kept


def highest(vectors: DataFrame, query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest integer inner products of
    ``floor(1024 x)`` for every row where ``query`` holds, among all other rows.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without an id. Repeated rows count once, ties go to the
    smaller id, and a table without queries gives no rows. Other columns are
    ignored. Scores are 64-bit integers: components must stay below 2^20 or so."""
    rows = usable(vectors, zero=True)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).toArrow()
    pivots = {size: integers(v) for size, (_, v) in arrays(chosen).items()}

    def search(ids, data, query_ids, queries):
        own = pivots.get(data.shape[1], np.empty((0, data.shape[1]), np.int64))
        return search_block(ids, integers(data), query_ids, integers(queries), own, k)
    return best(rows, query, k, search, "long")
