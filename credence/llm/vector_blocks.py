"""A stated set of query vectors against all vectors, block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, and queries in a block of queries.
DATA_ROWS, QUERY_ROWS = 4096, 8192


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding of the rows that take part: an id, a vector that is not
    null or empty, no null, NaN or infinite component; all-zero ones if ``zero``."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows if zero else rows.where(F.exists("embedding", lambda x: x != 0))


def arrays(side: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Distinct (id, vector) rows in the order of ids, by the vectors' length."""
    ids = side.column("vec_id").to_numpy()
    if not len(ids):
        return {}
    vectors = side.column("embedding").combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, ends, out = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes), {}
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = flat[(ends[at] - size)[:, None] + np.arange(size)]
        order = np.lexsort([*rows.T[::-1], ids[at]])
        mine, rows = ids[at][order], rows[order]
        fresh = np.append(True, (mine[1:] != mine[:-1]) | (rows[1:] != rows[:-1]).any(1))
        out[int(size)] = mine[fresh], np.ascontiguousarray(rows[fresh])
    return out


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def best(rows: DataFrame, query: Column, k: int, search: Search, kind: str) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows of every query, ties to
    the smaller id.

    ``search(ids, vectors, query ids, query vectors)`` works on one block of each and
    yields for every query its best rows of the block and their scores, at most
    ``k``. Blocks are dealt by a hash of the row, so their sizes stay near
    ``DATA_ROWS`` and ``QUERY_ROWS`` at any size of the table, and so does the memory
    of a task; vectors of different lengths never meet. What leaves a block is ``k``
    rows a query."""
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(query, 1)).alias("q")).first()
    blocks, query_blocks = -(-counts.n // DATA_ROWS) or 1, -(-counts.q // QUERY_ROWS) or 1
    deal = F.xxhash64("vec_id", "embedding")
    data = rows.select(F.pmod(deal, F.lit(blocks)).cast("int").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), "vec_id", "embedding")
    asked = rows.where(query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("d"), F.pmod(deal, F.lit(query_blocks)).cast("int").alias("q"), "vec_id", "embedding")
    number = pa.float64() if kind == "double" else pa.int64()

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        mine, queries = arrays(one), arrays(two)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in sorted(mine.keys() & queries.keys()):
            parts += [(np.full(len(ids), query_id), ids, scores) for query_id, ids, scores in search(*mine[size], *queries[size])]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.empty(0) for i in range(3)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), number), strict=True)], ["query_id", "vec_id", "score"])
    found = data.groupBy("d", "q").cogroup(asked.groupBy("d", "q")).applyInArrow(run, f"query_id long, vec_id long, score {kind}")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to the smaller id."""
    order = np.lexsort([ids, -scores])[:k]
    return ids[order], scores[order]
