"""Whitening directions of embeddings by blockwise QR and a bidiagonal qd solver.

Every task factors its centred rows block by block into one triangle R; triangles are
merged in groups until one is left. On that one, whose size is the dimension only,
Householder reflections leave an upper bidiagonal B, differential qd sweeps with
shifts (dqds) give the squares of its singular values to high relative accuracy, and
twisted factorisations of B'B give the right singular vectors, which are the
eigenvectors of the covariance. The covariance itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import durable, mapped

#: Rows that one QR step takes, and partial results that one merge takes.
BLOCK, FAN = 4096, 32
EPS = float(np.finfo(float).eps)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and Q, where ``r = P B Q'`` with orthogonal P
    and Q, by Householder reflections from both sides in turn."""
    a, d = np.array(r, dtype=float), r.shape[1]
    q = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        v[0] += np.copysign(size, x[0])
        length = np.linalg.norm(v)
        return v / length if length else v
    for k in range(d):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            q[:, k + 1:] -= 2 * np.outer(q[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds transform and the trace of the inverse; None if the shift was more
    than the smallest eigenvalue."""
    d, inverse, qs, es = q[0] - shift, 0.0, [], []
    for up, off in zip(q[1:], e, strict=True):
        if d <= 0:
            return None
        inverse += 1 / d
        total = d + off
        t = up / total
        qs.append(total)
        es.append(off * t)
        d = d * t - shift
    if d < 0:
        return None
    return [*qs, d], es, inverse + (1 / d if d else np.inf)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix (a, b), by dqds.
    The shift of a sweep is the reciprocal of the trace of the inverse, which an
    unshifted sweep gives and which the smallest eigenvalue never undercuts."""
    todo, out, tolerance = [([float(x * x) for x in a], [float(x * x) for x in b], 0.0)], [], (16 * EPS) ** 2
    while todo:
        q, e, base = todo.pop()
        while q:
            if len(q) == 1 or e[-1] <= tolerance * (base + q[-1]):
                out.append(q.pop() + base)
                del e[len(q) - 1 if q else 0:]
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= tolerance * (base + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], base))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:
                q.reverse()
                e.reverse()
            q, e, inverse = _sweep(q, e, 0.0)
            for share in (1 - 8 * len(q) * EPS, 0.99, 0.5):
                done = _sweep(q, e, share / inverse)
                if done is not None:
                    q, e, base = done[0], done[1], base + share / inverse
                    break
    return np.sort(np.array(out))[::-1]


def _twisted(pivots: np.ndarray, lower: np.ndarray, value: float) -> tuple[np.ndarray, Callable[[int], np.ndarray]]:
    """Twist pivots of ``L D L' - value`` and the vector of a twist at an index: the
    stationary transform comes from the top, the progressive one from the bottom,
    and they meet where the pivot is smallest."""
    n, tiny = len(pivots), 1e-290
    s, p, down, up = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0], p[-1] = -value, pivots[-1] - value
    for i in range(n - 1):
        down[i] = pivots[i] * lower[i] / ((pivots[i] + s[i]) or tiny)
        s[i + 1] = down[i] * lower[i] * s[i] - value
    for i in range(n - 2, -1, -1):
        p[i + 1] = p[i + 1] or tiny
        t = pivots[i] / ((pivots[i] * lower[i] ** 2 + p[i + 1]) or tiny)
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value

    def vector(at: int) -> np.ndarray:
        z = np.zeros(n)
        z[at] = 1
        for i in range(at - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -up[i] * z[i]
        return z
    return s + p + value, vector


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of B'B for its eigenvalues ``values`` (falling).
    Values that nearly agree share a subspace: a vector that falls into the ones
    before it is taken at the next twist instead."""
    pivots, lower, found = a * a, b / a[:-1], []
    for k, value in enumerate(values):
        near = [found[j] for j in range(k) if values[j] - value <= 1e-3 * values[j]]
        gaps, vector = _twisted(pivots, lower, float(value))
        best, most = None, 0.0
        for at in np.argsort(np.abs(np.nan_to_num(gaps, nan=np.inf)), kind="stable"):
            with np.errstate(all="ignore"):
                z = vector(int(at))
                z = z / np.max(np.abs(z))
                z = z / np.linalg.norm(z)
            if not np.isfinite(z).all():
                continue
            for _ in range(2):
                for other in near:
                    z = z - (other @ z) * other
            left = np.linalg.norm(z)
            if left > most:
                best, most = z / left, left
            if most > 0.1:
                break
        found.append(best)
    return np.stack(found, axis=1)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` leading right singular vectors of ``r`` (columns) and the squares
    of their singular values; fewer where the rank is less."""
    size = float(np.linalg.norm(r))
    if not size:
        return np.empty((r.shape[1], 0)), np.empty(0)
    a, b, q = bidiagonal(r / size)
    a = np.where(np.abs(a) < 1e-40, 1e-40, a)
    values = squares(a, b)[:most]
    values = values[np.sqrt(values) > r.shape[1] * EPS * np.sqrt(values[0])]
    return q @ right_vectors(a, b, values), values * size * size


class Whitening(NamedTuple):
    """A fitted transform: list size, sums per dimension, unit directions (columns),
    their eigenvalues, the trace of the covariance, and the largest entry by which
    the covariance of the whitened list differs from the identity."""
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def rounded(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """Rows whose vector is neither null nor empty nor holds null, NaN or infinite
    entries, with ``x``: floor(scale * entry) per entry as long (entries beyond the
    range of long end at its ends)."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select("vec_id", whole.alias("x"))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = _matrix(batch, width)
        for at in range(0, len(rows), BLOCK):
            yield rows[at:at + BLOCK]


def _sums(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    safe = len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 2 ** 62
    return [int(v) for v in (x if safe else x.astype(object)).sum(axis=0)]


Merge = Callable[[list[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]


def _merged(rows: DataFrame, make: Callable[[Iterator[np.ndarray]], tuple[int, np.ndarray] | None], merge: Merge, width: int) -> tuple[int, np.ndarray]:
    """One result (count, numbers) of all rows: each task makes one of its blocks, and
    groups of ``FAN`` are merged until no more than ``FAN`` are left."""
    shape, fan = "node long, n long, v array<double>", FAN

    def packed(node: int, made: tuple[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([made[0]], pa.int64()), pa.array([made[1].ravel()], pa.list_(pa.float64()))], ["node", "n", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make(_blocks(batches, width))
        if made is not None:
            yield packed(TaskContext.get().partitionId(), made)

    def join(group: pa.Table) -> pa.Table:
        order = group.sort_by("node")
        made = merge([(n, np.array(v)) for n, v in zip(order.column("n").to_pylist(), order.column("v").to_pylist(), strict=True)])
        return pa.Table.from_batches([packed(order.column("node")[0].as_py() // fan, made)])

    parts = durable(mapped(rows, run, shape))
    while parts.count() > fan:
        parts = durable(parts.groupBy(F.expr(f"node div {fan}")).applyInArrow(join, shape))
    return merge([(row.n, np.array(row.v)) for row in parts.orderBy("node").collect()])


def fit(rows: DataFrame, most: int = 4) -> Whitening | None:
    """Fit on the distinct vectors of ``rows`` (vec_id, x), each once.

    All vectors must be of one length; that of the most rows (ties: the longer)
    counts, vectors of other lengths are no part of the space. None where there is
    no vector. The list is written once, without repeats, and read three times: sums, the
    triangle, the check of the covariance. The driver holds a triangle of the
    dimension."""
    sizes = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if sizes is None:
        return None
    width = sizes.width
    listed = durable(rows.where(F.size("x") == width).select("x").distinct())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for x in _blocks(batches, width):
            n, total = n + len(x), [s + t for s, t in zip(total, _sums(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([n, *total], pa.decimal128(38, 0))], ["at", "s"])
    added = {r.at: int(r.s) for r in mapped(listed, add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    n, sums = added[-1], [added[i] for i in range(width)]
    mean = np.array([s / n for s in sums])

    def triangle(blocks: Iterator[np.ndarray]) -> tuple[int, np.ndarray] | None:
        r, seen = np.empty((0, width)), 0
        for x in blocks:
            r, seen = np.linalg.qr(np.vstack([r, x - mean]), mode="r"), seen + len(x)
        return (seen, r) if seen else None

    def stacked(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        return sum(k for k, _ in parts), np.linalg.qr(np.vstack([v.reshape(-1, width) for _, v in parts]), mode="r")
    r = _merged(listed, triangle, stacked, width)[1].reshape(-1, width)
    r = np.vstack([r, np.zeros((max(0, width - len(r)), width))])
    axes, found = directions(r, most)
    values, count = found / n, len(found)
    if not count:
        return Whitening(n, sums, axes, values, 0.0, 0.0)
    apply = axes / np.sqrt(values)

    def moments(blocks: Iterator[np.ndarray]) -> tuple[int, np.ndarray] | None:
        made = []
        for x in blocks:
            w = (x - mean) @ apply
            centre = w.mean(axis=0)
            made.append((len(w), np.concatenate([centre, ((w - centre).T @ (w - centre)).ravel()])))
        return pooled(made) if made else None

    def pooled(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        total = sum(k for k, _ in parts)
        centre = sum(k * v[:count] for k, v in parts) / total
        spread = sum(v[count:].reshape(count, count) + k * np.outer(v[:count] - centre, v[:count] - centre) for k, v in parts)
        return total, np.concatenate([centre, spread.ravel()])
    spread = _merged(listed, moments, pooled, width)[1][count:].reshape(count, count) / n
    return Whitening(n, sums, axes, values, float((r * r).sum()) / n, float(np.abs(spread - np.eye(count)).max()))


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per row of ``rows`` (vec_id, x) and component: vec_id, component (from
    1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is exact; beyond the range of long it is null. Components without
    variance are left out, so a list of one distinct vector gives no rows; neither do
    vectors of another length. Null and repeated ids are rows like any other."""
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], shape)
    width, count, (n, sums) = len(model.sums), len(model.values), model[:2]
    mean = np.array([s / n for s in sums])
    apply, explained = model.axes / np.sqrt(model.values), model.values / model.trace
    largest = max(map(abs, sums))

    def deviations(x: np.ndarray) -> list[int | None]:
        reach = n * max(abs(int(x.max())), abs(int(x.min()))) + largest
        exact = width * reach * reach < 2 ** 62
        gap = (x if exact else x.astype(object)) * n - np.array(sums, dtype=np.int64 if exact else object)
        return [int(v) if v < 2 ** 63 else None for v in (gap * gap).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, width)
            each = np.repeat(np.arange(len(x)), count)
            ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(each))
            turn = np.tile(np.arange(count), len(x))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(turn + 1, pa.int32()), pa.array(np.full(len(each), n), pa.int64()), pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array(((x - mean) @ apply).ravel()), pa.array(explained[turn]), pa.array(np.full(len(each), model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return mapped(rows.where(F.size("x") == width), run, shape)
