import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import collision_search, pivot_search, vector_blocks

SHAPE = "vec_id long, embedding array<float>, label int, rank int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    some = rng.normal(size=(700, 16))
    some[300:400] = some[300] + 0.02 * rng.normal(size=(100, 16))
    some[400:440] = some[400]
    rows = [(i, [float(x) for x in v], 0, 0, "") for i, v in enumerate(some.astype("f4"))]
    rows += [(1000, None, 0, 0, ""), (1020, [0.0] * 16, 0, 0, ""), (1040, [1.0] * 15 + [None], 0, 0, ""), (1060, [1.0] * 15 + [float("nan")], 0, 0, ""),
             (1080, [float("inf")] * 16, 0, 0, ""), (1100, [], 0, 0, ""), (None, [1.0] * 16, 0, 0, ""), (20, rows[20][1], 0, 0, ""), (2000, [1.0, 2.0], 0, 0, ""), (2001, [3.0, 1.0], 0, 0, "")]
    return spark.createDataFrame(rows, SHAPE), some.astype("f4")


def exact(x, query, k, ids=None):
    score = (x * x[query]).sum(1)
    ids = np.arange(len(x)) if ids is None else ids
    order = [i for i in np.lexsort([ids, -score]) if i != query][:k]
    return [(int(ids[i]), score[i]) for i in order]


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r)
    return out


@pytest.mark.parametrize("block", [150, 4096])
def test_pivot_search_is_exact(vectors, block, monkeypatch):
    monkeypatch.setattr(vector_blocks, "DATA_ROWS", block)
    frame, some = vectors
    got = by_query(pivot_search.highest(frame, F.col("vec_id") % 100 == 0).collect())
    x = np.vstack([np.floor(1024 * some.astype(float)).astype(int), np.zeros((1, 16), int)])
    ids = np.append(np.arange(700), 1020)
    for query in range(0, 700, 100):
        assert [(r.vec_id, r.score) for r in got[query]] == exact(x, query, 10, ids)
        assert [r["rank"] for r in got[query]] == list(range(1, 11))
    assert [(r.vec_id, r.score) for r in got[2000]] == [(2001, (3 * 1 + 2) * 1024 * 1024)]
    assert set(got) == {*range(0, 700, 100), 2000}


@pytest.mark.parametrize("block", [200, 4096])
def test_collision_search_recall_and_scores(vectors, block, monkeypatch):
    monkeypatch.setattr(vector_blocks, "DATA_ROWS", block)
    frame, some = vectors
    got = by_query(collision_search.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    x, hits = some.astype(float), 0
    for query in range(0, 700, 20):
        want = exact(x, query, 20)
        hits += len({i for i, _ in want} & {r.vec_id for r in got[query]})
        for r in got[query]:
            assert r.vec_id != query and np.isclose(r.score, (x[r.vec_id] * x[query]).sum(), rtol=1e-12)
        assert [(-r.score, r.vec_id) for r in got[query]] == sorted((-r.score, r.vec_id) for r in got[query])
        assert [r["rank"] for r in got[query]] == list(range(1, 21))
    assert hits >= 0.95 * 35 * 20
    assert [r.vec_id for r in got[400]] == list(range(401, 421))
    assert 1020 not in got and 1000 not in got


def test_searches_of_empty_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert collision_search.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    assert pivot_search.highest(empty, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, "")], SHAPE)
    assert pivot_search.highest(one, F.col("vec_id") % 100 == 0).collect() == []
    assert collision_search.nearest(one, F.col("vec_id") % 20 == 0).collect() == []


def test_recall_on_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = by_query(collision_search.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    rows = frame.orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    hits = total = 0
    for query in ids[ids % 20 == 0]:
        want = exact(x, int(np.searchsorted(ids, query)), 20, ids)
        hits, total = hits + len({i for i, _ in want} & {r.vec_id for r in got[query]}), total + len(want)
    assert hits >= 0.93 * total
