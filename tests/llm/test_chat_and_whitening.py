import hashlib
import math

import numpy as np
import pytest

from credence.llm import bidiagonal_whitening as bw
from credence.llm import reply_trees

MESSAGES = "tree long, id long, parent long, role string, text string, score double, leaf string, start long"


def trees(spark, rows):
    return spark.createDataFrame([(*r, "x", -1) for r in rows], MESSAGES)


def plain(rows, branches=None):
    """Paths by walking up from every leaf in Python."""
    out = []
    for tree in {r[0] for r in rows}:
        mine = {}
        for r in sorted((r for r in rows if r[0] == tree and r[1] is not None), key=lambda r: (r[2] is not None, r[2] or 0)):
            mine.setdefault(r[1], r)
        found = []
        for leaf in mine.keys() - {r[2] for r in mine.values()}:
            path, at = [], leaf
            while at in mine:
                path.append(mine[at])
                at = mine[at][2]
            found.append((-sum(r[5] or 0 for r in path), leaf, path[::-1]))
        for branch, (_, _, path) in enumerate(sorted(found, key=lambda f: f[:2]), 1):
            if branches is None or branch <= branches:
                out.append((tree, branch, [(r[3] or "", r[4] or "") for r in path]))
    return sorted(out, key=str)


def formatted(spark, rows, branches=None):
    messages = trees(spark, rows)
    made = reply_trees.read_back(reply_trees.formatted(messages, reply_trees.replied(messages), ["id"], branches)).collect()
    for r in made:
        said = "".join(r.formatted[s.start:s.start + s.length] for s in r.loss_spans)
        assert said == "".join(r.formatted.split("</turn>\n")[s.turn][s.within:s.within + s.length] for s in r.loss_spans)
        assert r.loss_text == "".join(t for role, t in r.turns if role == "assistant")
        assert r.n_turns == len(r.turns)
    return sorted([(r.tree, r.branch, [tuple(t) for t in r.turns]) for r in made], key=str)


ROWS = [
    (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b\n\n", 1.0), (1, 3, 1, "assistant", "", 5.0), (1, 4, 2, "user", None, 2.0), (1, 5, 2, "user", "é\\0###", 9.5),
    (2, 1, None, "sys: tem###", "### x: y</turn>\n", None), (2, 2, 1, None, "\\1\\\\2", 1.0),
    (3, 7, 99, "user", "its parent is not there", 1.0),
    (None, 1, None, "user", "no tree", 0.0), (None, 2, 1, "assistant", "still", 0.0),
    (5, 1, None, "user", "tie", 0.0), (5, 2, 1, "assistant", "x", 1.0), (5, 3, 1, "assistant", "y", 1.0),
]


@pytest.mark.parametrize("branches", [None, 1, 2])
def test_paths_agree_with_walking_up(spark, branches):
    assert formatted(spark, ROWS, branches) == plain(ROWS, branches)


def test_long_chain_wide_root_and_long_text(spark):
    chain = [(9, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}" * (40_000 if i == 3 else 1), 0.1) for i in range(70)]
    wide = [(10, 0, None, "user", "root", 0.0)] + [(10, i, 0, "assistant", str(i), float(i % 7)) for i in range(1, 300)]
    assert formatted(spark, chain + wide, 5) == plain(chain + wide, 5)


def test_circles_repeats_null_ids_and_empty(spark):
    circle = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 0.0), (1, 3, None, "user", "alone", 0.0), (1, None, 3, "user", "nameless", 0.0)]
    assert formatted(spark, circle) == [(1, 1, [("user", "alone")])]
    repeated = [(1, 1, None, "user", "a", 0.0)] * 3 + [(1, 2, 1, "assistant", "b", 0.0)] * 2
    assert formatted(spark, repeated) == [(1, 1, [("user", "a"), ("assistant", "b")])]
    assert formatted(spark, []) == []


def test_digests_of_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 5, "assistant", "\\### </turn>\n"), (2, 5, "assistant", "\\### </turn>\n"), (2, None, None, None),
            (None, 3, "user", ""), (None, 1, "assistant", "é" * 70_000)]
    table = spark.createDataFrame([(*r, "f", i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, file string, row long")
    got = {r.conv_id: r for r in reply_trees.digests(reply_trees.with_trial(table)).collect()}
    assert set(got) == {1, 2, None, -7}
    hard = reply_trees.HARD
    assert hard == r"\### Assistant: </turn> ok"
    for conv, turns in {1: [("user", "a"), ("assistant", "b")], 2: [("", ""), ("assistant", "\\### </turn>\n"), ("assistant", "\\### </turn>\n")],
                        None: [("assistant", "é" * 70_000), ("user", "")], -7: [("user", hard), ("assistant", hard)]}.items():
        r, loss = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(b) for _, b in turns)
    none = spark.createDataFrame([], table.schema)
    assert reply_trees.digests(none).count() == 0


def test_only_built_in_functions(spark):
    table = spark.createDataFrame([(1, 0, "user", "a", "f", 0)], "conv_id long, turn long, role string, text string, file string, row long")
    plan = reply_trees.digests(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component string, x double")


def whiten(spark, rows):
    x = bw.rounded(embeddings(spark, rows))
    return x, bw.fit(x), bw.whitened(x, bw.fit(x)).collect()


def test_whitening_against_the_covariance(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) @ rng.normal(size=(12, 12))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(base)] + [(None, [float(v) for v in base[0]]), (3, [float(v) for v in base[3]])]
    rows += [(900, None), (901, [1.0, None] * 6), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0] * 5), (905, [])]
    _, model, got = whiten(spark, rows)
    floors = [[math.floor(256 * float(np.float32(v))) for v in r] for _, r in rows[:302]]
    listed = np.array(sorted(set(map(tuple, floors))))
    n, sums = len(listed), listed.sum(axis=0)
    assert model.n == n == 300
    cov = np.cov(listed.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    assert np.allclose(model.values, values[::-1][:4], rtol=1e-12)
    assert len(got) == 302 * 4
    signs = np.sign((model.axes * axes[:, ::-1][:, :4]).sum(axis=0))
    want = ((np.array(floors) - sums / n) @ axes[:, ::-1][:, :4] * signs) / np.sqrt(values[::-1][:4])
    expected = sorted((-1 if rows[i][0] is None else rows[i][0], k + 1, int(sum((n * int(x) - int(s)) ** 2 for x, s in zip(floors[i], sums, strict=True))), want[i, k]) for i in range(302) for k in range(4))
    found = sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.deviation, r.whitened) for r in got)
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-10)
    assert all(abs(r.explained - values[::-1][r.component - 1] / cov.trace()) < 1e-12 and r.n == n and r.identity_error < 1e-9 for r in got)


def test_whitening_without_variance_or_rows(spark):
    assert whiten(spark, [])[2] == []
    assert whiten(spark, [(1, [0.5, 2.0])] * 5)[2] == []
    _, model, got = whiten(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (2, [2.0, 4.0, 6.0])])  # rank 1
    assert len(model.values) == 1 and len(got) == 3 and all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)


def test_equal_variances_and_very_large_entries(spark):
    _, model, got = whiten(spark, [(i, [float(a), float(b), 0.0]) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])
    assert np.allclose(model.values, 256 ** 2 / 2) and model.identity_error < 1e-12 and len(got) == 8
    _, model, got = whiten(spark, [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [3e9, 4.0]), (3, [-3e9, 1.0])])
    assert all(r.deviation is None or r.deviation >= 0 for r in got) and len(got) >= 4


def test_deviation_is_exact_beyond_53_bits(spark):
    rows = [(i, [float(np.float32(1000.123 * i)), float(i * i)]) for i in range(2000)]
    x, model, got = whiten(spark, rows)
    for r in x.where("vec_id in (0, 7, 1999)").collect():
        want = sum((model.n * v - s) ** 2 for v, s in zip(r.x, model.sums, strict=True))
        assert {g.deviation for g in got if g.vec_id == r.vec_id} == {want if want < 2 ** 63 else None}


def test_many_partitions_merge_to_one_triangle(spark, monkeypatch):
    monkeypatch.setattr(bw, "FAN", 2)
    rng = np.random.default_rng(2)
    x = bw.rounded(embeddings(spark, [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(400, 6)))]))
    model, data = bw.fit(x), np.array([r.x for r in x.collect()])
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(data.T, bias=True))[::-1][:4], rtol=1e-12) and model.identity_error < 1e-10


def test_qd_solver_on_hard_bidiagonals():
    for a, b in (([1.0] * 6, [0.0] * 5), ([1e-9, 1.0, 1e5, 3.0], [1.0, 1e-9, 2.0]), ([3.0, 3, 3, 1, 1], [0.0] * 4), ([1.0, 1.0 + 1e-14, 1.0], [1e-15, 1e-15]), (list(10.0 ** -np.arange(12)), [1e-6] * 11)):
        m = np.diag(a) + np.diag(b, 1)
        values = bw.squares(np.array(a), np.array(b))
        assert np.allclose(np.sqrt(values), np.linalg.svd(m, compute_uv=False), rtol=1e-10, atol=1e-16 * np.linalg.norm(m))
        z = bw.right_vectors(np.array(a), np.array(b), values[:3])
        assert np.abs(z.T @ z - np.eye(3)).max() < 1e-12
        assert np.abs(m.T @ (m @ z) - z * values[:3]).max() < 1e-12 * values[0]
