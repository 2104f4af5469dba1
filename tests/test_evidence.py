"""Forensics, vectors and calibration against brute force and known cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.operators import crosscheck, datasets, forensics, verify


def word_rows(words, page=1):
    return [(page, i, t, 90.0, w, h) for i, (t, w, h) in enumerate(words)]


WORDS = "page_id int, pos int, text string, conf double, width int, height int"


def outliers(spark, words):
    return [r.text for r in forensics.font_outliers(forensics.font_samples(spark.createDataFrame(word_rows(words), WORDS))).collect()]


def test_font_cases(spark):
    body = [(f"word{i}x", 50, 30) for i in range(10)]
    assert outliers(spark, body + [("TAMPERED", 90, 58)]) == ["TAMPERED"]
    assert outliers(spark, body + body[:2]) == []
    assert outliers(spark, body + [("CERTIFICATE", 220, 60), ("REGISTRATION", 240, 62)]) == []
    one_word = spark.createDataFrame(word_rows(body[:1]), WORDS)
    assert forensics.font_scores(forensics.font_samples(one_word), forensics.font_outliers(forensics.font_samples(one_word))).first().score is None
    rows = spark.createDataFrame(word_rows(body + [("TAMPERED", 90, 58)]), WORDS)
    assert forensics.font_scores(forensics.font_samples(rows), forensics.font_outliers(forensics.font_samples(rows))).first().score == 0.7


def brute_components(cells):
    cells, seen, out = set(cells), set(), []
    for start in sorted(cells):
        if start in seen:
            continue
        stack, group = [start], set()
        while stack:
            y, x = stack.pop()
            if (y, x) in group or (y, x) not in cells:
                continue
            group.add((y, x))
            stack += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        seen |= group
        out.append(frozenset(group))
    return set(out)


def test_components_across_tiles_match_brute_force(spark):
    rng = random.Random(7)
    snake = [(127, x) for x in range(60, 300)] + [(y, 299) for y in range(100, 290)]
    noise = [(rng.randrange(0, 300), rng.randrange(0, 300)) for _ in range(900)]
    cells = sorted(set(snake + noise))
    frame = spark.createDataFrame([(1, y, x) for y, x in cells] + [(2, 0, 0), (2, 1, 1)], "page_id long, cy int, cx int")
    rows = forensics.cell_components(frame).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.page_id, r.comp), set()).add((r.cy, r.cx))
    assert {frozenset(v) for (p, _), v in groups.items() if p == 1} == brute_components(cells)
    assert [v for (p, _), v in groups.items() if p == 2] == [{(0, 0), (1, 1)}]
    assert len(rows) == len(cells) + 2


def test_hot_cluster_is_a_region(spark):
    cells = [(1, y, x, 60.0 if 2 <= y <= 4 and 2 <= x <= 4 else 1.0 + (x + y) % 2) for y in range(20) for x in range(20)]
    frame = spark.createDataFrame(cells, "page_id long, cy int, cx int, err double")
    regions = forensics.error_regions(forensics.cell_components(forensics.hot_cells(frame)))
    row = regions.first()
    assert (row.blocks, row.x, row.y, row.w, row.h) == (9, 32, 32, 48, 48)
    score = forensics.error_scores(frame, regions).first()
    assert (score.regions, score.coverage, score.score) == (1, 0.0225, 0.57)


def keypoint_frame(spark, points):
    return spark.createDataFrame([(1, i, float(x), float(y), *map(int, d)) for i, (x, y, d) in enumerate(points)],
                                 "page_id long, kp long, x double, y double, d0 long, d1 long, d2 long, d3 long")


def test_nearest_descriptors_match_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(forensics, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, size=(30, 4))
    points = []
    for i in range(200):
        d = base[i % 30].copy()
        d[i % 4] ^= int(rng.integers(0, 2**20))
        points.append((rng.integers(0, 900), rng.integers(0, 900), d))
    got = {(r.kp, r.other, r.dist) for r in forensics.nearest_descriptors(keypoint_frame(spark, points)).collect()}
    wanted = set()
    for i, (_, _, a) in enumerate(points):
        near = sorted((sum(bin((int(p) ^ int(q)) & (2**64 - 1)).count("1") for p, q in zip(a, b)), j) for j, (_, _, b) in enumerate(points))
        wanted |= {(i, j, d) for d, j in near[:3] if d <= 40}
    assert got == wanted


def test_one_clone_is_reported_and_a_texture_is_not(spark):
    rng = np.random.default_rng(5)
    fresh = lambda: rng.integers(-2**62, 2**62, size=4)
    clone = []
    for i in range(20):
        d = fresh()
        clone += [(10 + 17 * i, 20 + 9 * i, d), (10 + 17 * i + 200, 20 + 9 * i + 96, d)]
    points = keypoint_frame(spark, clone)
    row = forensics.clone_scores(points, forensics.offset_votes(forensics.nearest_descriptors(points))).first()
    assert row.cloned and row.top_votes == 40 and row.score == 0.15
    tile = fresh()
    texture = keypoint_frame(spark, [(x * 32, y * 32, tile) for x in range(7) for y in range(7)])
    row = forensics.clone_scores(texture, forensics.offset_votes(forensics.nearest_descriptors(texture))).first()
    assert not row.cloned and row.score == 1.0
    few = keypoint_frame(spark, clone[:10])
    assert forensics.clone_scores(few, forensics.offset_votes(forensics.nearest_descriptors(few))).first().score == 1.0


def test_metadata_cases(spark):
    rows = spark.createDataFrame([
        (1, "Adobe Photoshop", None, "2024:01:01 10:00:00", "2024:01:01 10:00:00", None), (2, "HP Scan", None, "2019:01:01 10:00:00", "2024:01:01 10:00:00", "2019-01-15"),
        (3, None, None, None, None, None), (4, "GIMP", "Adobe", "2019-01-01", "2020-01-01", "2019-06-01")],
        "id int, software string, producer string, create_date string, modify_date string, issue_date string")
    got = {r.id: (r.score, len(r.flags)) for r in forensics.metadata_checks(rows).collect()}
    assert got == {1: (0.4, 1), 2: (0.2, 2), 3: (1.0, 0), 4: (0.0, 3)}


def test_identifier_cases(one):
    check = lambda t, **k: one(crosscheck.identifier_check(F.lit(t), **k))
    assert check("TIN: 274-118-902-000").score == 1.0
    assert check("TIN: 274-118-90").score == 0.4
    assert check("Our TIN is unreadable").score == 0.85
    assert check("plain prose").score is None
    assert check("nothing", tin=F.lit("274-118-9")).score == 0.4
    assert check("Registration No: ABCDEF-1").score == 0.6


def test_pairwise_cosine_and_centroid(spark):
    rows = spark.createDataFrame([("same", [1.0, 0.0]), ("same", [2.0, 0.0]), ("mix", [1.0, 0.0]), ("mix", [1.0, 0.0]), ("mix", [0.0, 1.0]),
                                  ("lone", [1.0, 1.0]), ("avg", [2.0, 0.0]), ("avg", [0.0, 2.0])], "k string, vector array<double>")
    got = {r.k: r.consistency for r in verify.mean_pairwise_cosine(rows, ["k"]).collect()}
    assert abs(got["same"] - 1) < 1e-12 and abs(got["mix"] - 1 / 3) < 1e-12 and got["lone"] is None and abs(got["avg"]) < 1e-12
    centre = {r.k: r.centroid for r in verify.centroids(rows, ["k"]).collect()}["avg"]
    assert np.allclose(centre, [0.70710678, 0.70710678])


def brute_eer(scores, labels, low):
    lo, hi = min(scores), max(scores)
    best, best_gap = lo, 1e9
    for t in np.linspace(lo, hi, 200):
        accept = [(s <= t) if low else (s >= t) for s in scores]
        far = np.mean([a for a, y in zip(accept, labels) if y == 0])
        frr = np.mean([not a for a, y in zip(accept, labels) if y == 1])
        if abs(far - frr) < best_gap:
            best, best_gap = t, abs(far - frr)
    return best


def test_thresholds_match_brute_force(spark):
    rng = random.Random(11)
    data = [(rng.gauss(0.8 if y else 1.6, 0.3), y) for y in (0, 1) for _ in range(300)]
    frame = spark.createDataFrame(data, "distance double, label int")
    assert abs(verify.eer_threshold(frame).first().threshold - brute_eer([d for d, _ in data], [y for _, y in data], True)) < 1e-9
    similar = [(-d, y) for d, y in data]
    frame = spark.createDataFrame(similar, "similarity double, label int")
    got = verify.eer_threshold(frame, "similarity", genuine_low=False).first().threshold
    assert abs(got - brute_eer([d for d, _ in similar], [y for _, y in similar], False)) < 1e-9
    single = spark.createDataFrame([(0.5, 1), (0.6, 1)], "similarity double, label int")
    assert verify.eer_threshold(single, "similarity", genuine_low=False).first().threshold is None
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0)], "distance double, label int")
    assert verify.eer_threshold(flat).first().threshold == 0.5


def test_enrolment_gate_order(spark):
    shots = spark.createDataFrame([("ok", [1.0, 0.0])] * 3 + [("two", [1.0, 0.0])] * 2 + [("odd", [1.0, 0.0]), ("odd", [0.0, 1.0]), ("odd", [-1.0, 0.0])]
                                  + [("cut", [1.0, 0.0])] * 3, "photo_id string, vector array<double>")
    hard = spark.createDataFrame([("ok", False), ("two", True), ("odd", True), ("cut", True), ("none", False)], "photo_id string, hard_flag boolean")
    got = {r.photo_id: r.reason for r in verify.enrolment_verdicts(shots, hard).collect()}
    assert got == {"ok": None, "two": "signature_count", "odd": "signature_similarity", "cut": "signature_edited", "none": "signature_count"}


def test_pairs_alternate_and_differ(spark):
    pool = spark.createDataFrame([(v, v * 100 + i, i % 4 != 0) for v in (1, 2) for i in range(12)] + [(3, 300, True), (3, 301, True)], "vendor int, item int, genuine boolean")
    rows = datasets.training_pairs(pool, "vendor", "item", 6).collect()
    genuine = {i: g for _, i, g in [tuple(r) for r in pool.collect()]}
    for r in rows:
        assert genuine[r.left_id] and genuine[r.right_id] == bool(r.label)
        assert r.left_id != r.right_id
    assert {(r.vendor, r.label) for r in rows} == {(1, 0), (1, 1), (2, 0), (2, 1), (3, 1)}


def test_skewed_vendor_gives_the_same_result_for_any_partitioning(spark):
    rows = [(0 if i % 3 else i, [float(i % 5), 1.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, vector array<double>")
    runs = [sorted((r.k, r.members, round(r.consistency or 0, 9)) for r in verify.mean_pairwise_cosine(frame.repartition(n), ["k"]).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    big = [v for k, v in rows if k == 0]
    u = [np.array(v) / np.linalg.norm(v) for v in big]
    wanted = np.mean([a @ b for a, b in itertools.combinations(u, 2)])
    assert abs(dict((k, c) for k, _, c in runs[0])[0] - wanted) < 1e-8


def test_line_between_classes(spark):
    rows = spark.sql("SELECT id, transform(array(id % 2, 1 - id % 2, 0.5), x -> CAST(x AS DOUBLE)) AS vector, CAST(id % 2 AS INT) AS label FROM range(20)")
    weights, bias = verify.class_gap(rows)
    scored = rows.withColumns({"w": weights, "b": bias}).withColumn("p", verify.logistic_score(F.col("vector"), F.col("w"), F.col("b")))
    assert all((r.p > 0.5) == (r.label == 1) for r in scored.collect())


def test_national_issuer_falls_back_to_the_single_reference(spark):
    documents = spark.sql("SELECT * FROM VALUES (1, 6, 'national', null), (2, 7, 'national', null), (3, 5, 'lgu', 'Here'), (4, 6, 'lgu', 'Here') t(d, document_type_id, issuer_scope, city)")
    held = spark.sql("SELECT 7 AS document_type_id, '' AS city, 70 AS reference_id, array(1.0D) AS feature_vector")
    single = spark.sql("SELECT 6 AS document_type_id, 60 AS reference_id, array(2.0D) AS feature_vector UNION ALL SELECT 7, 71, array(3.0D) UNION ALL SELECT 5, 50, array(4.0D)")
    got = {r.d: (r.reference_id, r.reason) for r in verify.resolve_issuer(documents, held, single).collect()}
    assert got == {1: (60, None), 2: (70, None), 3: (None, "unreferenced_logo"), 4: (None, "unreferenced_logo")}


def test_flags_of_techniques(spark):
    words = spark.sql(r"""SELECT * FROM VALUES (1, 3, "it's", 'height'), (1, 4, 'say "x"', 'spacing'), (1, 5, 'back\\slash', 'height'), (1, 6, "b'o\"th", 'height') t(page_id, pos, text, metric)""")
    got = {r.pos: r.flag for r in forensics.font_flags(words).collect()}
    assert got == {r.pos: f"Font mismatch on field {r.text!r} ({r.metric})" for r in words.collect()}
    regions = spark.sql("SELECT 1 AS page_id, id AS comp, 4 AS blocks, id * 16 AS x, 0 AS y, 32 AS w, 16 AS h FROM range(6)")
    assert [r.flag for r in forensics.error_flags(regions).orderBy("pos").collect()] == [f"ELA: anomalous compression region at [{i * 16}, 0, 32, 16]" for i in range(4)]


def test_texture_model_learns_what_class_means_miss(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 1500)
    noise = rng.normal(size=(1500, 1)) * 10  # large and shared by two components
    data = np.hstack([noise + 0.8 * label[:, None], noise - 0.8 * label[:, None], rng.normal(size=(1500, 1)) * 5])
    rows = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(data, label, strict=True))], "k long, vector array<double>, label int")
    out = F.pmod(F.xxhash64("k"), F.lit(5)) == 0
    model = verify.fit_texture(rows.where(~out), "k")
    assert model.taught == rows.where(~out).count()
    assert verify.texture_accuracy(model, rows.where(out)) > 0.95
    weights, bias = verify.class_gap(rows.where(~out))
    plain = rows.where(out).withColumns({"w": weights, "b": bias}).withColumn("p", verify.logistic_score(F.col("vector"), F.col("w"), F.col("b")))
    assert plain.where((F.col("p") > 0.5) == (F.col("label") == 1)).count() < 0.9 * plain.count()
    taught = [r for r in rows.where(~out).collect()]
    x, y = np.array([r.vector for r in taught]), np.array([r.label for r in taught])
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.bias)))  # at the optimum both slopes vanish
    assert np.abs(x.T @ (p - y) + model.weights).max() < 0.5 and abs((p - y).sum()) < 0.05
    assert 200 < verify.fit_texture(rows, "k", most=300).taught < 400
    assert verify.texture_accuracy(model, rows.where("k < 0")) is None
    with pytest.raises(ValueError):
        verify.fit_texture(rows.where("label = 1"), "k")
