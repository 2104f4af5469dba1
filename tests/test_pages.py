"""Operators within pages against plain Python: grids, components, exact medians."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.operators import forensics, grid, layout, linking


def rounded_sort(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


def test_boxes_meet_regions_over_the_grid(spark):
    rng = random.Random(3)
    side = grid.CELL
    edges = [0, side - 1, side, side + 1, 2 * side, -side, -1, 5]
    boxes = [(p, float(rng.choice(edges) + rng.choice([0, 0, rng.randint(-200, 900)])), float(rng.choice(edges) + rng.choice([0, rng.randint(0, 700)])),
              float(rng.choice([1, side, 2 * side, 37, 0, 300])), float(rng.choice([1, side, 19, -2, 250]))) for p in (1, 2, None) for _ in range(250)]
    rois = [(p, f"f{k}", rng.choice([0.0, 0.128, 0.256, 0.3, -0.1]), rng.choice([0.0, 0.16, 0.32]), rng.choice([0.128, 0.5, 1.0, 30.0]), rng.choice([0.16, 0.9])) for p in (1, 2, 3) for k in range(6)]
    got = layout.match_rois(spark.createDataFrame(boxes, "page_id long, left double, top double, width double, height double"),
                            spark.createDataFrame([(*r, 1000, 800) for r in rois], "page_id long, field_key string, x double, y double, w double, h double, page_width int, page_height int"))
    want = {}
    for page, left, top, width, height in boxes:
        for p, key, x, y, w, h in rois:
            if p == page and width > 0 and height > 0:
                wide = max(0.0, min(left + width, x * 1000 + w * 1000) - max(left, x * 1000))
                high = max(0.0, min(top + height, y * 800 + h * 800) - max(top, y * 800))
                if wide * high / (width * height) >= 0.5:
                    want.setdefault((p, key), []).append((left, top, left + width, top + height))
    want = [(p, key, min(b[0] for b in hits), min(b[1] for b in hits), max(b[2] for b in hits) - min(b[0] for b in hits), max(b[3] for b in hits) - min(b[1] for b in hits), len(hits)) for (p, key), hits in want.items()]
    assert len(want) > 8 and rounded_sort(got.collect()) == rounded_sort(want)


def test_words_in_bands_that_reach_very_far(spark):
    rng = random.Random(8)
    words = [(p, i, f"w{i}", rng.randint(-50, 700), rng.choice([0, 64, 128, 190]), rng.choice([0, 10, 128]), 20) for p in (1, 2) for i in range(120)]
    bands = [(1, "all", -1e9, 1e9, -1e9, 1e9), (1, "half", 64.0, 128.0, 0.0, 138.0), (2, "right", 128.0, 1e9, 74.0, 200.0), (3, "none", 0.0, 1.0, 0.0, 1.0)]
    got = layout.words_in_bands(spark.createDataFrame(words, "page_id long, pos int, text string, left int, top int, width int, height int"),
                                spark.createDataFrame(bands, "page_id long, field_key string, x0 double, x1 double, y0 double, y1 double"))
    want = [(b[1], w[0], w[1]) for w in words for b in bands if b[0] == w[0] and b[2] <= w[3] + w[5] / 2 < b[3] and b[4] <= w[4] + w[6] / 2 < b[5]]
    assert sorted((r.field_key, r.page_id, r.pos) for r in got.collect()) == sorted(want)
    assert set(got.columns) - {grid.X, grid.Y} >= {"page_id", "field_key", "pos", "text"}


def test_a_page_is_spread_over_its_cells(spark):
    boxes = spark.range(20_000).selectExpr("1L AS page_id", "CAST(id % 200 * 50 AS DOUBLE) AS left", "CAST(id div 200 * 50 AS DOUBLE) AS top", "40.0D AS width", "40.0D AS height")
    dealt = grid.boxes(boxes, F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height"))
    assert dealt.groupBy("page_id", grid.X, grid.Y).count().agg(F.max("count")).first()[0] <= 25


def flood(cells):
    """Smallest cell of the component of every cell, by walking."""
    left, out = set(cells), {}
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for step in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if step in left:
                    left.remove(step)
                    todo.append(step)
        out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.mark.parametrize("share", [0.2, 0.4, 0.6])
def test_tile_labels_against_walking(share):
    rng = np.random.default_rng(int(share * 10))
    cells = [(int(y) - 3, int(x) + 7) for y, x in zip(*np.nonzero(rng.random((40, 40)) < share), strict=True)]
    rng.shuffle(cells)
    y, x = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])
    got = forensics.label_tile(y, x, y * 4294967296 + x)
    want = flood([tuple(map(int, c)) for c in cells])
    assert got.tolist() == [want[a, b][0] * 4294967296 + want[a, b][1] for a, b in zip(y.tolist(), x.tolist(), strict=True)]


def test_components_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(forensics, "TILE", 4)
    rng = random.Random(1)
    snake = [(y, x) for y in range(0, 13, 4) for x in range(60)] + [(y, 59 if (y // 4) % 2 == 0 else 0) for y in range(13)]
    noise = [(rng.randint(20, 60), rng.randint(0, 60)) for _ in range(700)]
    pages = {1: set(snake), 2: set(noise), 3: {(0, 0)}}
    frame = spark.createDataFrame([(p, y, x) for p, cells in pages.items() for y, x in cells], "page_id long, cy int, cx int")
    got = {(r.page_id, r.cy, r.cx): r.comp for r in forensics.cell_components(frame).collect()}
    want = {(p, *c): r[0] * 4294967296 + r[1] for p, cells in pages.items() for c, r in flood(cells).items()}
    assert got == want


@pytest.mark.parametrize("order", ["rising", "shuffled", "star"])
def test_rounds_grow_with_the_logarithm(spark, order):
    n = 64
    names = list(range(n))
    if order == "shuffled":
        random.Random(5).shuffle(names)
    pairs = [(7, names[0], m) for m in names[1:]] if order == "star" else [(7, names[i], names[i + 1]) for i in range(n - 1)]
    pairs += [(8, 5, 4), (8, 5, 5), (8, 4, 5), (9, 1, 2), (9, 3, 4)]
    roots, rounds = linking.connected(spark.createDataFrame(pairs, "page_id long, a long, b long"), "page_id")
    got = {(r.page_id, r.node): r.root for r in roots.collect()}
    assert rounds <= 8 and got == {**{(7, k): 0 for k in range(n)}, (8, 4): 4, (8, 5): 4, (9, 1): 1, (9, 2): 1, (9, 3): 3, (9, 4): 3}
    nothing, rounds = linking.connected(spark.createDataFrame([], "page_id long, a long, b long"), "page_id")
    assert rounds == 0 and nothing.count() == 0


def font_by_hand(rows):
    """page_id, pos and metric of the outliers without a peer, word by word."""
    out = []
    for page in {r[0] for r in rows}:
        good = [(pos, text, float(h), w / len(text.strip())) for p, pos, text, conf, w, h in rows if p == page and len(text.strip()) >= V.FONT_MIN_LENGTH and conf >= V.FONT_MIN_CONFIDENCE and w > 0 and h > 0]
        if len(good) < V.FONT_MIN_SAMPLES:
            continue
        z = []
        for k in (2, 3):
            middle = statistics.median(g[k] for g in good)
            scale = max(statistics.median(abs(g[k] - middle) for g in good) * V.MAD_SCALE, middle * V.FONT_MAD_FLOOR)
            z.append([0.0 if scale <= 1e-9 else abs(g[k] - middle) / scale for g in good])
        odd = [(g[0], "height" if hz >= wz else "spacing", g[2] if hz >= wz else g[3]) for g, hz, wz in zip(good, *z, strict=True) if hz >= V.FONT_MAD_Z or wz >= V.FONT_MAD_Z]
        out += [(page, pos, metric) for pos, metric, value in odd if not any(o[0] != pos and o[1] == metric and abs(o[2] - value) <= V.FONT_PEER_TOLERANCE * value for o in odd)]
    return sorted(out)


def test_font_outliers_against_words_one_by_one(spark):
    rng = random.Random(11)
    rows = [(p, i, rng.choice(["word", "longer", "ab", "  pad  ", "x" * rng.randint(3, 9)]), rng.randint(20, 99), rng.choice([rng.randint(20, 60), 0, rng.randint(1, 400)]), rng.choice([30, 31, 32, rng.randint(5, 200)]))
            for p in range(6) for i in range((3, 8, 40, 120, 121, 1)[p])]
    frame = spark.createDataFrame(rows, "page_id long, pos int, text string, conf int, width int, height int")
    got = sorted((r.page_id, r.pos, r.metric) for r in forensics.font_outliers(forensics.font_samples(frame)).collect())
    assert got == font_by_hand(rows) and len(got) > 5


def test_weighted_medians(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([1.5, 2.0, 7.25, -3.0]) if k else 4.0) for k in range(4) for _ in range(rng.randint(1, 12))]
    counts = spark.createDataFrame(rows, "k int, v double").groupBy("k", "v").count()
    got = {r.k: (r.m, r.n) for r in forensics.weighted_medians(counts, ["k"], "v", "count", "m").collect()}
    assert got == {k: (statistics.median(v for j, v in rows if j == k), sum(j == k for j, _ in rows)) for k in range(4)}


def test_documents_are_read_once_for_fonts(spark, tmp_path):
    from credence.plans import evidence_queries
    spark.createDataFrame([(1, "some words " * 30)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    result = forensics.font_outliers(forensics.font_samples(evidence_queries.words(spark, str(tmp_path))))
    assert "documents.parquet" not in result._jdf.queryExecution().executedPlan().toString()  # all that follows reads the written samples
