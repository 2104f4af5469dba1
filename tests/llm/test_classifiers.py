import pickle
import random

import numpy as np
from pyspark.sql import functions as F

from credence.llm import labelled, ppm_language, quality_trees, toxicity_chain
from credence.llm.ppm_language import LEAD, ContextTrees, grams

FOLDER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "12 34 !?"), (None, "some words here"), (5, "word " * 40_000), (5, "word " * 40_000)]


def test_boosted_trees_learn_and_flatten():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 20))
    y = ((x[:, 3] > 0.2) ^ (x[:, 7] > 0)).astype(float)
    trees = quality_trees.grow(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.93

    def walk(row):
        total = trees.base
        for t in range(trees.feature.shape[0]):
            node = 0
            while trees.left[t, node] != node:
                node = trees.left[t, node] if row[trees.feature[t, node]] <= trees.threshold[t, node] else trees.right[t, node]
            total += trees.value[t, node]
        return 1 / (1 + np.exp(-total))
    assert np.allclose(trees.scores(x[:20]), [walk(r) for r in x[:20]])


def test_trees_without_two_classes_give_a_share():
    assert np.allclose(quality_trees.grow(np.zeros((0, 20)), np.zeros(0)).scores(np.zeros((2, 20))), 0.5)
    assert (quality_trees.grow(np.zeros((5, 20)), np.ones(5)).scores(np.zeros((2, 20))) > 0.99).all()


def test_quality_held_out(spark, docs_of):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = labelled.held_out(F.col("doc_id"))
    model = quality_trees.fit(labelled.labelled_sample(docs, labels, "quality", ~out))
    rows = quality_trees.scored(docs, model).join(labels, "doc_id").where(out)
    assert rows.where(F.col("predicted") == F.col("quality")).count() >= 0.97 * rows.count()
    odd = quality_trees.scored(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert len({r.score for r in odd if r.doc_id == 5}) == 1
    empty = labelled.labelled_sample(docs_of([]), labels, "quality", F.lit(True))
    assert quality_trees.scored(docs_of([]), quality_trees.fit(empty)).collect() == []


def slow_bits(training, text, least):
    """Code length by the definition: contexts as dictionaries, exclusion by sets."""
    counts = [{} for _ in range(4)]
    for t in training:
        b = LEAD + t
        for i in range(3, len(b)):
            for size in range(4):
                counts[size].setdefault(b[i - size:i], {}).setdefault(b[i], 0)
                counts[size][b[i - size:i]][b[i]] += 1
    total, b = 0.0, LEAD + text
    for i in range(3, len(b)):
        excluded, bits = set(), 0.0
        for size in (3, 2, 1, 0):
            seen = counts[size].get(b[i - size:i], {})
            if not seen or (size > 1 and sum(seen.values()) < least):
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            whole = sum(left.values()) + len(left)
            if b[i] in left:
                bits -= np.log2(left[b[i]] / whole)
                break
            bits -= np.log2(len(left) / whole) if left else 0
            excluded = set(seen)
        else:
            bits += np.log2(256 - len(excluded))
        total += bits
    return total


def test_code_lengths_equal_the_definition():
    rng = random.Random(2)
    training = ["".join(rng.choices("abcde ", weights=[5, 4, 3, 1, 1, 3], k=60)).encode() for _ in range(30)]
    key, n = grams(training)
    trees = ContextTrees(["xx"], np.zeros(len(key)), key, n).build()
    for text in [b"", b"a", b"abcab", b"zz top", "é ab".encode(), *training[:5], b"".join(training)]:
        assert np.isclose(trees.bits([text])[0, 0], slow_bits(training, text, ppm_language.LEAST_COUNT), rtol=1e-4, atol=len(text) / ppm_language.UNIT), text


def test_windows_don_t_change_code_lengths(monkeypatch):
    key, n = grams([b"the cat sat on the mat " * 9])
    trees = ContextTrees(["xx"], np.zeros(len(key)), key, n).build()
    texts = [b"the mat", b"", b"a cat sat " * 50, b"q"]
    whole = trees.bits(texts)
    monkeypatch.setattr(ppm_language, "WINDOW", 7)
    assert np.allclose(trees.bits(texts), whole)


def test_language_held_out(spark, docs_of):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = ppm_language.held_out(F.col("doc_id"))
    model = ppm_language.fit(docs, ~out)
    rows = ppm_language.predicted(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(out)
    assert rows.where(F.col("lang") == F.col("lang_pred")).count() >= 0.98 * rows.count()
    odd = ppm_language.predicted(docs_of(ODD), model).collect()
    assert [r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 4)] == ["und"] * 4 and len(odd) == len(ODD)
    assert all(0 <= r.score <= 1 for r in odd) and all(r.lang_pred != "und" for r in odd if r.doc_id in (5, None))
    kept = ppm_language.kept(docs_of(ODD), model)
    assert kept.columns == docs_of(ODD).columns and kept.count() == 3
    nothing = ppm_language.fit(docs_of(ODD), F.lit(True))
    assert {r.lang_pred for r in ppm_language.predicted(docs_of(ODD), nothing).collect()} == {"und"}


def test_toxicity_held_out(spark, docs_of):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = labelled.held_out(F.col("doc_id"))
    model = toxicity_chain.fit(labelled.labelled_sample(docs, labels, "toxic", ~out))
    rows = toxicity_chain.scored(docs, model).join(labels, "doc_id").where(out)
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    assert toxic.where("predicted = 1").count() >= 0.85 * toxic.count()
    assert clean.where("predicted = 0").count() >= 0.99 * clean.count()
    odd = toxicity_chain.scored(docs_of(ODD), model).collect()
    assert len(odd) == len(ODD) and {r.predicted for r in odd} == {0}
    kept = toxicity_chain.kept(docs_of([*ODD, (9, "you idiot, you moron, stupid pathetic clown")]), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ODD)
    assert kept.columns == docs_of(ODD).columns


def test_chain_feeds_earlier_categories(docs_of, spark):
    chain = pickle.loads(toxicity_chain.fit(spark.createDataFrame(
        [(i, "bad bad worse" if i % 3 == 0 else "all is well", int(i % 3 == 0), i % 5) for i in range(120)], "doc_id long, text string, label int, part int")))
    assert [len(w) - len(chain.number) - 1 for w in chain.weights] == [0, 1, 2]
    p = chain.probabilities([chain.present(b"bad bad worse"), chain.present(b"all is well")])
    assert p[0, 2] > 0.9 and p[1, 2] < 0.1
    empty = pickle.loads(toxicity_chain.fit(spark.createDataFrame([], "doc_id long, text string, label int, part int")))
    assert empty.probabilities([[]]).shape == (1, 3)


def test_samples_are_bounded_and_clean(spark, docs_of):
    docs = docs_of([(i, f"text {i}") for i in range(50)])
    labels = spark.createDataFrame([*((i, i % 2, "z") for i in range(50)), (3, 0, "z"), (None, 1, "z"), (7, None, "z")], "doc_id long, toxic int, text string")
    rows = labelled.labelled_sample(docs, labels, "toxic", ~labelled.held_out(F.col("doc_id")), most=20).collect()
    assert len(rows) == 20 and all(r.label == r.doc_id % 2 and 0 <= r.part < 5 for r in rows)
