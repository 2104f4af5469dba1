import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from credence.llm import ngram_join
from credence.llm.common import slices
from credence.llm.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    links = set()
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
            links.add((a, b))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, links, {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [" ".join(rng.choices(words, k=rng.randint(20, 120))) for _ in range(12)]
    for i in range(160):
        some = rng.choice(base).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            some[rng.randrange(len(some))] = f"new{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(some)))
    rows += [(500, None), (501, ""), (502, "  \t\n"), (503, "one two"), (504, "One  TWO"), (505, "one two three"),
             (506, rows[0][1].upper()), (507, "x " * 3000), (508, "y"), (509, "long " * 20_000 + "tail of it all here")]
    return rows


def test_sets_of_texts_in_groups_and_in_pieces():
    rng = random.Random(1)
    texts = [None, b"", b" \n", b"A", b"a b c d", b"a b c d e", b"A B c D e f\tg"]
    texts += [b" ".join(bytes(rng.choice(b"abXY\xc3") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for word in (b"q" * 700_000, b"Q" * 700_000, b"q" * 700_001):  # longer than a piece
        texts += [word, b"x y " + word + b" z u v w " + b"ab " * 150_000 + b"end"]
    texts.append(b" ".join(b"w%d" % i for i in range(100_000)))
    rng.shuffle(texts)
    shingler, named = ngram_join.Shingler(), {}
    for text, grams, alone in zip(texts, shingler.sets(texts), [shingler.sets([t])[0] for t in texts], strict=True):
        plain = shingles((text or b"").decode("latin-1"))
        assert grams.tolist() == alone.tolist() == sorted(set(grams.tolist())) and len(grams) == len(plain)
        assert named.setdefault(ngram_join.class_of(grams), plain) == plain
    assert len(named) == len(set(named.values()))


def test_slices_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 60 + ["y" * (40 << 20)] + [None, ""] * 300)], ["text"])
    parts = list(slices([batch]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or p.nbytes <= 1 << 24 for p in parts) and max(p.num_rows for p in parts) == 256


def test_components_equal_brute_force(docs_of, corpus):
    sets, _, roots = brute(corpus)
    got = {r.doc_id: r for r in ngram_join.near_components(docs_of(corpus)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == roots


def test_links_equal_brute_force(docs_of, corpus):
    sets, links, _ = brute(corpus)
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(a, b) for a, b in links if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]}
    got = ngram_join.linked_classes(docs_of(corpus)).collect()
    assert sorted((r.a_doc, r.b_doc) for r in got) == sorted(want)
    assert all(r.common == len(sets[r.a_doc] & sets[r.b_doc]) for r in got)


def test_repeated_rows_null_ids_and_empty_tables(docs_of):
    text = "a b c d e f g"
    rows = ngram_join.near_components(docs_of([(4, text), (4, text), (2, text), (None, text), (None, "p q r s t u"), (None, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("2", "2"), ("4", "2"), ("4", "2"), ("None", "2"), ("None", "None"), ("None", "None")]
    assert ngram_join.near_components(docs_of([])).collect() == []
    assert ngram_join.one_of_each(docs_of([])).collect() == []


def test_one_of_each_keeps_rows_whole(docs_of, corpus):
    _, _, roots = brute(corpus)
    docs = docs_of([*corpus, corpus[0], (None, "no id at all here now")])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(roots.values()))
    assert kept.where("doc_id is null").count() == 1


def test_a_large_group_of_near_copies_stays_linear(docs_of):
    base = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i % 190], f"own{i}", *base[i % 190 + 1:]])) for i in range(400)]
    join = ngram_join.Join(docs_of(rows))
    roots = join.roots()
    assert roots.select("root").distinct().count() == 1 and roots.count() == 400
    assert join._with_ends().count() < 400 * 20


def test_components_of_chains_and_loops(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}
    assert components(links.where("a < 0"), "a", "b").collect() == []


def test_unlinked_texts_of_one_id_both_stay(docs_of):
    a, b, c = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    near = a + " more"
    rows = [(3, a), (5, near), (5, b), (7, a), (7, c), (7, c), (7, ""), (9, b + " end"), (9, b), (None, c), (11, "d e f g h i")]
    want = [("11", "d e f g h i"), ("3", a), ("5", b), ("7", ""), ("7", c), ("None", c)]
    for parts in (1, 4):
        kept = ngram_join.one_of_each(docs_of(rows).repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.text) for r in kept) == want


def test_whole_sets_are_made_of_candidates_only(docs_of, monkeypatch):
    # every long text holds a short one and words that all long ones hold, so lists hold both, but their sizes differ too much
    common = [f"c{i}" for i in range(60)]
    short = [[f"own{k}x{i}" for i in range(30)] for k in range(40)]
    near = [f"near{i}" for i in range(50)]
    texts = [*short, *(s + common for s in short), near, [*near, "end"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made, whole = [], ngram_join.whole_sets
    monkeypatch.setattr(ngram_join, "whole_sets", lambda docs, classes, ranks: made.append(classes.count()) or whole(docs, classes, ranks))
    join = ngram_join.Join(docs_of(rows))
    assert join.lists.select("cls").distinct().count() == 82
    near_class = {r.node for r in join.roots().collect()}
    assert len(near_class) == 2 and sum(made) == 2
    links = ngram_join.linked_classes(docs_of(rows)).collect()
    assert [(r.a_doc, r.b_doc, r.common) for r in links] == [(80, 81, 46)]


def test_blocks_of_the_sketch_are_added_in_any_width():
    sums, want = np.zeros(ngram_join.BLOCK, np.int64), np.zeros(ngram_join.BLOCK, np.int64)
    for top in (0, 1, 255, 256, 65_535, 65_536, (1 << 32) - 1, 1 << 32, 1 << 60):
        counts = np.zeros(ngram_join.BLOCK, np.int64)
        counts[[0, 7, ngram_join.BLOCK - 1]] = top
        packed = ngram_join._packed(counts)
        assert len(packed) <= 1 + ngram_join.BLOCK * (1 if top < 256 else 8)
        ngram_join._added(sums, packed)
        want += counts
    assert sums.tolist() == want.tolist()
