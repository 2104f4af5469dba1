import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from credence.llm import host_reputation, license_join, source_schedule
from credence.llm.license_join import Clause, Templates

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


LICENSED = [
    (1, "Some text\nReleased under the MIT License.\nmore"), (2, "the mit\nlicense and Apache-License, General  PUBLIC license"), (3, None), (4, ""), (5, "license mit"),
    (6, "prose before licensed beneath the apache license version 2 prose after"), (7, "Licensed under CC BY-NC 4.0."), (8, "cc by nc 4\n0 licensed under"),
    (9, "ümit license mit license mit license"), (None, "MIT License"), (1, "Some text\nReleased under the MIT License.\nmore"), (10, "word " * 40_000 + "\nThis work is licensed under the GNU General Public License"),
    (11, "source code form subject to terms of the mozilla public license v 2"),
]


def brute_scan(text):
    words = WORD.findall(lower(text))
    starts, base = [], set()
    for phrase, label in license_join.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                starts.append(i)
                base.add(label)
    best, labels = 0.0, set(base)
    for line in lower(text).split(b"\n"):
        for label, template in license_join.TEMPLATES.items():
            t = set(WORD.findall(lower(template)))
            share = len(t & set(WORD.findall(line))) / len(t)
            if 100 * share >= license_join.CONTAINMENT - 1e-9:
                labels.add(label)
                best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_license_scan_equals_brute_force(docs_of, spark):
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = LICENSED + [(i + 100, t) for i, t in given]
    got = license_join.scanned(docs_of(rows)).drop("blocks").collect()
    want = sorted((str(i), *map(str, brute_scan(t))) for i, t in rows)
    assert sorted(tuple(map(str, r)) for r in got) == want
    assert license_join.scanned(docs_of([])).collect() == []


def test_template_prefixes_lose_nothing():
    side = Templates({"a": "x1 x2 x3 x4 x5", "b": "x1 y"}, {"x1": 5, "x2": 1})
    assert [len([1 for _, places in side.index.items() for label, _ in places if label == k]) for k in "ab"] == [2, 1]
    assert side.meets([b"x1", b"x2", b"x3", b"x4"]) == {"a": 0.8}
    assert side.meets([b"x1", b"y", b"z"]) == {"b": 1.0}
    assert side.meets([b"x1", b"x2", b"x3"]) == {}


URLS = [
    ("http://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://a.net/en/x", "a.net", "/en/x", "net/", "block"), ("http://a.net", "a.net", "", None, None),
    ("http://a.net?x/y", "a.net", "", None, None), ("https://example.com/de/?q#f", "example.com", "/de/", "example.com/de/", "block"), ("x://notexample.com/de/", "notexample.com", "/de/", None, None),
    ("http://w.org/fr/a#b", "w.org", "/fr/a", "org/fr/", "allow"), ("http://org/fr", "org", "/fr", None, None), ("no scheme.net/", "", "", None, None), ("", "", "", None, None), (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None), ("http://u@H.net:80/p", "u@h.net:80", "/p", None, None), ("http://ÄB.net/", "Äb.net", "/", "net/", "block"), ("http://a.net/\nb?c", "a.net", "/\nb", "net/", "block"),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x", 3) for i, u in enumerate(URLS)], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in host_reputation.judged(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), URLS[i]
        assert got[i].verdict == (verdict or "block")
    assert host_reputation.judged(pages.where("page_id < 0"), labels).collect() == []


def test_reputation_shrinks_towards_the_domain(spark):
    good = [(i, "good.a.x", 1) for i in range(60)] + [(100 + i, "bad.b.x", 0) for i in range(60)] + [(200, "new.a.x", None), (201, "new.b.x", None), (202, "lone.c.x", None)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h, _ in good], "page_id long, url string")
    labels = spark.createDataFrame([*((i, g, 0) for i, _, g in good if g is not None), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in host_reputation.judged(pages, labels).collect()}
    assert rows[0].verdict == "allow" and rows[100].verdict == "block"
    assert rows[0].mean > rows[200].mean > rows[202].mean > rows[201].mean > rows[100].mean
    assert rows[200].bound < rows[0].bound and rows[200].labelled == 0


def test_host_reputation_is_native(spark):
    pages, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("pages", "labels"))
    plan = host_reputation.judged(pages, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


MIX = [(i, "w " * (i % 17 + 1), "en", f"s{i % 7}" if i % 3 else "big") for i in range(300)] + [(500, None, "en", "big"), (501, "", "en", "s1"), (502, "x " * 5000, "en", "s2"), (503, "lone", "en", "tiny"),
       (504, "no source here", "en", None), (505, "also none", "en", None), (506, "a", "en", ""), (507, None, "en", "void"), (None, "no id", "en", "s3"), (3, "w w w w", "en", "big"), (3, "w w w w", "en", "big")]


def filled(sizes):
    """Targets by pouring: give by weight, stop at three times the size, repeat."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("slots", [64, 1 << 18])
def test_mix_meets_its_targets(docs_of, slots):
    rows = source_schedule.mixed(docs_of(MIX), slots).collect()
    assert len(rows) == len(MIX)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = filled(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 0.5 + 1e-9
    again = source_schedule.mixed(docs_of(MIX[::-1]), slots).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_schedule_is_even(spark, docs_of):
    sources = source_schedule.targets(source_schedule.measured(docs_of(MIX)))
    total = sources.agg(F.max("total")).first()[0]
    block = max(1, -(-total // 4096))
    slots = source_schedule.schedule(sources, block, -(-total // block)).collect()
    shares = {r.key: r.target / total for r in sources.collect()}
    for stop in (200, 1000, 3000):
        for key, share in shares.items():
            assert abs(sum(1 for s in slots if s.slot < stop and s.key == key) - share * stop) < 12
    for key in shares:
        ranks = sorted(s["rank"] for s in slots if s.key == key)
        assert ranks == list(range(len(ranks)))


def test_mixture_repeats_whole_documents(docs_of):
    docs = docs_of(MIX)
    got = source_schedule.mixture(docs)
    assert got.columns == docs.columns
    times = {(r.doc_id, r.source): r.n for r in got.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    for r in source_schedule.mixed(docs).collect():
        if r.size and r.doc_id != 3:
            assert times.get((r.doc_id, r.source), 0) == int(r.taken / r.size + 0.5)
    assert source_schedule.mixture(docs_of([])).collect() == [] and source_schedule.mixed(docs_of([])).collect() == []
    blank = docs_of([(1, None, "en", "a"), (2, "", "en", "b")])
    assert [(r.size, r.target, r.taken) for r in source_schedule.mixed(blank).collect()] == [(0, 0.0, 0)] * 2


MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_BODY = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer."""
APACHE_HEADER = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License."""
GPL_HEADER = """This program is free software; you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or any later version."""


def license_labels(spark, docs_of, texts):
    rows = {r.doc_id: r for r in license_join.identified(docs_of(list(enumerate(texts)))).collect()}
    return [rows[i].labels for i in range(len(texts))], rows


def test_license_bodies_and_wrapped_notices(docs_of, spark):
    prose = "some words that stand before and after the notice in the text " * 30
    texts = [MIT_BODY, f"{prose}\n{MIT_BODY}\n{prose}", BSD_BODY, APACHE_HEADER, GPL_HEADER, "Licensed under\nCC BY-NC\n4.0.", "a Source Code Form is subject to\nthe terms of the Mozilla Public\nLicense, v. 2.0.", prose, "", None]
    got, rows = license_labels(spark, docs_of, texts)
    assert got == ["mit", "mit", "bsd", "apache", "gpl", "cc-by-nc", "mpl", "", "", ""]
    assert rows[1].score == 1.0 and rows[1].n_base == 0 and rows[7].score == 0.0


def test_windows_equal_brute_force():
    rng = random.Random(3)
    names = [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"x", b"y"]
    known = [Clause("one", (b"a", b"b", b"c", b"d", b"e"), ((b"b", b"c"),)), Clause("two", (b"a", b"b", b"a", b"f", b"g", b"c"))]
    matcher = license_join.Matcher(known, {"a": 9, "b": 5})
    met = 0
    for _ in range(3000):
        words = rng.choices(names, k=rng.randint(0, 14))
        want = {}
        for i, c in enumerate(known):
            for start in range(len(words)):
                block = words[start:start + c.window]
                whole = all(any(tuple(block[k:k + len(p)]) == p for k in range(len(block))) for p in c.required)
                share = len(set(block) & set(c.words)) / len(set(c.words))
                if whole and 100 * share >= license_join.CONTAINMENT - 1e-9:
                    want[i] = max(share, want.get(i, 0.0))
        got = {i: f[0] for i, f in matcher.met(words).items()}
        assert got == want
        met += len(got)
    assert met > 100


def test_other_licenses_and_long_lines_get_no_wrong_label(docs_of, spark):
    cases = {
        "Released under the Apache License": "apache", "Released under the BSD License": "bsd", "Licensed under CC BY 4.0": "cc-by", "Licensed under CC BY-SA 4.0": "cc-by-sa",
        "Licensed under the MIT License, Version 2.0": "mit", "This work is licensed under the GNU Lesser General Public License, version 2.1": "gpl,lgpl",
        "This work is licensed under the GNU Affero General Public License, version 3": "agpl,gpl", "Lesser General Public License and the General Public License": "gpl,lgpl",
        "released " + "word " * 50 + "under " + "word " * 50 + "the driver's license": "", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    }
    got, rows = license_labels(spark, docs_of, list(cases))
    assert got == list(cases.values())
    assert rows[5].base_labels == "gpl" and rows[8].score == 0.0


def test_registered_scan_on_odd_tables(docs_of, spark):
    """What ``identified`` gives, from the words of each text one by one."""
    long = "word " * 60_000
    texts = [None, "", "MIT License", "mit-license MIT\nlicense", "the GNU Lesser General Public License", "GNU Affero General\nPublic License", "Apache License " * 3, long + "Apache LICENSE", "GENERAL PUBLIC LICENSE", "Ünïversal mit licensé", "\x00mit\x00license"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[2]), (None, None)]
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = sorted((tuple(r) for r in license_join.identified(docs_of(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()), key=str)
    want = []
    for doc, text in rows:
        words = [w.decode() for w in re.split(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
        places = [(i, label) for i in range(len(words)) for phrase, label in phrases.items() if words[i:i + len(phrase.split())] == phrase.split()]
        base = sorted({label for _, label in places})
        more = {{"lesser": "lgpl", "affero": "agpl"}.get(words[i - 1]) for i, label in places if label == "gpl" and i} - {None}
        want.append((doc, len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *more}))))
    assert got == sorted(want, key=str)
    assert license_join.identified(docs_of([])).count() == 0
