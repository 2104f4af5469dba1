import hashlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from credence.llm import token_alignment as ta

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pair():
    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=SECOND)


@pytest.fixture(scope="module")
def coder():
    with open(FIRST, "rb") as one, open(SECOND, "rb") as two:
        return ta.Encoders(one.read(), two.read())


def whole(pair, coder, text):
    """Ids of the libraries for a whole text, as the contract takes them."""
    if not text:
        return [], []
    a, b = pair[0].encode(" " + text, add_special_tokens=False).ids, pair[1].encode(text)
    want = (" " + text).encode()
    if b"".join(coder.words.a[i] for i in a) != want or b"".join(coder.words.b[i] for i in b) != want:
        return [], []
    return a, b


def unpacked(coder, text):
    packed, = coder.encode([text])
    return tuple(array(kind, ids).tolist() for kind, ids in zip(coder.words.kinds(), packed, strict=True))


def brute(pair, coder, texts):
    """The result by comparing the byte ranges of all tokens of a text."""
    out, holds = [], Counter()
    for text in texts:
        a, b = whole(pair, coder, text)
        spans = []
        for ids, names in ((a, coder.words.a), (b, coder.words.b)):
            ends = np.cumsum([len(names[i]) for i in ids]).tolist() if ids else []
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)) if ids else [])
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        both, groups, i, j = {e for _, e in spans[0]} & {e for _, e in spans[1]}, [], 0, 0
        for end in sorted(both):
            mine, i0, j0 = [], i, j
            while i < len(a) and spans[0][i][1] <= end:
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                j += 1
            mine = ",".join(map(str, a[i0:i])) + "|" + ",".join(map(str, b[j0:j]))
            groups.append(mine)
        out.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        holds.update(set(links))
    most = Counter()
    for (one, _), n in holds.items():
        most[one] = max(most[one], n)
    return [(na, nb, g, len(links), sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links), h) for na, nb, g, links, h in out]


TEXTS = ["Hello world, this isn't   a  test.\n\nNew  line", "", None, " ", "  two", "ends  ", "a", "naïve café 日本語 のテキスト 🙂🙂", "<|endoftext|> x <s> </s> <unk>", "▁ under ▁x", "tab\tand\r\nreturn",
         "null\x00byte \x1c x", "é combining", "a　b c d", "Hello world", "Hello world", "1234567890 3.14159 x=y", "word " * 3000, "x" * 5000, "ﬁ ligature ½", "﻿bom", "don't DON'T we'LL"]


@pytest.mark.parametrize("most", [1 << 19, 20, 0])
def test_against_all_byte_ranges(spark, docs_of, pair, coder, most):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])]
    got = sorted((tuple(r) for r in ta.aligned(docs_of(rows).select("*"), FIRST, SECOND, most).collect()), key=str)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(pair, coder, [t for _, t in rows]), strict=True)), key=str)
    assert got == want


def test_empty_table(spark, docs_of):
    assert ta.aligned(docs_of([]), FIRST, SECOND).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z.'\n\t\u00a0\u2009\u3000é日🙂▁\x1c0\x85ßЖ٣²½")), max_size=60))
def test_runs_encode_as_the_whole(pair, coder, text):
    a, b = unpacked(coder, text)
    assert (a, b) == tuple(map(list, whole(pair, coder, text)))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.integers(0, 2 ** 30), st.integers(1, 9), st.integers(1, 4))
def test_pieces_of_any_width_give_all_overlaps(steps, seed, width, pieces):
    a = np.cumsum(steps)
    inner = np.flatnonzero(np.random.default_rng(seed).random(a[-1] - 1) < 0.4) + 1
    b = np.append(inner, a[-1])
    found = [(int(i), int(j)) for x, y in ta.overlaps(a, b, width, pieces) for i, j in zip(x, y, strict=True)]
    starts_a, starts_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    assert found == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]]
    low, high = ta.diagonals(a, b, width)
    assert (np.diff(low + high)[:-1] == width).all() and low[-1] == len(a) and high[-1] == len(b)


def test_given_documents_encode_as_the_whole(spark, pair, coder):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert unpacked(coder, text or "") == tuple(map(list, whole(pair, coder, text)))
