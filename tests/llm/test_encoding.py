import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credence.llm import merge_automaton
from credence.llm.merge_automaton import MergeAutomaton, TextEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return TextEncoder(file.read())


def texts():
    rng = random.Random(5)
    alphabets = ["a", "ab", "aeiou", "abcdefghijklmnopqrstuvwxyz", "ha the in", "!?.-", "éüßΣİ x", "0123 abc", "漢字 かな", "áَ b", "\x1c\x1d\x85 a"]
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.choice([1, 4, 12, 60]))) for _ in range(1500)] + [
        "".join(rng.choices(a, k=rng.choice([3, 9, 40]))) for a in alphabets for _ in range(60)] + [
        "", " ", "<|endoftext|>", "x<|startoftext|>Y<|endoftext|", "don't WE'LL I'm", "a" * 5000, "ΑΣ ΣΑ", "é ñ"]


def test_ids_and_decoding_equal_the_library(library, encoder):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        packed, shown = encoder.encode(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want, text
        assert shown.decode() == encoder.decode(packed) == library.decode(want, skip_special_tokens=False), text


def ranked(symbols, merges):
    while True:
        pairs = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (a, b) in merges]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2:]]


def test_automata_of_small_merge_lists_equal_ranked_merging():
    rng = random.Random(7)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(12):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens and ranked(list(u + v), merges) == [u, v]:
                merges.append((u, v))
                tokens.append(u + v)
        automaton = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges, "")
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert [tokens[i] for i in automaton.encode(word)] == ranked(list(word), merges)


def test_rows_of_a_table(docs_of, library):
    rows = [(1, "Hello there, World"), (2, None), (3, ""), (None, "x y"), (1, "Hello there, World"), (4, "word " * 30_000)]
    out = merge_automaton.encoded(docs_of(rows), PATH)
    got = out.collect()
    assert len(got) == len(rows)
    for row in got:
        text = {1: rows[0][1], None: "x y", 4: rows[5][1]}.get(row.doc_id, "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.decoded for r in merge_automaton.decoded(out, PATH).collect()}
    assert back[1] == library.decode(library.encode(rows[0][1], add_special_tokens=False).ids, skip_special_tokens=False) and back[2] == ""
    assert merge_automaton.encoded(docs_of([]), PATH).collect() == []
