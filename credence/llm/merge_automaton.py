"""Byte-pair encoding by a deterministic token automaton; decoding by arc labels.

The automaton reads tokens. It starts as one state with a loop for every base
symbol, and each merge ``u v -> w`` applies one gadget:

* the state behind ``u`` is cloned and the clone loses its arc ``v`` (``u v`` may
  no longer stand side by side);
* ``w`` gets an arc wherever ``u`` has one, and leads to a clone of the state
  behind ``v``.

All arcs with one label lead to one state, so a state is named by the token last
read. The finished automaton spells every word in exactly one way, its encoding.
Its arcs number states times labels (billions for 49,000 merges), so the tables
hold what each gadget changed: the cut arc, the sources of the two clones and the
gadget's number. An arc is resolved from these once, when first met, and then
stands in the transition table of its state.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from credence.llm.common import byte_column, mapped, slices

#: Stands for the end of a word inside the automaton; no byte symbol is mapped to it.
END = "\x00"
#: Fixed by the tokenizer file: how a normalised text is cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\p{L}\p{N}]+"
#: A worker that holds this many runs sets them aside, and forgets those that it set
#: aside before; what is met again comes back. So often for words within runs.
REMEMBERED = 75_000


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 stands
    for itself, the others take the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(shifted)) for b in range(256)]


class MergeAutomaton:
    """Transition tables compiled from a vocabulary and its ranked merges."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def inner(token: str) -> str:
            return token.removesuffix(suffix) + END if suffix and token.endswith(suffix) else token

        size = max(vocabulary.values()) + 1
        self.suffix = suffix
        self.ids = {inner(token): i for token, i in vocabulary.items()}
        self.labels = [b""] * size
        for token, i in vocabulary.items():
            self.labels[i] = token.encode()
        #: Every token and every start of one, with the longest token that it starts with (-1: none).
        self.starts: dict[str, int] = {}
        for start in sorted({token[:k] for token in self.ids for k in range(1, len(token) + 1)}, key=len):
            self.starts[start] = self.ids.get(start, self.starts.get(start[:-1], -1))
        self.length, self.shorter = [0] * size, [-1] * size
        trie = ahocorasick.Automaton()
        for token, i in self.ids.items():
            trie.add_word(token, i)
            self.length[i], self.shorter[i] = len(token), self.starts.get(token[:-1], -1)
        self.trie = trie
        self.born = [0] * size
        self.left, self.right = [-1] * size, [-1] * size
        self.cut: dict[tuple[int, int], int] = {}
        self.arcs: list[dict[int, bool]] = [{} for _ in range(size)]
        for number, (u, v) in enumerate(merges, 1):
            self._gadget(number, vocabulary[u], vocabulary[v], vocabulary[u.removesuffix(suffix) + v if suffix else u + v])

    def _gadget(self, number: int, u: int, v: int, w: int) -> None:
        self.cut.setdefault((u, v), number)
        self.left[w], self.right[w], self.born[w] = u, v, number

    def follows(self, state: int, label: int) -> bool:
        """Whether the state behind token ``state`` has an arc ``label``."""
        known = self.arcs[state].get(label)
        if known is None:
            known = self.arcs[state][label] = self._resolve(state, label)
        return known

    def _resolve(self, t: int, x: int) -> bool:
        """Undo the gadgets from the last to the first until both are base symbols."""
        limit = float(len(self.born))
        while True:
            cut = self.cut.get((t, x))
            if cut is not None and cut < limit:
                return False
            if self.born[x] and self.born[x] >= self.born[t]:
                limit, x = self.born[x] + 0.5, self.left[x]  # w joins u's arcs after the cut
            elif self.born[t]:
                limit, t = self.born[t], self.right[t]  # w's state was cloned before the cut
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Token ids of one word given as byte symbols, without the end mark."""
        if not word:
            return []
        text = word + END if self.suffix else word
        whole = self.ids.get(text)
        if whole is not None:
            return [whole]
        n, tables, length, shorter = len(text), self.arcs, self.length, self.shorter
        path: list[int] = []
        dead: set[int] = set()
        at, last, token = 0, -1, self._longest(text)
        while True:
            while token >= 0:
                stop = at + length[token]
                if stop not in dead:
                    if last < 0:
                        break
                    row = tables[last]
                    known = row.get(token)
                    if known is None:
                        known = row[token] = self._resolve(last, token)
                    if known:
                        break
                token = shorter[token]
            else:  # no arc leads on; the spelling up to here is unique, so never come back
                if not path:
                    raise ValueError(f"the base symbols don't spell {word!r}")
                dead.add(at)
                token = path.pop()
                at -= length[token]
                last, token = path[-1] if path else -1, shorter[token]
                continue
            path.append(token)
            if stop == n:
                return path
            at, last, token = stop, token, self._longest(text[stop:])

    def _longest(self, rest: str) -> int:
        """The longest label that ``rest`` starts with; ``shorter`` leads to the others."""
        return self.starts.get(rest[:self.trie.longest_prefix(rest)], -1)

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs, joined as a file without a decoder asks for."""
        return b" ".join([self.labels[i] for i in ids])


class TextEncoder(dict):
    """Whole texts to ids and back. As a dictionary it remembers, for each run of
    characters between white space, its packed ids and its decoded form; no word
    ever reaches across white space."""

    def __init__(self, definition: bytes):
        super().__init__()
        spec = json.loads(definition)
        model = spec["model"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocabulary = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = MergeAutomaton(vocabulary | {k: v for k, v in self.special.items() if k not in vocabulary},
                                        merges, model["end_of_word_suffix"] or "")
        self.marks = re.compile("(" + "|".join(re.escape(k) for k in sorted(self.special, key=len, reverse=True)) + ")")
        self.pieces = regex.compile(WORDS).findall
        self.beyond = re.compile("[^\\x00-\\x1b\\x20-\\u052f\\u2010-\\u2027\\u20a0-\\u20b5]").search
        self.splitter = Tokenizer.from_str(definition.decode())
        self.table = dict(enumerate(byte_symbols()))
        self.before: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, list[int]] = {}

    def forget(self) -> None:
        """Drop what was remembered; the automaton stays."""
        self.clear()
        self.before = {}
        self.words.clear()

    def _ids(self, symbols: str) -> list[int]:
        known = self.words.get(symbols)
        if known is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            known = self.words[symbols] = self.automaton.encode(symbols)
        return known

    def _packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), self.automaton.decode(ids)

    def _pair(self, pieces: list[str]) -> tuple[bytes, bytes]:
        return self._packed([i for symbols in pieces for i in self._ids(symbols)])

    def __missing__(self, run: str) -> tuple[bytes, bytes]:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        made = self.before.get(run)
        if made is None:
            if run.isascii() and run.isalpha():  # one word, its letters stand for themselves
                made = self._packed(self.automaton.encode(run))
            else:
                table = self.table
                made = self._pair([w.encode().decode("latin-1").translate(table) for w in self.pieces(run)])
        self[run] = made
        return made

    def _segment(self, text: str) -> list[tuple[bytes, bytes]]:
        """Characters whose class or case hangs on the version of Unicode (scripts
        beyond Cyrillic, say) are left to the file's own normaliser and splitter;
        the merges are the automaton's either way."""
        if self.beyond(text):
            split = self.splitter.pre_tokenizer.pre_tokenize_str(self.splitter.normalizer.normalize_str(text))
            return [self._pair([w for w, _ in split])]
        return list(map(self.__getitem__, unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split()))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        found: list[tuple[bytes, bytes]] = []
        for part in self.marks.split(text) if self.special else [text]:
            mark = self.special.get(part)
            found += [(struct.pack("<I", mark), part.encode())] if mark is not None else self._segment(part)
        return b"".join([p for p, _ in found]), b" ".join([s for _, s in found if s])

    def decode(self, packed: bytes) -> str:
        """Text of packed ids."""
        return self.automaton.decode(list(struct.unpack(f"<{len(packed) // 4}I", packed))).decode()


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(definition: bytes) -> TextEncoder:
    """One compiled automaton per worker process and tokenizer file."""
    key = hashlib.sha256(definition).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = TextEncoder(definition)
    return _ENCODERS[key]


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (array<int>, unless
    ``with_ids`` is off), ids_sha256 and decoded_sha256.

    Null and empty texts have no tokens. Repeated rows and null ids are encoded
    like any other row; other columns are ignored. One narrow pass, whole texts."""
    with open(path, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        for batch in slices(batches):
            both = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in byte_column(batch, "text")]
            arrays = [batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(p) // 4 for p, _ in both], pa.int64())]
            names = ["doc_id", "n_tokens"]
            if with_ids:
                arrays.append(pa.array([list(struct.unpack(f"<{len(p) // 4}I", p)) for p, _ in both], pa.list_(pa.int32())))
                names.append("ids")
            arrays += [pa.array([hashlib.sha256(p).hexdigest() for p, _ in both]), pa.array([hashlib.sha256(s).hexdigest() for _, s in both])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "ids_sha256", "decoded_sha256"])
        encoder.forget()

    shape = "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string"
    return mapped(docs.select("doc_id", "text"), run, shape)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """Per row of ``rows`` (doc_id, ids): doc_id and the text its ids spell; null
    ids spell the empty text."""
    with open(path, "rb") as file:
        definition = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode: Callable[[list[int]], bytes] = encoder_of(definition.value).automaton.decode
        for batch in slices(batches):
            texts = [decode(ids or []).decode() for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return mapped(rows.select("doc_id", "ids"), run, "doc_id long, decoded string")
