"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Tokens of A and B cut one line of bytes at their ends. Merging both lists of ends
gives, between every two neighbouring ends, one A and one B token that overlap (a
link), and where both end at once, a group closes. The merge is divided by diagonals:
a binary search on the k-th one finds how many ends of each list belong to the first
k * width steps, so pieces of equal work are merged independently, however long or
short the texts are that they cross; what a piece leaves open is stitched to the next
one by the running number of closed groups.

Texts are encoded once and their ids kept in a written table. How many documents hold
a pair of ids linked is counted over all of them; the most frequent pairs (a bounded
number) are looked up in a broadcast table, the rest meet their counts in a join, in
which no key is hot, since rare pairs are what is left.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import byte_column, durable, give_back, mapped

#: Steps of a piece, pieces merged at once, packed ids of a batch of texts in bytes,
#: texts of a batch in bytes.
WIDTH, PIECES, PACKED, BYTES = 1024, 128, 500_000, 2_000_000
#: Pairs held in the broadcast table; runs of text a worker remembers.
FREQUENT, REMEMBERED = 1 << 19, 300_000
#: A single blank between two characters that are no white space. A's words begin at
#: such a blank, and no piece of B has a blank mark inside, so neither tokenizer ever
#: joins what stands before it with what follows.
CUT = re.compile(r" (?<=\S )(?=\S)")
#: Fixed by A's file: how a text is cut into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond Cyrillic and common punctuation.
BEYOND = re.compile("[^\\x00-\u052f\u2010-\u2027\u20a0-\u20b5]").search


def diagonals(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come within the first 0, width, 2 * width ...
    steps of their merge (ties: ``a`` first), by binary search on every diagonal."""
    steps = np.minimum(np.arange(0, len(a) + len(b) + width, width), len(a) + len(b))
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        inside = np.minimum(middle, len(a) - 1)
        take = open_ & (a[inside] <= b[np.clip(steps - 1 - middle, 0, len(b) - 1)])
        low, high = np.where(take, middle + 1, low), np.where(open_ & ~take, middle, high)
    return low, steps - low


def overlaps(a: np.ndarray, b: np.ndarray, width: int = WIDTH, pieces: int = PIECES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (index in ``a``, index in ``b``) in the order of bytes, for rising ends
    whose last ones agree. A row of the matrix is one piece, merged by itself."""
    if not len(a):
        return
    from_a, from_b = diagonals(a, b, width)
    for at in range(0, len(from_a) - 1, pieces):
        i0, j0 = from_a[at:at + pieces + 1], from_b[at:at + pieces + 1]
        i0, i1, j0, j1 = i0[:-1, None], i0[1:, None], j0[:-1, None], j0[1:, None]
        step = np.arange(width)[None, :]
        ours, theirs = step < i1 - i0, step < (i1 - i0) + (j1 - j0)
        ends = np.where(ours, a[np.minimum(i0 + step, len(a) - 1)] * 2, b[np.clip(j0 + step - (i1 - i0), 0, len(b) - 1)] * 2 + 1)
        merged = np.sort(np.where(theirs, ends, np.iinfo(np.int64).max), axis=1, kind="stable")
        second = (merged & 1).astype(bool)
        i, j = i0 + np.cumsum(~second, axis=1) - ~second, j0 + np.cumsum(second, axis=1) - second
        closed = second & (i > 0) & (a[np.clip(i - 1, 0, len(a) - 1)] == b[np.clip(j, 0, len(b) - 1)])  # the A token that ended here came first
        kept = theirs & ~closed
        yield i[kept], j[kept]


class Vocabularies(NamedTuple):
    """Bytes of every token of A and B, and the bits that a B id takes."""
    a: list[bytes]
    b: list[bytes]

    @property
    def bits(self) -> int:
        return max(1, (len(self.b) - 1).bit_length())

    def kinds(self) -> tuple[str, str]:
        """Type codes of packed ids: two bytes where a vocabulary allows, else four."""
        return tuple("H" if len(names) <= 1 << 16 else "I" for names in self)

    def widths(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(t) for t in self.a]), np.array([len(t) for t in self.b])


def _visible() -> dict[str, int]:
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


#: The byte that each visible character stands for: printable Latin-1 for itself, the
#: code points from 256 on for the other bytes, in order.
_BYTES = _visible()


def byte_level(token: str) -> bytes:
    """Bytes of a byte-level token; one with other characters is taken as it is."""
    try:
        return bytes([_BYTES[c] for c in token])
    except KeyError:
        return token.encode()


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a blank, <0xHH> the byte HH."""
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


class Shape(NamedTuple):
    """What tasks need of the vocabularies: bytes per token, bits of a B id, types."""
    widths: tuple[np.ndarray, np.ndarray]
    bits: int
    kinds: tuple[str, str]


class Encoders:
    """Both tokenizers, and the packed ids of the runs of text met lately. A run is
    what stands between two cuts; A takes it after a blank, B puts that blank itself.

    Runs of characters whose class does not hang on the version of Unicode are merged
    by the ranks of A's file, which are its ids; others by its own library."""

    def __init__(self, first: bytes, second: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(first.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        model = json.loads(first)["model"]
        names = {i: t for t, i in self.a.get_vocab(True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.words = Vocabularies([byte_level(names[i]) if i in names else b"" for i in range(max(names) + 1)], [piece_bytes(p) for p in pieces])
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        merges = ["".join(m.split(" ", 1) if isinstance(m, str) else m) for m in model["merges"]]
        ranked = all(model["vocab"][m] == 256 + k for k, m in enumerate(merges))
        ranks = {byte_level(t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy if ranked else None
        self.sizes = self.words.widths()
        self.forget()

    def forget(self) -> None:
        """Drop the runs; the tokenizers stay."""
        self.packed: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.uneven: set[str] = set()

    def _learn(self, runs: list[str]) -> None:
        """Encode runs, two thousand as one text where blanks may stand between them:
        its ids fall apart at the ends of the runs."""
        kinds, joins = self.words.kinds(), [r for r in runs if self.quick and self.apart and not BEYOND(r) and not r[0].isspace() and not r[-1].isspace()]
        rest = [r for r in runs if r not in set(joins)] if len(joins) < len(runs) else []
        for at in range(0, len(joins), 2000):
            part = joins[at:at + 2000]
            line = " ".join(part)
            both = np.asarray(self.quick(" " + line)), np.array(self.b.encode(line))
            if b"".join([self.words.b[i] for i in both[1].tolist()]) != b" " + line.encode():
                rest += part
                continue
            ends = np.cumsum([len(r.encode()) + 1 for r in part])
            for known, ids, width, kind in zip(self.packed, both, self.sizes, kinds, strict=True):
                packed, size = ids.astype(kind).tobytes(), array(kind).itemsize
                stops = ((np.searchsorted(np.cumsum(width[ids]), ends) + 1) * size).tolist()
                known.update(zip(part, [packed[a:b] for a, b in itertools.pairwise([0, *stops])], strict=True))
        for run in rest:
            whole = (" " + run).encode()
            for known, names, ids, kind in zip(self.packed, self.words, (self.a.encode(" " + run, add_special_tokens=False).ids, self.b.encode(run)), kinds, strict=True):
                known[run] = array(kind, ids).tobytes()
                if whole != b"".join([names[i] for i in ids]):
                    self.uneven.add(run)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of A and of B of every text; none where a text is empty or where
        the bytes of its tokens are not a blank and the text."""
        if len(self.packed[0]) > REMEMBERED:
            self.forget()
        runs = [(CUT.split(t) if self.apart else [t]) if t else [] for t in texts]
        self._learn([r for r in dict.fromkeys(itertools.chain.from_iterable(runs)) if r not in self.packed[0]])
        out = []
        for text, parts in zip(texts, runs, strict=True):
            a, b = (b"".join(map(known.__getitem__, parts)) for known in self.packed)
            if self.uneven and not self.uneven.isdisjoint(parts):
                whole = b" " + text.encode()
                if any(whole != b"".join([names[i] for i in array(kind, ids)]) for names, kind, ids in zip(self.words, self.words.kinds(), (a, b), strict=True)):
                    a = b = b""
            out.append((a, b))
        return out


_ENCODERS: dict[str, Encoders] = {}


def encoders_of(first: bytes, second: bytes) -> Encoders:
    """One pair of tokenizers per worker process."""
    key = hashlib.sha256(first + b"|" + second).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoders(first, second)
    return _ENCODERS[key]


def unload() -> None:
    """Give up the tokenizers: the stages after the first work on ids alone."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()


def tokens(docs: DataFrame, first: bytes, second: bytes) -> DataFrame:
    """doc_id, a and b (packed ids) per row of ``docs``; other columns are ignored. One
    narrow pass, texts a few MB at a time."""
    files = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders_of(*files.value)
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), byte_column(batch, "text")
            for start, stop in bounded([len(t or b"") for t in texts], BYTES):
                both = coder.encode([(t or b"").decode("utf-8", "replace") for t in texts[start:stop]])
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), *(pa.array([p[n] for p in both], pa.binary()) for n in (0, 1))], ["doc_id", "a", "b"])
        coder.forget()
    return mapped(docs.select("doc_id", "text"), run, "doc_id long, a binary, b binary")


def bounded(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` at the most, or of one row."""
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if sizes:
        yield start, len(sizes)


class Aligned(NamedTuple):
    """A batch of texts aligned as one line of bytes. Token ids and, per text, where
    its tokens begin; links by token index, and the pairs of ids each text holds with
    how often it has them linked."""
    a: np.ndarray
    b: np.ndarray
    starts_a: np.ndarray
    starts_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, and the sum of ``times`` of each."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def align(ids_a: list[bytes], ids_b: list[bytes], words: Shape) -> Aligned:
    """Align the texts of a batch."""
    widths, bits = words.widths, words.bits
    packed = [np.frombuffer(b"".join(ids), dtype=kind) for ids, kind in zip((ids_a, ids_b), words.kinds, strict=True)]
    starts_a, starts_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids]) // p.itemsize]).astype(np.int64) for ids, p in zip((ids_a, ids_b), packed, strict=True))
    a, b = (p.astype(np.int64) for p in packed)
    ends_a, ends_b = np.cumsum(widths[0][a]), np.cumsum(widths[1][b])
    owner = np.repeat(np.arange(len(ids_a)), np.diff(starts_a))
    room = int(len(widths[0]) - 1).bit_length() + bits
    keys, times, last_a, last_b = [], [], [], []
    for i, j in overlaps(ends_a, ends_b):
        closes = ends_a[i] == ends_b[j]
        last_a.append(i[closes])
        last_b.append(j[closes])
        found, often = np.unique(owner[i] << room | a[i] << bits | b[j], return_counts=True)
        keys.append(found)
        times.append(often)
    none = np.empty(0, dtype=np.int64)
    joined = lambda parts: np.concatenate(parts) if parts else none
    key, count = summed(joined(keys), joined(times))
    return Aligned(a, b, starts_a, starts_b, joined(last_a), joined(last_b), key >> room, key & ((1 << room) - 1), count)


def batches_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Rows of a table of tokens, a bounded number of tokens at a time."""
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("a", "b"))
        for start, stop in bounded([len(x) + len(y) for x, y in zip(a, b, strict=True)], PACKED):
            yield batch.slice(start, stop - start), a[start:stop], b[start:stop]


def counts(rows: DataFrame, words: Shape) -> DataFrame:
    """pair, docs and best of every pair of ids that some text has linked: how many
    texts have it, and whether no pair of its A id is in more. Tasks count before
    anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        held = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for _, a, b in batches_of(batches):
            pair = align(a, b, words).pair
            held = summed(np.concatenate([held[0], pair]), np.concatenate([held[1], np.ones(len(pair), dtype=np.int64)]))
            if len(held[0]) > FREQUENT:
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["pair", "docs"])
                held = held[0][:0], held[1][:0]
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["pair", "docs"])
    pairs = durable(mapped(rows, run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")))
    token = F.shiftright("pair", words.bits)
    most = pairs.groupBy(token.alias("token")).agg(F.max("docs").alias("most"))  # a row per id of A
    return durable(pairs.join(F.broadcast(most), token == F.col("token")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``pairs`` in two: at most ``most`` of the most frequent ones, and the others
    (None if there are no others). Cut at a step of a scale of counts."""
    level = F.floor(F.log2("docs") * 8)
    steps = pairs.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    total = list(itertools.accumulate(s["count"] for s in steps))
    if not total or total[-1] <= most:
        return pairs, None
    taken = sum(t <= most for t in total)
    least = steps[taken - 1].level if taken else steps[0].level + 1
    return pairs.where(level >= least), pairs.where(level < least)


def _groups(found: Aligned) -> list[bytes]:
    """Per text ``a1,a2|b1;a3|b2,b3``: the ids of its groups. Every token has its
    place in the line: after those of its own list and after the other list's tokens
    of the groups before (for B, of its own group too)."""
    n_a, n_b = len(found.a), len(found.b)
    ends_a, ends_b = np.zeros(n_a, dtype=bool), np.zeros(n_b, dtype=bool)
    ends_a[found.last_a], ends_b[found.last_b] = True, True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    to_b = np.concatenate([[0], found.last_b + 1])
    at_a = np.arange(n_a) + to_b[group_a]
    at_b = np.arange(n_b) + (found.last_a + 1)[group_b]
    number, mark = np.empty(n_a + n_b, dtype=np.int64), np.empty(n_a + n_b, dtype=np.int64)
    number[at_a], number[at_b] = found.a, found.b
    mark[at_a], mark[at_b] = np.where(ends_a, 1, 0), np.where(ends_b, 2, 0)
    used, place = np.unique(number * 3 + mark, return_inverse=True)
    written = [f"{v // 3}{',|;'[v % 3]}".encode() for v in used.tolist()]
    starts = (found.starts_a + found.starts_b).tolist()
    return [b"".join([written[k] for k in place[start:stop].tolist()])[:-1] for start, stop in itertools.pairwise(starts)]


def aligned(docs: DataFrame, first: str, second: str, most: int = FREQUENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256, between the byte-level tokenizer of the file ``first`` (A) and the
    piece tokenizer of ``second`` (B).

    Null and empty texts, and texts that a tokenizer does not give back byte for byte,
    have no tokens: zeros and an empty digest. Repeated rows and null ids count as
    documents of their own; ties for the highest count are all best; columns other
    than doc_id and text are ignored. An empty table gives no rows."""
    with open(first, "rb") as one, open(second, "rb") as two:
        files = one.read(), two.read()
    vocabulary = encoders_of(*files).words
    words = Shape(vocabulary.widths(), vocabulary.bits, vocabulary.kinds())
    unload()
    rows = durable(tokens(docs, *files).withColumn("row", F.monotonically_increasing_id()))
    pairs = counts(rows, words)
    often, rare = frequent(pairs, most)
    table = often.toArrow()
    key = table.column("pair").to_numpy()
    order = np.argsort(key)
    lookup = docs.sparkSession.sparkContext.broadcast((key[order], table.column("docs").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]))
    split = rare is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unload()
        known, docs_of, best_of = lookup.value
        for batch, a, b in batches_of(batches):
            found, size = align(a, b, words), batch.num_rows
            at = np.minimum(np.searchsorted(known, found.pair), max(len(known) - 1, 0))
            hit = known[at] == found.pair if len(known) else np.zeros(len(found.pair), dtype=bool)

            def total(values: np.ndarray) -> np.ndarray:
                out = np.zeros(size, dtype=np.int64)
                np.add.at(out, found.text[hit], values)
                return out
            links = np.zeros(size, dtype=np.int64)
            np.add.at(links, found.text, found.times)
            groups = np.bincount(np.searchsorted(found.starts_a, found.last_a, "right") - 1, minlength=size) if len(found.last_a) else np.zeros(size, dtype=np.int64)
            digests = [hashlib.sha256(g).hexdigest() if g else "" for g in _groups(found)]
            columns = [batch.column(batch.schema.get_field_index("row")), batch.column(batch.schema.get_field_index("doc_id")), pa.array(np.diff(found.starts_a)), pa.array(np.diff(found.starts_b)),
                       pa.array(groups), pa.array(links), pa.array(total(found.times[hit] * best_of[at[hit]])), pa.array(total(found.times[hit] * docs_of[at[hit]])), pa.array(digests, pa.string())]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            if split:
                of, pair, times = found.text[~hit], found.pair[~hit], found.times[~hit]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=size))]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"])))
                names.append("rest")
            yield pa.RecordBatch.from_arrays(columns, names)
    shape = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = mapped(rows, run, shape + ", rest array<struct<pair: long, times: long>>" * split)
    if rare is None:
        return out.drop("row")
    out = durable(out)
    late = (out.select("row", F.inline("rest")).join(rare, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum")))
    added = out.join(late, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    return added.drop("row", "rest", "_best", "_sum")
