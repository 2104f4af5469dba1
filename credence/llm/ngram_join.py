"""Jaccard self-join of documents on their sets of word n-grams, for a threshold
of 0.8, and the components of its links.

Documents with equal sets form a class; the join is between classes.

* **Rare first.** A sketch of fixed size counts n-grams by hash over all documents.
  A set's n-grams are ordered by their count in the sketch, then by hash: one order
  for all sets, so the filters lose nothing, whatever the sketch confuses.
* **Prefix.** Two sets that link share an n-gram among the first
  ``n - ceil(0.8 n) + 1`` of each. Only these go through a shuffle; n-grams that
  just one class has there drop out.
* **Length and positional filters** use the sizes and the places of the shared
  n-gram. **The suffix filter** splits the universe of n-grams into fixed parts by
  hash: wherever two sets' counts in a part differ, they hold different n-grams,
  and the number of these has a bound. The parities of 1,024 counts are sixteen longs;
  folded to four they are compared inside the join, whole on each pair; a second split, by each pair's own quartiles, precedes
  the exact count.
* **Verification** of each remaining pair, once, from the whole sets. These are made
  of the classes in such a pair only, not of all that a list holds.

For components a group of near copies must not be spelled out in pairs. A first
round compares every class of an n-gram's list only with the two ends of the list
(classes are random names).
What is then in one component needs no more comparing; a second round joins what
the lists hold from different components, with all filters.

N-grams are 64-bit hashes (56 bits in the order), classes 64-bit hashes of sets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from credence.llm.common import byte_column, durable, mapped, slices
from credence.llm.components import components

N = 5
SKETCH_BITS, BLOCK = 20, 4096
PARTS, FOLDED = 1024, 4
#: Prefix n-grams of a class before the present one that a candidate is compared on,
#: so as not to be given again.
RECENT = 8
REMEMBERED = 150_000
#: Bytes of text whose words are hashed at once.
STEP = 1 << 18
_SIGNS = [f"s{i}" for i in range(PARTS // 64)]
_WIDTHS = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<i8"}
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


#: 64-bit numbers of the bytes, capitals like their small letters.
_LETTER = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_next_blank = re.compile(rb"[\x20\x09-\x0D]").search


def _powers(base: int) -> np.ndarray:
    """``base`` to the powers 0 .. ``STEP``, modulo 2^64."""
    out = np.full(STEP + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sorted_distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = x[1:] != x[:-1]
    return x if new.all() else x[np.concatenate([[True], new])]


def _mix(h: np.ndarray, size: int, n: int) -> np.ndarray:
    """Hashes of the first ``n`` runs of ``size`` words."""
    g = np.full(n, size, np.uint64)
    for k in range(size):
        x = h[k:k + n]
        g = g * _ODD[1] + (x ^ (x >> np.uint64(29))) * _ODD[k % 5]
    g ^= g >> np.uint64(32)
    g *= _ODD[0]
    return g ^ (g >> np.uint64(29))


class Shingler:
    """Sets of word n-grams of whole texts. A word's hash is the polynomial of its
    bytes' numbers, taken from running sums over many texts at a time."""

    def __init__(self) -> None:
        self.power, self.inverse = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of at most ``STEP`` bytes."""
        codes = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[codes], prepend=True, append=True))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_LETTER[codes] * self.power[:len(codes)], out=sums[1:])
        return starts, (sums[ends] - sums[starts]) * self.inverse[starts]

    def _long_word(self, data: bytes) -> np.ndarray:
        """The hash of one word of any length, block by block."""
        total = 0
        for at in range(0, len(data), STEP):
            codes = np.frombuffer(data, np.uint8, min(STEP, len(data) - at), at)
            total += int((_LETTER[codes] * self.power[:len(codes)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
        return np.array([total % (1 << 64)], np.uint64)

    def _long_text(self, data: bytes) -> np.ndarray:
        """Word hashes of a text longer than ``STEP``, in pieces cut at white space."""
        found, at = [], 0
        while at < len(data):
            stop = min(len(data), at + STEP)
            if stop < len(data):
                cut = 1 + max(data.rfind(bytes([b]), at, stop) for b in np.flatnonzero(_BLANK).tolist())
                if cut <= at:  # a word longer than a piece
                    blank = _next_blank(data, stop)
                    stop = blank.start() if blank else len(data)
                    found.append(self._long_word(data[at:stop]))
                    at = stop
                    continue
                stop = cut
            found.append(self._words(data[at:stop])[1])
            at = stop
        return np.concatenate(found)

    def _sets(self, h: np.ndarray, counts: list[int]) -> list[np.ndarray]:
        """Sets of consecutive texts from their words' hashes, ``counts`` for each."""
        grams, out, at = _mix(h, N, max(0, len(h) - N + 1)), [], 0
        for n in counts:
            if n >= N:
                out.append(_sorted_distinct(grams[at:at + n - N + 1]))
            else:
                out.append(_mix(h[at:at + n], n, 1) if n else np.empty(0, np.uint64))
            at += n
        return out

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Sorted distinct n-gram hashes of each text. With fewer than five words
        the whole sequence is the only n-gram; without words the set is empty."""
        out, i = [], 0
        while i < len(texts):
            group, size = [], 0
            while i < len(texts) and size + len(texts[i] or b"") + 1 <= STEP:
                group.append(texts[i] or b"")
                size += len(group[-1]) + 1
                i += 1
            if group:
                starts, h = self._words(b" ".join(group))
                begin = np.cumsum([0, *(len(t) + 1 for t in group)])
                out += self._sets(h, np.diff(np.searchsorted(starts, begin)).tolist())
            else:
                h = self._long_text(texts[i])
                out += self._sets(h, [len(h)])
                i += 1
        return out


def class_of(grams: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64))


def parities(grams: np.ndarray) -> np.ndarray:
    """1,024 bits: whether a part of the universe holds an odd number of the n-grams."""
    part = (grams >> np.uint64(13)) % np.uint64(PARTS)
    return np.packbits((np.bincount(part.astype(np.int64), minlength=PARTS) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def ordered(grams: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The n-grams as sorted 64-bit keys, rare ones first: eight bits of the
    sketch's rank, then 56 bits of hash."""
    return np.sort(ranks[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | grams >> np.uint64(8))


def ranks_of(sketch: np.ndarray) -> np.ndarray:
    """The sketch's counts on a logarithmic scale of 256 steps."""
    return np.minimum(255, 6 * np.log2(1.0 + sketch)).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    """A block of the sketch in the fewest bytes a count that hold its largest, after that number."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + counts.astype(_WIDTHS[width]).tobytes()


def _added(into: np.ndarray, packed: bytes) -> None:
    into += np.frombuffer(packed, _WIDTHS[packed[0]], offset=1)


def described(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, cls, parities) and, with ``block`` set, the
    task's share of the sketch; ``part`` names a few hundred tasks together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        part = TaskContext.get().partitionId() // 256
        names = ["doc_id", "n", "cls", *_SIGNS, "part", "block", "counts"]
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.int64()] * len(_SIGNS), pa.int32(), pa.int32(), pa.binary()]
        for batch in slices(batches):
            sets = shingler.sets(byte_column(batch, "text"))
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            signs = np.stack([parities(s) for s in sets]) if sets else np.zeros((0, len(_SIGNS)), np.int64)
            columns = [batch.column(batch.schema.get_field_index("doc_id")), [len(s) for s in sets], [class_of(s) for s in sets], *signs.T, *[[None] * len(sets)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        held = [b for b in range(len(counts) // BLOCK) if counts[b * BLOCK:(b + 1) * BLOCK].any()]
        columns = [*[[None] * len(held)] * (3 + len(_SIGNS)), [part] * len(held), held, [_packed(counts[b * BLOCK:(b + 1) * BLOCK]) for b in held]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    shape = "doc_id long, n int, cls long, " + ", ".join(f"{s} long" for s in _SIGNS) + ", part int, block int, counts binary"
    return mapped(docs.select("doc_id", "text"), run, shape)


def sketch_of(rows: DataFrame) -> np.ndarray:
    """The summed sketch: first over some hundred tasks, then over all. Its size is
    fixed (8 MB), which bounds what reaches the driver."""
    def total(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for packed in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                _added(sums, packed)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([_packed(sums)], pa.binary())], ["block", "counts"])
    parts = rows.where("block is not null").select("block", "part", "counts")
    some = parts.groupBy("block", "part").applyInArrow(total, "block int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in some.groupBy("block").applyInArrow(total, "block int, counts binary").toArrow().to_pylist():
        _added(out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK], row["counts"])
    return out


def prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(key, cls, place): the prefix n-grams of every class; ``place`` packs the
    set's size (high half) and the position. A class is given once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, own, done = Shingler(), shared.value, set()
        for batch in slices(batches):
            keys, names, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for grams in shingler.sets(byte_column(batch, "text")):
                name = class_of(grams)
                if not len(grams) or name in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(name)
                n = len(grams)
                size = n - (4 * n + 4) // 5 + 1
                keys.append(ordered(grams, own)[:size])
                names.append(np.full(size, name))
                places.append((n << 32) + np.arange(size))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, names, places)], ["key", "cls", "place"])
    return mapped(docs.select("text"), run, "key long, cls long, place long")


def whole_sets(docs: DataFrame, classes: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(cls, keys): the whole ordered sets of the given classes (cls, rep), each
    from the text of its representative document."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, own = Shingler(), shared.value
        for batch in slices(batches):
            wanted = batch.column(batch.schema.get_field_index("cls")).to_pylist()
            found = [(c, ordered(g, own).tobytes()) for c, g in zip(wanted, shingler.sets(byte_column(batch, "text")), strict=True) if class_of(g) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([k for _, k in found], pa.binary())], ["cls", "keys"])
    wanted = classes.select(F.col("rep").alias("doc_id"), "cls")
    return mapped(docs.select("doc_id", "text").join(wanted, "doc_id").select("cls", "text"), run, "cls long, keys binary")


def overlap(x: np.ndarray, y: np.ndarray, need: int) -> int:
    """Common keys of two ordered sets, or -1 when a split at the quartiles of one
    already shows too many different ones."""
    cuts = x[[len(x) // 4, len(x) // 2, 3 * len(x) // 4]]
    sizes = [np.diff(np.searchsorted(s, cuts), prepend=0, append=len(s)) for s in (x, y)]
    if np.abs(sizes[0] - sizes[1]).sum() > len(x) + len(y) - 2 * need:
        return -1
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def needed(n: int) -> int:
    """Least overlap of two sets with ``n`` members together."""
    return (4 * n + 8) // 9


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, with their overlap, from the whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, ka, kb = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "ka", "kb"))
            out = []
            for i in range(len(a)):
                x, y = np.frombuffer(ka[i], np.uint64), np.frombuffer(kb[i], np.uint64)
                common = overlap(x, y, needed(len(x) + len(y)))
                if common >= 0 and 100 * common >= 80 * (len(x) + len(y) - common):
                    out.append((a[i], b[i], common))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64()))], ["a", "b", "common"])
    one = sets.select(F.col("cls").alias("a"), F.col("keys").alias("ka"))
    two = sets.select(F.col("cls").alias("b"), F.col("keys").alias("kb"))
    return mapped(pairs.select("a", "b").join(one, "a").join(two, "b"), run, "a long, b long, common long")


def _fits(left: str, right: str, signs: list[str]):
    """Length and suffix filters on two rows with n and the parities ``signs``."""
    total = F.col(f"{left}.n") + F.col(f"{right}.n")
    need = F.floor((4 * total + 8) / 9)
    different = reduce(add, [F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in signs])
    length = 5 * F.least(f"{left}.n", f"{right}.n") >= 4 * F.greatest(f"{left}.n", f"{right}.n")
    return length & (different <= total - 2 * need), need


class Join:
    """The written steps of one join: descriptions, classes and lists."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text")
        rows = durable(described(self.docs))
        self.documents = rows.where("block is null").select("doc_id", "n", "cls")
        self.ranks = ranks_of(sketch_of(rows))
        self.classes = durable(rows.where("block is null and n > 0").groupBy("cls").agg(
            F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("members"), *(F.min(s).alias(s) for s in _SIGNS)))
        entries = prefixes(self.docs, self.ranks)
        shared = entries.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high")
        self.lists = durable(entries.join(shared, "key"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The candidates (a, b) of a written table that link, with their overlap. Only
        the classes of a candidate are spelled out as whole sets, which are many times
        larger than all else that the join writes about a class."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        wanted = durable(self.classes.join(named, "cls").where("rep is not null").select("cls", "rep"))
        return verified(pairs, durable(whole_sets(self.docs, wanted, self.ranks)))

    def _with_ends(self) -> DataFrame:
        """Candidates of every class and the first and last class of its lists."""
        ends = self.lists.select("cls", F.explode(F.array("low", "high")).alias("end")).where("cls <> end")
        return self._fitting(ends.select(F.least("end", "cls").alias("a"), F.greatest("end", "cls").alias("b")).distinct())

    def _fitting(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that pass the length filter and the suffix filter of all parities."""
        fits, _ = _fits("x", "y", _SIGNS)
        return (pairs.join(self.classes.alias("x"), F.col("a") == F.col("x.cls")).join(self.classes.alias("y"), F.col("b") == F.col("y.cls"))
                .where(fits).select("a", "b"))

    def pairs(self, roots: DataFrame | None = None) -> DataFrame:
        """Candidates (a < b) that share a prefix n-gram and pass all filters;
        with ``roots`` (node, root) only those from different components."""
        # parities of coarser parts, a quarter as many, are exact as a filter too: parts added up differ in parity only if one of them does
        folded = [reduce(lambda p, q: p.bitwiseXOR(q), map(F.col, _SIGNS[i::FOLDED])).alias(f"f{i}") for i in range(FOLDED)]
        rows = self.lists.select("key", "cls", "place").distinct()
        if roots is None:
            rows = rows.withColumn("root", F.col("cls"))
        else:
            rows = rows.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
            split = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
            rows = rows.join(split, "key", "left_semi")
        rows = durable(rows.join(self.classes.select("cls", *folded), "cls").withColumn("n", F.shiftright("place", 32)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << 32) - 1))))
        # a pair is given at its first shared n-gram: where both hold one of the last few before, it has been
        last = Window.partitionBy("cls").orderBy("at").rowsBetween(-RECENT, -1)
        rows = rows.withColumn("recent", F.collect_list("key").over(last))
        fits, need = _fits("x", "y", [f"f{i}" for i in range(FOLDED)])
        place = 1 + F.least(F.col("x.n") - F.col("x.at") - 1, F.col("y.n") - F.col("y.at") - 1) >= need
        met = (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & fits & place & ~F.arrays_overlap("x.recent", "y.recent")
        return self._fitting(rows.alias("x").join(rows.alias("y"), met).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())

    def roots(self) -> DataFrame:
        """(node, root) of the classes that have a link."""
        first = durable(self._with_ends())
        roots = components(self.linked(first), "a", "b")
        rest = durable(self.pairs(roots).join(first, ["a", "b"], "left_anti"))
        links = self.linked(rest).select("a", "b").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        return components(links, "a", "b")


def linked_classes(docs: DataFrame) -> DataFrame:
    """All links between classes: a_doc, b_doc (the smallest ids of the two
    classes, the smaller first) and common (n-grams in both)."""
    join = Join(docs)
    links = join.linked(durable(join.pairs()))
    ids = join.classes.select("cls", "rep")
    both = links.join(ids.toDF("a", "ra"), "a").join(ids.toDF("b", "rb"), "b")
    return both.select(F.least("ra", "rb").alias("a_doc"), F.greatest("ra", "rb").alias("b_doc"), "common")


def near_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (the
    smallest id reachable by links, its own included) and n_equal (rows with the
    same set, itself included).

    Null, empty and blank texts have no n-grams and are linked with nothing: their
    component is their own id and n_equal is 1. Repeated rows are copies. A null id
    gets the component of its class, which is null only if no row of it has an id,
    and then the class links with nothing. Other columns are ignored."""
    rows = _placed(docs)
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
                       F.when(F.col("n") > 0, F.col("members")).otherwise(F.lit(1)).alias("n_equal"))


def _placed(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n, cls, root (of its class), component and members."""
    join = Join(docs)
    named = durable(join.classes.select("cls", "rep", "members").join(join.roots(), F.col("cls") == F.col("node"), "left").select("cls", "rep", "members", F.coalesce("root", "cls").alias("root")))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(lowest, "root").select("cls", "root", "component", "members")
    return join.documents.join(of_class, "cls", "left")


def with_class(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and the class of every text in a column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches):
            found = [class_of(g) for g in shingler.sets(byte_column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, name])
    return mapped(docs, run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the row of
    the smallest id, once. Where that id has several texts in the component, the
    smallest class stands; texts of one id that don't link stand each for their own.
    Rows without an id can't be told apart and all stay.

    Only texts of ids with more than one class are looked at again."""
    rows = durable(_placed(docs).where("doc_id is not null").select("doc_id", "cls", F.coalesce("root", "cls").alias("root"), ((F.col("n") == 0) | (F.col("component") == F.col("doc_id"))).alias("stands")))
    kept = rows.where("stands").groupBy("root", "doc_id").agg(F.min("cls").alias("cls")).select("doc_id", "cls")
    several = durable(rows.groupBy("doc_id").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("doc_id"))
    one = kept.join(several, "doc_id", "left_anti").select("doc_id")
    named = docs.where("doc_id is not null")
    alone = named.join(one, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    told = with_class(named.join(several, "doc_id", "left_semi").select(*docs.columns), "_cls").join(kept.withColumnRenamed("cls", "_cls"), ["doc_id", "_cls"], "left_semi").dropDuplicates(["doc_id", "_cls"])
    return alone.select(*docs.columns).unionByName(told.select(*docs.columns)).unionByName(docs.where("doc_id is null"))
