"""How filters interact: what each of them removes, in every order in which they can be applied.

Texts are scanned in the buffers of Arrow batches. Tables of byte classes and prefix sums give the numbers of words,
capitals, code points and symbols of all documents of a block at once; words are hashed by differences of one prefix sum
of weighted bytes, the hashes are sorted within each document, and neighbours with equal hashes are held against each
other byte by byte, so that the numbers of distinct words are exact. Each document comes down to a mask with a bit for
each filter that it fails. Everything else is counted from masks: 32 for a part, whatever the number of documents.

Whether a text is that of a smaller doc_id is settled for the whole table: the least doc_id of each text (by SHA-256) is
found by an aggregation, and documents meet it in a join on digest and doc_id, so that copies are spread by their ids.
Rows are summed up before each join, so that neither a text nor an id that most rows have makes a large task.

Defined results. A null text is an empty one, and a null lang counts with the empty one. A document without an id is
never a later copy, nor makes another one; rows with the same id and text are both the first. Labels are taken by id: one
label row with 1 is enough, and documents without one count as neither. A document without words fails A but not B; an
empty one doesn't fail C. Texts beyond a megabyte are scanned in pieces, whose distinct words are then told apart by
themselves up to 16 bytes and by SHA-256 beyond. An empty table gives an empty table. Columns beside doc_id, text and
lang are not read and can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import discard, written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = b"#$%&*|"

#: Bytes that are scanned at once; arrays of some 60 times that size are held.
BLOCK = 1 << 20

# byte classes: 1 for what belongs to the class
SPACE, CAPITAL, SYMBOL, START = (np.zeros(256, dtype=np.uint8) for _ in range(4))
SPACE[[0x20, *range(0x09, 0x0E)]] = 1
CAPITAL[ord("A") : ord("Z") + 1] = 1
SYMBOL[list(SYMBOLS)] = 1
START[:] = 1
START[0x80:0xC0] = 0  # the bytes of a code point but its first

#: An odd base, so that it has an inverse for the weights, and what stands for each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
OF_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


class Scanner:
    """Counts over blocks of bytes; the powers of the base are made once."""

    def __init__(self):
        self.up, self.down = powers(BASE, BLOCK), powers(INVERSE, BLOCK)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of the documents that `bounds` cuts the bytes into."""
        blank = SPACE[data].astype(bool)
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = blank[:-1], blank[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner], after[inner - 1] = True, True
        return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The index of one word for each distinct word of each owner."""
        if not len(starts):
            return starts
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(OF_BYTE[data] * self.up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.down[starts]
        sizes = ends - starts
        order = np.lexsort((sizes, hashes, owner))
        a, b = order[:-1], order[1:]
        same = (owner[a] == owner[b]) & (hashes[a] == hashes[b]) & (sizes[a] == sizes[b])
        fresh = np.ones(len(order), bool)
        fresh[1:] = ~same
        if self.differ(data, starts[a[same]], starts[b[same]], sizes[a[same]]):
            return self.plainly(data, starts, ends, owner)
        return order[fresh]

    @staticmethod
    def differ(data: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> bool:
        """Whether any pair of words of the same hash isn't the same word."""
        total = int(sizes.sum())
        if not total:
            return False
        within = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return bool((data[np.repeat(one, sizes) + within] != data[np.repeat(two, sizes) + within]).any())

    @staticmethod
    def plainly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The same where hashes collide."""
        held, raw = {}, data.tobytes()
        for i, (a, b, o) in enumerate(zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True)):
            held.setdefault((o, raw[a:b]), i)
        return np.array(list(held.values()), dtype=np.int64)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """For each document: words, distinct words, capitals, code points, symbols."""
        n = len(bounds) - 1
        starts, ends = self.words(data, bounds)
        owner = np.searchsorted(bounds, starts, side="right") - 1
        out = np.zeros((n, 5), dtype=np.int64)
        out[:, 0] = np.bincount(owner, minlength=n)
        out[:, 1] = np.bincount(owner[self.distinct(data, starts, ends, owner)], minlength=n)
        for column, kind in ((2, CAPITAL), (3, START), (4, SYMBOL)):
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kind[data], out=sums[1:])
            out[:, column] = sums[bounds[1:]] - sums[bounds[:-1]]
        return out

    def long_counts(self, data: np.ndarray) -> np.ndarray:
        """The same for one long document, in pieces that end with white space; distinct words are kept as digests, each 16 bytes."""
        out, seen, at = np.zeros(5, dtype=np.int64), set(), 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            if end < len(data):
                blanks = np.flatnonzero(SPACE[data[at:end]])
                end = at + int(blanks[-1]) + 1 if len(blanks) else self.word_end(data, end)
            if end - at > BLOCK:  # one word without end
                out += [1, 0, *self.classes(data, at, end)]
                seen.add(hashlib.sha256(data[at:end]).digest()[:16])
            else:
                piece = data[at:end]
                starts, ends = self.words(piece, np.array([0, len(piece)]))
                out += [len(starts), 0, *self.classes(data, at, end)]
                for i in self.distinct(piece, starts, ends, np.zeros(len(starts), np.int64)).tolist():
                    word = piece[starts[i] : ends[i]]
                    seen.add(hashlib.sha256(word).digest()[:16] if len(word) > 16 else word.tobytes().ljust(17, b" "))
            at = end
        out[1] = len(seen)
        return out

    @staticmethod
    def word_end(data: np.ndarray, at: int) -> int:
        """The end of the word that goes on at `at`."""
        while at < len(data):
            blanks = np.flatnonzero(SPACE[data[at : at + BLOCK]])
            if len(blanks):
                return at + int(blanks[0])
            at += BLOCK
        return len(data)

    @staticmethod
    def classes(data: np.ndarray, at: int, end: int) -> list[int]:
        found = [0, 0, 0]
        for start in range(at, end, BLOCK):
            piece = data[start : min(start + BLOCK, end)]
            found = [x + int(kind[piece].sum(dtype=np.int64)) for x, kind in zip(found, (CAPITAL, START, SYMBOL), strict=True)]
        return found


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of an array of texts; null has no bytes."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    return np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8), offsets


def runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most BLOCK bytes; a longer one has a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > BLOCK:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def counted(scanner: Scanner, texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """The counts of each text, and its digest."""
    if not len(texts):
        return np.zeros((0, 5), np.int64), []
    data, offsets = buffers(texts)
    parts = []
    for a, b in runs(np.diff(offsets)):
        piece, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        parts.append(scanner.long_counts(piece)[None] if len(piece) > BLOCK else scanner.counts(piece, bounds))
    return np.concatenate(parts), [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def failures(counts: np.ndarray) -> np.ndarray:
    """The bits of the filters that look at one document."""
    words, distinct, capitals, points, symbols = counts.T
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of the filters that need one document only), digest, and the counts that they rest on."""
    names = ["n_words", "n_distinct", "n_capitals", "n_points", "n_symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts, digests = counted(scanner, batch.column(2))
            columns = [batch.column(0), batch.column(1), pa.array(failures(counts), pa.int32()), pa.array(digests, pa.binary()), *(pa.array(c) for c in counts.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "digest", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, part string, mask int, digest binary, {', '.join(f'{n} long' for n in names)}")


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of all filters, and the numbers of documents, of good ones and of toxic ones; at most 32 rows a part."""
    found = written(scanned(docs).select("doc_id", "part", "mask", "digest"), "scanned_texts")
    rows = found.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = found.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    whole = rows.join(first, ["digest", "doc_id"], "left").groupBy("doc_id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = whole.join(marks, "doc_id", "left")
    sums = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]]
    out = written(joined.groupBy("part", "mask").agg(*sums), "filter_masks")
    discard(found)
    return out


def steps(spark: SparkSession) -> DataFrame:
    """What becomes of a document with each mask at each step of each order: a fixed table of 32 * 120 * 5 rows."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                # of all orders, a filter removes it in those where it comes first of the ones it fails
                share = 120 // mask.bit_count() if fails else 0
                rows.append((mask, name, step, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit), share))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays int, leaves int, missed int, alone int, share int")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, and the counts of that step, for every part, order and step.

    kept: after this step; removed: here; redundant: failing this filter but removed before; unique_fails: failing this
    filter only; good_lost and toxic_lost: of those removed here; shapley: what the filter removes, over all orders.
    """
    rows = masked(docs, labels).join(F.broadcast(steps(docs.sparkSession)), "mask")
    counts = {"kept": ("n", "stays"), "removed": ("n", "leaves"), "redundant": ("n", "missed"), "unique_fails": ("n", "alone"), "good_lost": ("good", "leaves"), "toxic_lost": ("toxic", "leaves"), "shapley": ("n", "share")}
    return rows.groupBy("part", "filter_order", "step").agg(*[F.sum(F.col(a) * F.col(b)).alias(name) for name, (a, b) in counts.items()])
