"""Best-fit packing by a grouping genetic algorithm on islands, with elite migration.

Pieces of documents are dealt by a hash into blocks of bounded size; each block is evolved by several islands at once.
A genome is a grouping: bins of pieces. Crossover injects the best filled bins of the other parent as wholes, removes
the bins that hold one of their pieces a second time, and best-fits the pieces displaced with them, largest first.
After the first epoch each island's elite, its best grouping, migrates to the next island of its block and takes part
in the second epoch, in which all islands go on; the best of them stands for the block. It keeps its well filled bins;
the pieces of the others meet in wider blocks, where they are evolved again. All that is held in one task is a block,
whose size doesn't grow with the table. An island stops when it has as few bins as the pieces' sum allows.

Nulls: a null text counts as empty, so it has one token, the end mark. A null doc_id is carried along. Repeated rows
are packed each by itself; ties between bins or pieces go by the order of rows. Texts are tokenized whole, however long. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import batches_of, by_slices, written

END = (1).to_bytes(4, "little")
#: Stands between words that are encoded together, a token of one id.
APART = "|"
#: Rows and characters tokenized at a time; distinct words are looked up once in each such slice. As many rows go to Python at a time.
AT_ONCE = (1_000, 2_000_000)
#: Words that a worker holds at most, with 32 characters for each.
CACHED = 500_000
#: Words that neither normaliser nor pattern changes or splits, and characters after which a full stop or comma is a match of its own.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
BEFORE_STOP = [chr(c) for c in range(256) if chr(c).isalnum()]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces in a block, islands that evolve it, and how many blocks meet in a wider one.
BLOCK, ISLANDS, WIDER = 4_000, 3, 24
#: A bin is settled after the first level if at most this many tokens of it are free.
SETTLED_FREE = 4


class Held:
    """The ids of distinct words in Arrow buffers, found by the words' hashes and compared as words, which takes a fraction of a dict's memory. It is emptied when it would hold more than `most` words or 32 characters for each."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def __len__(self) -> int:
        return len(self.hashes)

    def clear(self) -> None:
        self.hashes, self.at, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def resolve(self, lists: list[list[str]], make: Callable[[list[str]], list[bytes]]) -> list[list[bytes]]:
        """The ids of all words of `lists`; `make` gives those of the distinct words not held yet."""
        words = list(dict.fromkeys(itertools.chain(*lists)))
        keys = np.fromiter(map(hash, words), np.int64, len(words))
        known = np.zeros(len(words), np.bool_)
        found: dict[str, bytes] = {}
        if len(self):
            near = np.minimum(np.searchsorted(self.hashes, keys), len(self) - 1)
            at = pa.array(self.at[near])
            known = (self.hashes[near] == keys) & pc.equal(self.words.take(at), pa.array(words, pa.large_string())).to_numpy(zero_copy_only=False)
            found = dict(zip(itertools.compress(words, known.tolist()), self.ids.take(at.filter(pa.array(known))).to_pylist(), strict=True))
        new = list(itertools.compress(words, (~known).tolist()))
        made = make(new)
        found.update(zip(new, made, strict=True))
        self.hold(new, made, keys[~known])
        return [[found[w] for w in x] for x in lists]

    def hold(self, new: list[str], made: list[bytes], keys: np.ndarray) -> None:
        size = sum(map(len, new))
        if len(self) + len(new) > self.most or self.chars + size > 32 * self.most:
            self.clear()
        if len(new) <= self.most and size <= 32 * self.most:
            order = np.argsort(keys)
            there = np.searchsorted(self.hashes, keys[order])
            self.at = np.insert(self.at, there, len(self) + order)
            self.hashes = np.insert(self.hashes, there, keys[order])
            self.words = pa.concat_arrays([self.words, pa.array(new, pa.large_string())])
            self.ids = pa.concat_arrays([self.ids, pa.array(made, pa.large_binary())])
            self.chars += size


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """Once in each Python worker: the tokenizer, a cache of the ids of stretches between blanks without a stop, and the same tokenizer for PLAIN words, which only splits at blanks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    plain = Tokenizer(tok.model)  # one vocabulary in memory
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tok, Held(CACHED), plain


def lowered(text: str) -> str:
    """The tokenizer lower-cases each character by itself; Python does the same to Latin-1 text, and one spelling needs one entry."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as bytes of little-endian 32-bit integers.

    The tokenizer drops white space and neither its normaliser nor its pattern reaches across it, so that the ids of a
    text are those of its stretches between blanks and line breaks; each distinct stretch is looked up once and encoded
    once. A full stop or comma after a letter or digit is a match of its own, so that words are looked up without it.
    """
    tok, cache, plain = tokenizer(path)
    apart, *stops = (tok.encode(x, add_special_tokens=False).ids for x in (APART, "", ".", ","))
    stops = pa.array([np.array(ids, "<u4").tobytes() for ids in stops], pa.large_binary())

    def encoded(tok, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)]

    def in_runs(tok, words: list[str]) -> list[bytes]:
        """Runs of words go in as one text; where a word has the id that keeps them apart itself, each by itself."""
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            runs = [words[k : k + 200] for k in range(at, min(at + 20_000, len(words)), 200)]
            for run, ids in zip(runs, encoded(tok, [f" {APART} ".join(r) for r in runs]), strict=True):
                cut = (4 * np.flatnonzero(ids == apart[0])).tolist()
                if len(cut) == len(run) - 1:
                    raw = ids.tobytes()
                    out += [raw[a:b] for a, b in zip([0, *(c + 4 for c in cut)], [*cut, len(raw)], strict=True)]
                else:
                    out += [i.tobytes() for i in encoded(tok, run)]
        return out

    def whole(words: list[str]) -> list[bytes]:
        is_plain = [PLAIN(w) is not None for w in words]
        kinds = {x: iter(in_runs(t, [w for w, p in zip(words, is_plain, strict=True) if p == x])) for x, t in ((True, plain), (False, tok))}
        return [next(kinds[p]) for p in is_plain]

    split = pc.split_pattern(pa.array([lowered(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
    words = split.flatten().dictionary_encode()
    held = words.dictionary
    after = pc.is_in(pc.utf8_slice_codeunits(held, -2, -1), pa.array(BEFORE_STOP, pa.large_string()))
    stop = pc.case_when(pc.make_struct(pc.and_(after, pc.ends_with(held, ".")), pc.and_(after, pc.ends_with(held, ","))), pa.scalar(1), pa.scalar(2), pa.scalar(0))
    cores = pc.if_else(pc.equal(stop, 0), held, pc.utf8_slice_codeunits(held, 0, -1)).dictionary_encode()
    (ids,) = cache.resolve([cores.dictionary.to_pylist()], whole)
    ids = pc.binary_join_element_wise(pa.array(ids, pa.large_binary()).take(cores.indices), stops.take(stop), pa.scalar(b"", pa.large_binary()))
    all_ids = ids.take(words.indices)
    ends = np.frombuffer(all_ids.buffers()[1], "<i8", len(all_ids) + 1, 8 * all_ids.offset)[np.asarray(split.offsets)].tolist()
    raw = memoryview(all_ids.buffers()[2] or b"")
    return [raw[a:b].tobytes() for a, b in zip(ends, ends[1:])]


def pieces(docs: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes whole texts, adds the end mark and cuts what is longer than `capacity`. Columns: PIECES."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for key, ids in zip(keys, token_ids(texts, path), strict=True):
            ids += END
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(by_slices(work, *AT_ONCE), PIECES)


class Fit:
    """Open bins by free space, for best fit: a bit for each amount of space that some bin has."""

    def __init__(self, capacity: int):
        self.capacity, self.bits, self.by_space = capacity, 0, [[] for _ in range(capacity + 1)]

    def add(self, bin_: list[int], space: int) -> None:
        if not self.by_space[space]:
            self.bits |= 1 << space
        self.by_space[space].append(bin_)

    def place(self, item: int, length: int) -> None:
        """Into the fullest bin that has room, else into a new one."""
        higher = self.bits >> length
        if higher:
            space = length + (higher & -higher).bit_length() - 1
            bin_ = self.by_space[space].pop()
            if not self.by_space[space]:
                self.bits &= ~(1 << space)
        else:
            space, bin_ = self.capacity, []
        bin_.append(item)
        self.add(bin_, space - length)

    def bins(self) -> list[list[int]]:
        return [b for group in self.by_space for b in group]


def refit(kept: list[list[int]], displaced: list[int], size: list[int], capacity: int) -> list[list[int]]:
    fit = Fit(capacity)
    for b in kept:
        fit.add(list(b), capacity - sum([size[i] for i in b]))
    for i in sorted(displaced, key=size.__getitem__, reverse=True):
        fit.place(i, size[i])
    return fit.bins()


def fitness(bins: list[list[int]], size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among as many, fuller ones."""
    return -len(bins), sum([(sum([size[i] for i in b]) / capacity) ** 2 for b in bins])


def cross(a: list[list[int]], b: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Well filled bins of `b` go into `a` as wholes; bins of `a` that hold a piece of theirs dissolve, best fit does the rest."""
    ranked = sorted(b, key=lambda x: -sum([size[i] for i in x]))
    take = ranked[: max(1, len(ranked) // 2)]
    take = [take[k] for k in np.flatnonzero(rng.random(len(take)) < 0.5)] or take[:1]
    there = {i for x in take for i in x}
    keep, displaced = list(take), []
    for x in a:
        if there.isdisjoint(x):
            keep.append(x)
        else:
            displaced += [i for i in x if i not in there]
    return refit(keep, displaced, size, capacity)


def mutate(bins: list[list[int]], size: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Dissolves the emptiest bins and a few others."""
    ranked = sorted(bins, key=lambda x: sum([size[i] for i in x]))
    out = set(range(min(3, len(ranked)))) | set(rng.integers(0, len(ranked), max(2, len(ranked) // 40)).tolist())
    return refit([x for k, x in enumerate(ranked) if k not in out], [i for k in out for i in ranked[k]], size, capacity)


def evolve(size: list[int], capacity: int, seed: int, migrants: list[list[list[int]]], generations: int) -> list[list[int]]:
    """One island's epoch, from the migrants and fresh groupings; returns its elite."""
    rng = np.random.default_rng(seed)
    whole = [[i] for i, n in enumerate(size) if n == capacity]  # these can't share a bin
    rest = [i for i, n in enumerate(size) if n < capacity]
    least = -(-sum([size[i] for i in rest]) // capacity)
    scored = [(fitness(m, size, capacity), m) for m in ([b for b in g if size[b[0]] < capacity] for g in migrants)]
    # a grouping with as few bins as there can be needs no others beside it
    while len(scored) < 3 and not any(len(g) <= least for _, g in scored):
        # after the first grouping, by size, come ones in which a random tenth is placed last
        late = {i for i in rest if rng.random() < 0.1} if scored else set()
        first = refit([], [i for i in rest if i not in late], size, capacity)
        new = refit(first, list(late), size, capacity)
        scored.append((fitness(new, size, capacity), new))
    for _ in range(generations):
        scored.sort(key=lambda x: x[0], reverse=True)
        if len(scored[0][1]) <= least:
            break  # no grouping has fewer bins
        child = cross(scored[0][1], scored[1 + int(rng.integers(len(scored) - 1))][1], size, capacity, rng)
        child = mutate(child, size, capacity, rng) if child else child
        scored[-1] = max(scored[-1], (fitness(child, size, capacity), child), key=lambda x: x[0])
    return max(scored, key=lambda x: x[0])[1] + whole


def groups_of(bins: pd.Series) -> list[list[int]]:
    """Row positions by bin number."""
    order = np.argsort(bins.to_numpy(), kind="stable")
    values = bins.to_numpy()[order]
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(values)) + 1)] if len(order) else []


STATE = f"{PIECES}, block long, island int, bin int, bins int, sequence_id long"


def epoch(level: int, capacity: int, generations: int, last: bool):
    """For applyInPandas: evolves an island (block, island), whose rows may also have a `bin` from it and from a migrant.

    After the last epoch `sequence_id` is -1 where a bin isn't settled.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["migrant"] == 0].sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
        guests = [own]
        if (pdf["migrant"] == 1).any():
            guests.append(pdf[pdf["migrant"] == 1].sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True))
        size = own["length"].tolist()
        block, island = int(own["block"].iloc[0]), int(own["island"].iloc[0])
        migrants = [groups_of(g["bin"]) for g in guests if (g["bin"] >= 0).all()]
        bins = evolve(size, capacity, 1_000_003 * (block % 2**31) + 101 * island + level, migrants, generations)
        number = np.zeros(len(own), np.int64)
        fill = np.zeros(len(bins), np.int64)
        for k, b in enumerate(bins):
            number[b] = k
            fill[k] = sum([size[i] for i in b])
        out = own.assign(bin=number.astype(np.int32), bins=len(bins), sequence_id=-1)
        if last:
            settled = (fill >= capacity - SETTLED_FREE) | (level == 2)
            out["sequence_id"] = np.where(settled[number], (2 * block + level - 1) * 2**20 + number, -1)
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "block", "island", "bin", "bins", "sequence_id"]]

    return run


def evolved(df: DataFrame, level: int, capacity: int, generations: int) -> DataFrame:
    """Two epochs on ISLANDS islands a block; the elite of each island migrates to the next one between them."""
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)).cast("array<int>"))
    start = df.withColumn("island", islands).withColumn("bin", F.lit(-1)).withColumn("migrant", F.lit(0))
    one = start.groupBy("block", "island").applyInPandas(epoch(level, capacity, generations, False), STATE)
    stays = F.struct(F.col("island").alias("island"), F.lit(0).alias("migrant"))
    goes = F.struct(((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.lit(1).alias("migrant"))
    met = one.withColumn("to", F.explode(F.array(stays, goes))).withColumn("island", F.col("to.island")).withColumn("migrant", F.col("to.migrant")).drop("to")
    two = written(met.groupBy("block", "island").applyInPandas(epoch(level, capacity, generations, True), STATE), "islands")
    best = two.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select("block", "best.island")
    return two.join(best, ["block", "island"]).drop("bins")


def pack(items: DataFrame, capacity: int, block: int = BLOCK, generations: int = 6) -> DataFrame:
    """Adds `sequence_id` and `offset` to a table of PIECES none of which is longer than `capacity`."""
    with batches_of(items.sparkSession, AT_ONCE[0]):
        items = written(items, "pieces")
    blocks = max(1, -(-items.count() // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    first = written(evolved(dealt, 1, capacity, generations), "packed")
    # the pieces of bins that aren't settled: a few bins of each block
    rest = first.where("sequence_id < 0").drop("island", "bin", "sequence_id").withColumn("block", F.floor(F.col("block") / WIDER))
    second = evolved(rest, 2, capacity, 3 * generations)
    placed = first.where("sequence_id >= 0").unionByName(second).drop("block", "island", "bin")
    return with_offsets(placed)


def with_offsets(placed: DataFrame) -> DataFrame:
    """A sequence has at most as many pieces as tokens, so the window's groups are bounded."""
    w = Window.partitionBy("sequence_id").orderBy("doc_id", "piece", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)))

