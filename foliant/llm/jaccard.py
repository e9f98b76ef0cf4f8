"""Exact Jaccard self-join on word n-grams, for connected groups, by skipping on set relations.

Equal sets are one class. A first pass counts all shingles of all documents in a table of fixed size, which gives the
global order of tokens: rare ones first. The index has a class's first tokens, so many that any two classes that link
have at least `shared` of them in common. An index list is sorted by set size. In short lists sets meet pair by pair,
skipping by size and by position (what comes after a shared token bounds the overlap); a pair is a candidate if it met
often enough. Of the tokens that have to be in common only those of long lists can be missing from that count, so only
classes with that many such tokens, which are those of large groups of copies, need the long lists, and in these they
are candidates with their neighbours. Candidates form groups, and a group's answers are derived from each other: a set is
held as its difference from what most of the group has, and overlaps with all sets not yet reached follow from the
overlaps of the differences. No pair is emitted that isn't a step of the search, so a group of thousands costs a forest.
Large groups are split into blocks that share some members; after that only sets outside a group's main component meet
the other blocks, and of these only such as have enough of their indexed tokens, early enough for a link. They meet a
block in parts, so that no task holds more than about two blocks at once, however large a group is.

Two classes that share a 64-bit digest of their sets would be taken for one. Nulls: a null or blank text has no set and
links with nothing; a null doc_id is carried along and never names a component, unless all of its members have none.
Repeated rows are of one class. Texts are taken whole, however long. An empty table gives no rows; `joined` neither reads
nor returns other columns, `representatives` keeps all of them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import batches_of, by_slices, discard, fresh, slices, small, written
from foliant.llm.components import components

#: Counting buckets, 2 to this power, and the parts that a task's counts are sent in.
BUCKETS, PARTS = 20, 16
#: Lists up to SHORT are joined pair by pair. A block has at most about BLOCK sets, with SHARED that all blocks of its group have.
SHORT, BLOCK, SHARED = 8, 800, 100
#: Sets that link share so many of their indexed tokens, and one more for each hundred tokens that they have.
MEET = 3
#: Rows and characters hashed at a time; letters take some ten times their size meanwhile. As many rows go to Python at a time.
AT_ONCE = (1_000, 500_000)
#: Sets that a task searches, and as many doc_ids are broadcast at most, a long each.
BATCH = 500

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), ODD), dtype=np.uint64)])[:n]


def shingles(texts: list[str], words: int = 3) -> list[np.ndarray]:
    """Of each text the hashes of its n-grams, with repeats; a text with fewer words is one n-gram, one without has none."""
    raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    ends = np.cumsum([len(r) + 1 for r in raw])
    white = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]])))
    begins, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(begins):
        return [np.zeros(0, np.uint64)] * len(texts)
    letters = data[~white].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    word = mix(np.add.reduceat(letters * powers(int(sizes.max()))[place], first) ^ mix(sizes.astype(np.uint64)))
    bounds = np.searchsorted(begins, np.concatenate([[0], ends]))
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        rolled = mix(rolled * ODD + word[k : k + len(rolled)] + np.uint64(k))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(rolled[a : b - words + 1])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = mix(h * ODD + word[k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS)).astype(np.int64)


def levels(docs: DataFrame, words: int) -> np.ndarray:
    """How frequent the shingles of each bucket are over all documents, in steps; 2**BUCKETS bytes whatever the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**BUCKETS, np.uint32)

        def add(_, texts: list[str]) -> None:
            for h in shingles(texts, words):
                np.add.at(total, bucket(distinct(h)), 1)

        for _ in by_slices(add, *AT_ONCE)(batches):
            pass
        parts = [p.tobytes() for p in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2**BUCKETS // PARTS, np.int64)
        for c in pdf["counts"]:
            total += np.frombuffer(c, np.uint32)
        step = np.floor(6 * np.log2(total + 1.0)).clip(0, 255).astype(np.uint8)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "steps": [step.tobytes()]})

    rows = docs.select("doc_id", "text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add_up, "part int, steps binary").collect()
    out = np.zeros((PARTS, 2**BUCKETS // PARTS), np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["steps"], np.uint8)
    return out.ravel()


def ordered(h: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A set's tokens in the global order: the step of the bucket, then the hash."""
    h = distinct(h)
    return np.sort(steps[bucket(h)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8))


def key_of(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set, -1 for the empty one."""
    if not len(tokens):
        return -1
    h = mix(tokens)
    sums = h.sum(dtype=np.uint64, keepdims=True) ^ (mix(h ^ ODD).sum(dtype=np.uint64, keepdims=True) * ODD + np.uint64(len(tokens)))
    return int(mix(sums)[0] >> np.uint64(1))


def shared(n, percent: int):
    """How many of their indexed tokens two sets have in common that link, of which the smaller one has `n`; an array or a number."""
    return np.minimum(MEET + n // 100, -(-percent * n // 100))


def least_shared(percent: int) -> str:
    """SQL: the same for the smallest set that a set of `n` may link with."""
    return f"least({MEET} + ceil({percent} * n / 100) div 100, ceil({percent} * ceil({percent} * n / 100) / 100))"


def sets(docs: DataFrame, steps, words: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, k (the class) and `tokens`: the whole set as bytes, or the part of it that is indexed as an array."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        found = [ordered(h, steps.value) for h in shingles(texts, words)]
        if whole:
            tokens = pa.array([t.tobytes() for t in found], pa.binary())
        else:
            parts = [t[: len(t) - -(-percent * len(t) // 100) + int(shared(len(t), percent))] for t in found]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(t) for t in found], pa.int64()), pa.array([key_of(t) for t in found], pa.int64()), tokens], names=["doc_id", "n", "k", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(by_slices(work, *AT_ONCE), f"doc_id long, n long, k long, tokens {'binary' if whole else 'array<long>'}")


def linked(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (sizes - overlap)


def lists(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over a partition of (token, n, k, pos) sorted by these: from short lists pairs (u, v), how many tokens they would have to share, and in how many lists they met; from long ones (k, token, -1, n)."""

    def pairs(token: np.ndarray, n: np.ndarray, k: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(token)]]))
        length = np.repeat(sizes, sizes)
        found = []
        for step in range(1, SHORT):
            i = np.flatnonzero((token[step:] == token[:-step]) & (length[step:] <= SHORT))
            j = i + step
            need = shared(n[i], percent)
            # the smaller set comes first; this token, those after it and need - 1 before it bound the overlap
            most = np.minimum(n[i] - pos[i], n[j] - pos[j]) + need - 1
            keep = (100 * n[i] >= percent * n[j]) & (most * (100 + percent) >= percent * (n[i] + n[j]))
            found.append((k[i[keep]], k[j[keep]], need[keep]))
        u, v, need = (np.concatenate(x) for x in zip(*found, strict=True))
        rows, met = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), need], 1)[u != v], axis=0, return_counts=True)
        i = np.flatnonzero(length > SHORT)
        long = [k[i], token[i], np.full(len(i), -1), n[i]]
        columns = [np.concatenate([a, b]) for a, b in zip([*rows.T, met], long, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["u", "v", "need", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in range(4)]
            if left is not None:
                now = [np.concatenate([a, b]) for a, b in zip(left, now, strict=True)]
            if not len(now[0]):
                continue
            end = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on
            if end:
                yield pairs(*[a[:end] for a in now])
            left = [a[end:] for a in now]
        if left is not None:
            yield pairs(*left)

    return run


def neighbours(entries: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v) from lists (token, n, k): each set with the next one by size; a gap in sizes ends a group."""
    along = Window.partitionBy("token").orderBy("n", "k")
    rows = entries.select("k", "n", F.lag("k").over(along).alias("before"), F.lag("n").over(along).alias("less"))
    return rows.where(f"before IS NOT NULL AND 100 * less >= {percent} * n").select(F.least("k", "before").alias("u"), F.greatest("k", "before").alias("v")).distinct()


def candidates(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v), to be looked at in groups, from what `lists` found."""
    long = met.where("need = -1").select(F.col("u").alias("k"), F.col("v").alias("token"), F.col("met").alias("n"))
    # how many of a class's indexed tokens are in long lists, so that pairs of its may have met so much less often
    missed = written(long.groupBy("k").agg(F.count("*").alias("missed"), F.min("n").alias("n")), "missed")
    pairs = met.where("need >= 0").groupBy("u", "v", "need").agg(F.sum("met").alias("met"))
    for side in ("u", "v"):
        pairs = pairs.join(missed.select(F.col("k").alias(side), F.col("missed").alias(f"missed_{side}")), side, "left")
    pairs = pairs.where("met >= need - least(coalesce(missed_u, 0), coalesce(missed_v, 0))").select("u", "v")
    heavy = missed.where(f"missed >= {least_shared(percent)}").select("k")
    return pairs.unionByName(neighbours(long.join(heavy, "k", "left_semi"), percent)).distinct()


class Group:
    """Sets of which most tokens are common, each as its difference from the common ones."""

    def __init__(self, tokens: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in tokens])
        m = len(tokens)
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(m), self.sizes)
        names, index, counts = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.flatnonzero(counts * 2 > m)
        self.n_common = len(common)
        is_common = np.zeros(len(names), bool)
        is_common[common] = True
        # what a set lacks of the common tokens: the complement, by token
        has = is_common[index]
        self.has_common = np.bincount(owner[has], minlength=m)
        rank = np.full(len(names), -1)
        rank[common] = np.arange(len(common))
        seen = np.ones((0, 0), bool)
        lacking_owner, lacking_token = [], []
        for at in range(0, m, 512):
            rows = (owner >= at) & (owner < at + 512) & has
            seen = np.zeros((min(512, m - at), max(1, len(common))), bool)
            seen[owner[rows] - at, rank[index[rows]]] = True
            a, b = np.nonzero(~seen[:, : len(common)])
            lacking_owner.append(a + at)
            lacking_token.append(b)
        rare = ~has & (counts[index] > 1)
        owners = np.concatenate([*lacking_owner, owner[rare]])
        items = np.concatenate([*lacking_token, index[rare] + len(common)])
        by_item = np.argsort(items, kind="stable")
        self.members, sorted_items = owners[by_item], items[by_item]
        edges = np.flatnonzero(np.concatenate([[True], sorted_items[1:] != sorted_items[:-1]])) if len(items) else np.zeros(0, np.int64)
        self.starts, self.stops = edges, np.concatenate([edges[1:], [len(items)]]).astype(np.int64) if len(items) else edges
        slot = np.zeros(len(items), np.int64)
        slot[by_item] = np.repeat(np.arange(len(edges)), self.stops - self.starts) if len(items) else 0
        by_owner = np.argsort(owners, kind="stable")
        self.slots = np.split(slot[by_owner], np.cumsum(np.bincount(owners, minlength=m))[:-1])

    def overlaps(self, i: int) -> np.ndarray:
        """With every set: common tokens that neither lacks, and what the differences share."""
        parts = [self.members[self.starts[s] : self.stops[s]] for s in self.slots[i].tolist()]
        shared = np.bincount(np.concatenate(parts), minlength=len(self.sizes)) if parts else np.zeros(len(self.sizes), np.int64)
        return self.has_common[i] + self.has_common - self.n_common + shared

    def forest(self, percent: int, label: np.ndarray | None = None, guest: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Edges that connect what links connect. With labels, sets of one label are connected already, and only pairs with a guest are of interest."""
        m = len(self.sizes)
        if label is None:
            waiting = np.ones(m, bool)
            for start in range(m):
                if not waiting[start]:
                    continue
                waiting[start] = False
                queue = [start]
                while queue and waiting.any():
                    i = queue.pop()
                    near = np.flatnonzero(waiting & linked(self.overlaps(i), self.sizes[i] + self.sizes, percent))
                    waiting[near] = False
                    queue += near.tolist()
                    for j in near.tolist():
                        yield i, j
        else:
            for i in np.flatnonzero(guest).tolist():
                near = np.flatnonzero((label != label[i]) & linked(self.overlaps(i), self.sizes[i] + self.sizes, percent))
                for lab in np.unique(label[near]).tolist():
                    yield i, int(near[label[near] == lab][0])


def search(percent: int, labelled: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas over the sets of some blocks (group, block, k, tokens[, part, label, guest]), block by block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[int, int]] = []
        for _, part in pdf.groupby(["group", "block", "part"] if labelled else ["group", "block"], sort=False):
            part = part.sort_values("guest", ascending=False).drop_duplicates("k") if labelled else part.drop_duplicates("k")
            k = part["k"].to_numpy()
            group = Group([np.frombuffer(t, np.uint64) for t in part["tokens"]])
            found = group.forest(percent, part["label"].to_numpy(), part["guest"].to_numpy()) if labelled else group.forest(percent)
            edges += [(int(k[a]), int(k[b])) for a, b in found]
        return pd.DataFrame(edges, columns=["u", "v"]).astype("int64")

    return run


def searched(rows: DataFrame, percent: int, labelled: bool, batches: int) -> DataFrame:
    """Small blocks share a batch; what a task holds is some thousand sets and at most some blocks beyond them."""
    keys = ("group", "block", "part") if labelled else ("group", "block")
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64(*keys), F.lit(batches)))
    return dealt.groupBy("batch").applyInPandas(search(percent, labelled), "u long, v long")


def visits(label: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(group, block, k), written, for each guest and each block that has as many of its indexed tokens as a link would share.

    Of the tokens that two sets that link have in common, the first ones come early in both: what follows them has to
    make up the overlap that the two sizes ask for. So a token counts for a guest and a block only if it is early enough
    in the guest for the smallest set of the block that has it, and early enough in one of these for the guest. What is
    too late even for the smallest set of the group that has the token isn't joined at all. A guest's own block has been
    searched.

    `label` has group, block, k and guest; `classes` has k, n and the indexed `tokens`.
    """
    # a token at pos counts beside a set of m tokens if (100 + percent) * (n - pos + need - 1) >= percent * (n + m)
    need = f"least({MEET} + n div 100, ceil({percent} * n / 100))"
    room = f"floor(((100 + {percent}) * (n - pos + {need} - 1) - {percent} * n) / {percent})"
    entries = classes.join(small(label, 4), "k").select("group", "block", "k", "guest", "n", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.withColumn("room", F.expr(f"cast({room} AS bigint)")).drop("pos").where(f"100 * room >= {percent} * n")
    least = entries.groupBy("group", "token").agg(F.min("n").alias("least"), F.max("guest").alias("wanted")).where("wanted").drop("wanted")
    early = written(entries.join(least, ["group", "token"]).where("room >= least").drop("least"), "early")
    held = early.groupBy("group", "token", "block").agg(F.min("n").alias("least"), F.max("room").alias("most"))
    guests = early.where("guest").select("group", "token", "k", "n", "room", F.col("block").alias("own"))
    met = guests.join(held, ["group", "token"]).where("block <> own AND room >= least AND most >= n")
    found = written(met.groupBy("group", "block", "k", "n").agg(F.count("*").alias("met")).where(f"met >= {least_shared(percent)}").select("group", "block", "k"), "visits")
    discard(early)
    return found


def group_links(candidates: DataFrame, bodies: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect the sets as all their links would."""
    groups = written(components(candidates), "groups").withColumnsRenamed({"node": "k", "root": "group"})
    batches = max(1, groups.count() // BATCH)
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = groups.join(sizes, "group").withColumn("blocks", blocks)
    with batches_of(bodies.sparkSession, AT_ONCE[0]):
        held = written(bodies.join(small(members, 4), "k").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")), "members")
    # the same members go to all blocks of a group, so that the blocks' components meet in them
    share = F.pmod(F.xxhash64(F.col("k") + 1), F.col("members")) < SHARED
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = held.where("blocks = 1 OR NOT " + f"(pmod(xxhash64(k + 1), members) < {SHARED})").select("group", "block", "k", "tokens")
    spread = spread.unionByName(held.where("blocks > 1").where(share).select("group", every.alias("block"), "k", "tokens"))
    first = written(searched(spread, percent, False, batches), "links")
    if held.where("blocks > 1").limit(1).count() == 0:
        return first
    roots = components(first)
    label = held.where("blocks > 1").join(roots, held["k"] == roots["node"], "left").select("group", "block", "blocks", "k", "tokens", F.coalesce("root", "k").alias("label"))
    label = written(label, "labelled")
    # per group the label of most members; all others are guests
    count = label.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = count.groupBy("group").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels")).where("labels > 1")
    open_ = label.join(main, "group").withColumn("guest", F.col("label") != F.col("main"))
    calls = visits(open_.select("group", "block", "k", "guest").distinct(), classes, percent)
    # a block's guests come in parts of about BLOCK, and its own sets are there in each of these
    parts = calls.groupBy("group", "block").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    guests = calls.join(parts, ["group", "block"]).withColumn("part", F.pmod(F.xxhash64(F.col("k") + 2), F.col("parts")).cast("int"))
    guests = guests.join(open_.where("guest").select("group", "k", "tokens", "label"), ["group", "k"]).select("group", "block", "part", "k", "tokens", "label", F.lit(True).alias("guest"))
    hosts = open_.join(parts, ["group", "block"]).select("group", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "k", "tokens", "label", F.lit(False).alias("guest"))
    rows = written(guests.unionByName(hosts), "met")
    return first.unionByName(written(searched(rows, percent, True, max(1, rows.count() // BATCH)), "links"))


def classified(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame, object]:
    """Each document's (doc_id, n, k), each class's (k, rep, root, component_id), and the token order."""
    docs = docs.select("doc_id", "text")
    with batches_of(docs.sparkSession, AT_ONCE[0]):
        steps = docs.sparkSession.sparkContext.broadcast(levels(docs, words))
        indexed = written(sets(docs, steps, words, percent, False), "sets")
    classes = written(indexed.where("k >= 0").groupBy("k").agg(F.min("n").alias("n"), F.first("tokens").alias("tokens")), "classes")
    entries = classes.select("k", "n", F.posexplode("tokens").alias("pos", "token"))
    entries = entries.select("token", "n", "k", F.col("pos").cast("long").alias("pos"))
    entries = entries.repartition("token").sortWithinPartitions("token", "n", "k")
    met = written(entries.mapInArrow(lists(percent), "u long, v long, need long, met long"), "met")
    found = written(candidates(met, classes, percent), "pairs")
    discard(met)
    wanted = found.select(F.explode(F.array("u", "v")).alias("k")).distinct()
    named = indexed.where("k >= 0").groupBy("k").agg(F.min("doc_id").alias("rep"))
    reps = written(named.join(wanted, "k", "left_semi").select("rep").distinct(), "reps")
    reps = small(reps)
    bodies = docs.join(reps, docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi")
    bodies = sets(bodies, steps, words, percent, True).select("k", "tokens")
    roots = written(components(group_links(found, bodies, classes, percent)), "roots")
    named = written(named.join(roots, named["k"] == roots["node"], "left").select("k", "rep", F.coalesce("root", "k").alias("root")), "named")
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return indexed.select("doc_id", "n", "k"), named.join(names, "root").select("k", "rep", "root", "component_id"), steps


def joined(docs: DataFrame, percent: int = 90, words: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, for links of at least `percent` Jaccard similarity."""
    indexed, classes, _ = classified(docs, percent, words)
    rows = indexed.join(classes.select("k", "component_id"), "k", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("k") < 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The rows of `docs`, with all their columns, of which one stays for each connected group: one with the least doc_id.

    Rows without a set all stay. A group of which no row has a doc_id keeps one, too.
    """
    indexed, classes, steps = classified(docs, percent, words)
    rows = written(indexed.join(classes.select("k", "component_id"), "k", "left"), "components")
    own_id, own_k = fresh(docs.columns, "own_id", "own_k")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 OR doc_id IS NULL").select(F.col("doc_id").alias(own_id))
    plain = rows.where("k < 0 OR doc_id = component_id").select(F.col("doc_id").alias(own_id)).join(repeated, own_id, "left_anti").where(F.col(own_id).isNotNull())
    kept = docs.join(plain, docs["doc_id"] == plain[own_id], "left_semi")
    # where doc_id doesn't tell rows apart, their classes do
    names, schema = docs.columns, docs.withColumn(own_k, F.lit(0).cast("long")).schema

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [x or "" for x in part.column(names.index("text")).to_pylist()]
                keys = [key_of(ordered(h, steps.value)) for a, b in slices(texts) for h in shingles(texts[a:b], words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.int64())], schema=pa.schema([*part.schema, pa.field(own_k, pa.int64())]))

    odd = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated[own_id]), "left_semi").mapInArrow(keyed, schema)
    least = classes.where("rep <=> component_id").groupBy("root", "component_id").agg(F.min("k").alias("least")).drop("root")
    one = odd.join(least, (odd[own_k] == least["least"]) & odd["doc_id"].eqNullSafe(least["component_id"]), "left_semi").dropDuplicates([own_k])
    return kept.unionByName(one.select(names)).unionByName(odd.where(F.col(own_k) < 0).select(names))
