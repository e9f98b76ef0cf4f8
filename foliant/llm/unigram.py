"""Token counts under a unigram model, by dynamic programming over a trie.

The pieces are those of a public vocabulary of ranks; a piece's score follows Zipf's law, -ln(rank + 3). A pre-token's
count is the number of pieces in its best-scoring segmentation; among equal scores the one with the longest last piece
counts. The distinct pre-tokens of a run of documents go into a trie level by level: sorted, words that share a prefix
are neighbours, and the forward score of a prefix is computed once for all of them from the scores of the shorter
prefixes on its path. What a terminal node comes to is the word's count. A document's count adds up its words' counts.

Nulls: a null text counts as empty and has no tokens. Repeated rows get equal counts; an empty table gives no rows;
columns other than the two named ones are neither read nor returned.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm.common import Cache, by_slices

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
NO = np.float32(-np.inf)
#: Words longer than this are segmented one by one, along their own length, instead of in the shared trie.
LONG = 256


def mixed(h: np.ndarray, length: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)) ^ np.uint64(length)


class Pieces:
    """Scores of byte strings, looked up by length and a polynomial hash."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.scores = {p: np.float32(-np.log(r + 3.0)) for p, r in ranks.items()}
        by_length: dict[int, list[bytes]] = {}
        for p in self.scores:
            by_length.setdefault(len(p), []).append(p)
        self.lengths = sorted(by_length)
        self.tables = {n: self._table(ps, n) for n, ps in by_length.items()}

    def _table(self, pieces: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
        """Open addressing at a load of an eighth at most."""
        grid = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, n)
        h = np.zeros(len(grid), np.uint64)
        for k in range(n):
            h = h * BASE + grid[:, k].astype(np.uint64) + np.uint64(1)
        h = mixed(h, n)
        bits = max(4, (len(h) * 8).bit_length())
        keys, values = np.zeros(2**bits, np.uint64), np.full(2**bits, NO, np.float32)
        slot, todo = (h >> np.uint64(64 - bits)).astype(np.int64), np.arange(len(h))
        scores = np.array([self.scores[p] for p in pieces], np.float32)
        while len(todo):
            free = keys[slot[todo]] == 0
            keys[slot[todo[free]]] = h[todo[free]]
            settled = keys[slot[todo]] == h[todo]
            values[slot[todo[settled]]] = scores[todo[settled]]
            todo = todo[~settled]
            slot[todo] = (slot[todo] + 1) % 2**bits
        return keys, values, np.uint64(64 - bits)

    def find(self, h: np.ndarray, n: int) -> np.ndarray:
        keys, values, shift = self.tables[n]
        h = mixed(h, n)
        slot = (h >> shift).astype(np.int64)
        held = keys[slot]
        out = np.where(held == h, values[slot], NO)
        probing = np.flatnonzero((held != h) & (held != 0))
        while len(probing):
            slot[probing] = (slot[probing] + 1) % len(keys)
            held = keys[slot[probing]]
            hit = held == h[probing]
            out[probing[hit]] = values[slot[probing[hit]]]
            probing = probing[~hit & (held != 0)]
        return out

    def count(self, words: list[bytes]) -> list[int]:
        """Token counts of the words; an empty word has none."""
        out = [0] * len(words)
        short = sorted((w, i) for i, w in enumerate(words) if 0 < len(w) <= LONG)
        for at in range(0, len(short), 200_000):
            part = short[at : at + 200_000]
            for (_, i), n in zip(part, self._trie([w for w, _ in part]).tolist(), strict=True):
                out[i] = n
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._along(w)
        return out

    def _trie(self, words: list[bytes]) -> np.ndarray:
        """`words` are sorted. At each level a node is the first word of those that share the prefix."""
        size = np.array([len(w) for w in words])
        width = int(size.max())
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(size) - size
        # how much of its prefix a word shares with its predecessor
        shared = np.zeros(len(words), np.int64)
        live = np.arange(1, len(words))
        for d in range(width):
            live = live[(size[live] > d) & (size[live - 1] > d)]
            live = live[flat[starts[live] + d] == flat[starts[live - 1] + d]]
            shared[live] += 1
            if not len(live):
                break
        power, counts = [np.uint64(1)], np.zeros(len(words), np.int64)
        # of each word the node on its path at the present level, and of each level the nodes' hashes, scores and counts
        member = np.arange(len(words))
        paths: list[np.ndarray] = []  # node of every member at each level, by word
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(1, np.uint64), np.zeros(1, np.float32), np.zeros(1, np.int64))]
        paths.append(np.zeros(len(words), np.int32))
        for d in range(1, width + 1):
            power.append(np.uint64(int(power[-1]) * int(BASE) % 2**64))
            member = member[size[member] >= d]
            fresh = shared[member] < d  # not so where the predecessor has this prefix, too
            firsts = member[fresh]
            node = np.full(len(words), -1, np.int32)
            node[member] = np.cumsum(fresh) - 1
            h = levels[d - 1][0][paths[d - 1][firsts]] * BASE + flat[starts[firsts] + d - 1].astype(np.uint64) + np.uint64(1)
            best, many = np.full(len(firsts), NO, np.float32), np.zeros(len(firsts), np.int64)
            for n in reversed(self.lengths):
                if n > d:
                    continue
                above = paths[d - n][firsts]
                score = self.find(h - levels[d - n][0][above] * power[n], n) + levels[d - n][1][above]
                better = score > best
                best[better] = score[better]
                many[better] = levels[d - n][2][above[better]] + 1
            levels.append((h, best, many))
            paths.append(node)
            terminal = member[size[member] == d]
            counts[terminal] = many[node[terminal]]
        return counts

    def _along(self, word: bytes) -> int:
        best, many = np.full(len(word) + 1, NO, np.float32), np.zeros(len(word) + 1, np.int64)
        best[0] = 0
        for d in range(1, len(word) + 1):
            for n in reversed(self.lengths):
                if n <= d and (s := self.scores.get(word[d - n : d])) is not None and best[d - n] + s > best[d]:
                    best[d], many[d] = best[d - n] + s, many[d - n] + 1
        return int(many[-1])


@functools.lru_cache(maxsize=2)
def model(path: str, pattern: str) -> tuple[Pieces, regex.Pattern, Cache, Cache]:
    """Once in each Python worker, with caches of the counts of stretches between blanks and of pre-tokens."""
    return Pieces(path), regex.compile(pattern), Cache(400_000), Cache(250_000)


#: White space other than single spaces and line breaks.
ODD = re.compile(r"\s\s|[^\S \n]")


def counts_of(texts: list[str], path: str, pattern: str) -> list[tuple[int, int]]:
    """Of each text its tokens and its pre-tokens. A pre-token takes the blank before it, if it is a space."""
    pieces, cut, cache, tokens = model(path, pattern)
    lists = []
    for t in texts:
        # where white space is single spaces and line breaks, no match reaches across a break or into the word before a space
        if ODD.search(t):
            lists.append((cut.findall(t), 0))
        else:
            lists.append(([w for line in t.split("\n") for w in _stretches(line)], t.count("\n")))

    def of_words(words: list[str]) -> list[int]:
        return pieces.count([w.encode() for w in words])

    def of_stretches(new: list[str]) -> list[tuple[int, int]]:
        return [(sum(x), len(x)) for x in tokens.resolve([cut.findall(w) for w in new], of_words)]

    (line_break,) = tokens.resolve([["\n"]], of_words)[0]
    found = cache.resolve([words for words, _ in lists], of_stretches)
    return [(sum([a for a, _ in x]) + breaks * line_break, sum([b for _, b in x]) + breaks) for x, (_, breaks) in zip(found, lists, strict=True)]


def _stretches(line: str) -> list[str]:
    first, *rest = line.split(" ")
    return [first, *[" " + w for w in rest]]


def counted(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_pretokens of every whole text."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        found = counts_of(texts, path, pattern)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return docs.select(id_col, text_col).mapInArrow(by_slices(work), "doc_id long, n_tokens long, n_pretokens long")


def brute_force(word: bytes, scores: dict[bytes, float]) -> Iterator[tuple[float, int]]:
    """All segmentations of a short word, for tests: summed score and number of pieces."""
    if not word:
        yield 0.0, 0
    for k in range(1, len(word) + 1):
        if word[:k] in scores:
            for s, n in brute_force(word[k:], scores):
                yield scores[word[:k]] + s, n + 1
