"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

The distinct pre-tokens of a run of documents are dealt into matrices by byte length, one row each. In every round each
row merges its leftmost pair of minimum rank; pairs are looked up in an open-addressing hash table held in two numpy
arrays, and rows that can merge no more are compacted away. Only the pair ranks beside a merge are looked up again.

A pre-token beyond `LONG` bytes is a matrix of one row, in which a round takes the merges of the row's minimum rank
together as far as they can't affect each other; cells that are gone stay until they are half of the row. So a very long
text without blanks costs a pass for each rank that it holds, not one for each byte.

Texts are taken whole, however long. Ties between pairs go to the leftmost. Nulls in the text count as an empty text, which has no ids and decodes to no bytes. Repeated rows give repeated results,
an empty table an empty one, and columns other than the two named ones are neither read nor returned.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliant.llm.common import Cache, by_slices

NONE = np.int32(2**31 - 1)
#: Cells of a matrix that are worked on at a time.
CELLS = 1_000_000
#: Bytes of a pre-token beyond which it is worked on alone.
LONG = 4096
#: White space that is no single space or line break. The pattern's class of white space is that of Unicode.
WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"([{WHITE}]{{2,}})")


class PairTable:
    """(left id, right id) -> merged id, by linear probing in a table that is at most an eighth full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(10, int(len(left) * 8 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64(2**bits - 1)
        self.keys, self.values = np.full(2**bits, -1, np.int64), np.full(2**bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo = self.slot(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = key[todo[free]]
            settled = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[settled]]] = merged[todo[settled]]
            todo = todo[~settled]
            slot[todo] = (slot[todo] + 1) & self.mask

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is none; a negative id on the right is padding and merges with nothing."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self.slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.values[slot], NONE)
        probing = np.flatnonzero((held != key) & (held != -1))
        while len(probing):
            slot[probing] = (slot[probing] + 1) & self.mask
            held = self.keys[slot[probing]]
            hit = held == key[probing]
            out[probing[hit]] = self.values[slot[probing[hit]]]
            probing = probing[~hit & (held != -1)]
        return out


class ByteBpe:
    """A vocabulary of ranks; ids are ranks, as every merge makes the token of the joined bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*splits, strict=True)))
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as the bytes of 32-bit integers. One that is a token as a whole is that token."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > LONG:
                out[i] = self._merge_long(w)
            else:
                n = len(w)  # wide rows are padded to a power of two, so that there are few buckets
                by_width.setdefault(n if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                self._merge(words, part, width, out)
        return out

    def _merge(self, words: list[bytes], part: list[int], width: int, out: list[bytes]) -> None:
        n = len(part)
        text = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in part]), np.uint8).reshape(n, width)
        grid = self.of_byte[text]
        if width > 32:
            grid[np.arange(width)[None, :] >= np.array([len(words[i]) for i in part])[:, None]] = -1
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs.find(grid[:, :-1].ravel(), grid[:, 1:].ravel()).reshape(n, width - 1)
        live = np.array(part)
        while True:
            at = rank.argmin(axis=1)  # the leftmost of equal ones
            rows = np.arange(len(live))
            best = rank[rows, at]
            done = best == NONE
            if done.any():
                over = np.ascontiguousarray(grid[done])
                texts = over.view(f"V{4 * over.shape[1]}").ravel().tolist()
                if width > 32:
                    texts = [x[: 4 * k] for x, k in zip(texts, (over >= 0).sum(axis=1).tolist(), strict=True)]
                for i, x in zip(live[done].tolist(), texts, strict=True):
                    out[i] = x
                keep = ~done  # compaction
                live, grid, rank, at, best = live[keep], grid[keep], rank[keep], at[keep], best[keep]
                if not len(live):
                    return
                rows = np.arange(len(live))
            grid[rows, at] = best
            stay = np.ones(grid.shape, bool)
            stay[rows, at + 1] = False  # every row loses one cell
            grid, rank = grid[stay].reshape(len(live), -1), rank[stay].reshape(len(live), -1)
            last = grid.shape[1] - 1
            right = self.pairs.find(grid[rows, at], grid[rows, np.minimum(at + 1, last)])
            rank[rows, at] = np.where(at < last, right, NONE)
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.pairs.find(grid[some, at[some] - 1], grid[some, at[some]])

    def _merge_long(self, word: bytes) -> bytes:
        """The ids of one pre-token, a row of linked cells; the cell after the last one is padding, for both ends."""
        ids = np.append(self.of_byte[np.frombuffer(word, np.uint8)], np.int32(-1))
        rank = np.append(self.pairs.find(ids[:-1], ids[1:]), NONE)
        before, after = np.arange(-1, len(word)), np.arange(1, len(word) + 2)
        left = len(word)
        while (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            # of pairs that overlap, every other one from the left
            follows = np.concatenate([[False], before[at[1:]] == at[:-1]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            gone, prior = after[at], before[at]
            beyond = after[gone]
            # the cell on the left may itself have just been merged; the one on the right has not
            touches = np.concatenate([[False], prior[1:] == gone[:-1]])
            merged = np.full(len(at), best, np.int32)
            on_left = self.pairs.find(np.where(touches, best, ids[prior]), merged)
            on_right = self.pairs.find(merged, ids[beyond])
            # a merge that makes a pair of lesser rank is the last one of the round
            lesser = np.flatnonzero((on_left < best) | (on_right < best))
            n = int(lesser[0]) + 1 if len(lesser) else len(at)
            at, gone, prior, beyond, touches = at[:n], gone[:n], prior[:n], beyond[:n], touches[:n]
            ids[at], ids[gone], rank[gone] = best, -1, NONE
            rank[at] = on_right[:n]
            rank[np.where(touches, np.concatenate([[-1], at[:-1]]), prior)] = on_left[:n]
            after[at], before[beyond] = beyond, at
            left -= n
            if 2 * left < len(ids) - 1:  # compaction
                held = np.append(np.flatnonzero(ids >= 0), len(ids) - 1)
                ids, rank = ids[held], rank[held]
                before, after = np.arange(-1, left), np.arange(1, left + 2)
        return ids[ids >= 0].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        place = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[place].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple[ByteBpe, Cache, Cache]:
    """Once in each Python worker, with a cache of what stretches of text come to and one of pre-tokens."""
    return ByteBpe(path, pattern), Cache(300_000), Cache(250_000)


def stretches(text: str) -> list:
    """Cuts a text where the pattern certainly ends a match, which is far cheaper than matching all of it.

    A space after a visible character opens a match, a line break between visible characters is one, and of a run of
    white space all but the last character is one. A stretch that begins with a space stands here without it, as a
    plain string; all others are in a tuple.
    """
    out: list = []
    space = False
    parts = RUNS.split(text)
    for k in range(0, len(parts), 2):
        for n, line in enumerate(parts[k].split("\n")):
            first, *rest = line.split(" ")
            if n:
                out.append(("\n",))
                space = False
            if space:
                out.append(first)
            elif first:
                out.append((first,))
            out += rest
        if k + 1 < len(parts):
            run, space = parts[k + 1], False
            if k + 2 == len(parts) - 1 and not parts[k + 2]:
                out.append((run,))
                break
            out.append((run[:-1],))
            if not (space := run[-1] == " "):
                out.append((run[-1],))
    return out


def encode_texts(texts: Iterable[str], path: str, pattern: str) -> list[tuple[bytes, str]]:
    """Of each text its ids as bytes of 32-bit integers, and in decimal, joined by commas."""
    bpe, cache, tokens = vocabulary(path, pattern)

    def of_words(words: list[str]) -> list[bytes]:
        return bpe.encode_words([w.encode() for w in words])

    def of_stretches(new: list) -> list[tuple[bytes, str]]:
        cut = [bpe.pattern.findall(w[0] if isinstance(w, tuple) else f" {w}") for w in new]
        ids = [b"".join(x) for x in tokens.resolve(cut, of_words)]
        return [(x, ",".join(map(str, memoryview(x).cast("i")))) for x in ids]

    found = cache.resolve([stretches(t) for t in texts], of_stretches)
    return [(b"".join([a for a, _ in x]), ",".join([b for _, b in x])) for x in found]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and `ids` (array of int), one row per row of `docs`."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        ids = [np.frombuffer(x, np.int32) for x, _ in encode_texts(texts, path, pattern)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), values], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(by_slices(work), f"`{id_col}` long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256 (of the ids in decimal), decoded_sha256 (of the decoded bytes)."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        bpe, _, _ = vocabulary(path, pattern)
        coded = encode_texts(texts, path, pattern)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array([len(ids) // 4 for ids, _ in coded], pa.int64()),
                pa.array([hashlib.sha256(text.encode()).hexdigest() for _, text in coded]),
                pa.array([hashlib.sha256(bpe.decode(np.frombuffer(ids, np.int32))).hexdigest() for ids, _ in coded]),
            ],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select("doc_id", "text").mapInArrow(by_slices(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
