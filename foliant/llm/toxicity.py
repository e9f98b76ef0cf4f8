"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps homoglyphs and accented Latin letters' compatibility forms to plain ones, reads digits and
signs inside words as the letters they stand for, and leaves one blank between words. Lexicon entries are whole words or
beginnings of words. A hit inside a longer exception phrase doesn't count. The weights of the hits, normalised by the
length of the text, go through a logistic curve.

The lexicon and the curve are learned from labelled texts: in a sample of at most `SAMPLE` of them, beginnings of words
are counted by document and label, and those that are frequent enough and tell toxic documents apart are taken, the
most telling first, each only if it covers documents that the ones before don't. Nothing but the text enters a score.

Nulls: a null text counts as empty and gets the score of a text without hits; a row with a null doc_id is scored and
counts as not held out. Labels that are null are left out, and repeated labels count once (the larger). Without usable
labels the built-in lexicon stands alone. Repeated rows get equal scores; an empty table gives no rows. Texts are scored
whole, in time that grows in proportion to their length. Of entries that begin at one place the heaviest counts.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import by_slices, written

#: The most labelled rows that are learned from, and the most entries of a learned lexicon.
SAMPLE, ENTRIES = 8_000, 600
#: A beginning of a word needs so many toxic documents, and so large a share of toxic ones among those that have it.
SUPPORT, PURITY = 3, 0.9
SHORTEST, LONGEST = 3, 8

# General-purpose entries and their weights, and phrases in which they mean nothing bad.
LEXICON = {"idiot": 3.0, "moron": 3.0, "stupid": 2.0, "scum": 3.0, "loser": 2.0, "pathetic": 2.0, "worthless": 2.5, "disgusting": 2.0, "imbecile": 3.0, "dumb": 1.5}
EXCEPTIONS = ["sore loser rule", "clown fish", "clown car", "trash can", "trash bin", "trash collection", "pond scum", "soap scum", "idiot proof", "idiot light"]
HOMOGLYPHS = dict(zip("аеорсухіјѕһԁԛԝɡαεικνορτυχ", "aeopcyxijshdqwgaeiknoptux", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!]+(?=[^\W\d_])|(?<![^\W_])[0134578@$]+(?=[^\W\d_])")
BREAKS = re.compile(r"[^\w]+|_+")
TABLE = str.maketrans(HOMOGLYPHS | {"­": None, "​": None, "‌": None, "‍": None, "﻿": None})
SIGN_TABLE = str.maketrans(SIGNS)


def folded(text: str) -> str:
    """Words with a blank before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii():
        text = text.translate(TABLE)
    text = INSIDE.sub(lambda m: m[0].translate(SIGN_TABLE), text)
    return f" {BREAKS.sub(' ', text).strip()} "


@functools.lru_cache(maxsize=4)
def automaton(lexicon: str, exceptions: tuple[str, ...]):
    """Entries begin with a blank; those that are whole words also end with one."""
    auto = ahocorasick.Automaton()
    for entry, weight in json.loads(lexicon).items():
        auto.add_word(entry, (len(entry), entry, weight))
    for phrase in exceptions:
        auto.add_word(f" {phrase} ", (len(phrase) + 2, "", 0.0))
    if not len(auto):
        auto.add_word("\0", (1, "", 0.0))
    auto.make_automaton()
    return auto


def hits(text: str, lexicon: str, exceptions: tuple[str, ...]) -> tuple[float, int, int, int]:
    """Of a whole text: summed weight, hit words, distinct entries hit, words. A word counts once, by its heaviest entry."""
    text = folded(text)
    best: dict[int, tuple[float, str]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, entry, weight) in automaton(lexicon, exceptions).iter(text):
        begin = end - size + 1
        if not entry:
            spared.append((begin, end))
        elif begin not in best or weight > best[begin][0]:
            best[begin] = (weight, entry)
    if spared:
        # the furthest end of a phrase that begins no later, in one walk along both
        spared.sort()
        k, reach, left = 0, -1, {}
        for at in sorted(best):
            while k < len(spared) and spared[k][0] <= at:
                reach = max(reach, spared[k][1])
                k += 1
            if at + 1 >= reach:
                left[at] = best[at]
        best = left
    return sum(w for w, _ in best.values()), len(best), len({e for _, e in best.values()}), text.count(" ") - 1 if len(text) > 2 else 0


def features(weight: float, count: int, distinct: int, words: int) -> list[float]:
    """Weight to a hundred words, capped hits, distinct entries."""
    return [min(100.0 * weight / max(words, 20), 30.0) / 10, min(count, 5) / 5, min(distinct, 3) / 3]


class Model:
    """A lexicon and the logistic curve over its normalised hits."""

    def __init__(self, lexicon: dict[str, float], bias: float, slopes: list[float], exceptions: list[str]):
        self.lexicon, self.bias, self.slopes, self.exceptions = json.dumps(lexicon, sort_keys=True), bias, slopes, tuple(exceptions)

    def score(self, text: str) -> float:
        x = features(*hits(text, self.lexicon, self.exceptions))
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.bias + float(np.dot(x, self.slopes)), -30, 30))))


BUILT_IN = {f" {w} ": v for w, v in LEXICON.items()}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled, not held out documents (text, toxic), chosen by a hash of doc_id; of unlike texts with one doc_id the one with the least hash."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # `chosen` has at most `most` rows of two numbers
    return docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("m")).select("doc_id", "m.text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a word, or a word with such a beginning."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(folded(text or "").split())
            seen[1 if toxic else 0].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)})
    for kind, counts in enumerate(seen):
        keys = sorted(counts)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            numbers = pa.array([counts[k] for k in part], pa.int64())
            none = pa.array([0] * len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *([numbers, none] if kind else [none, numbers])], names=["entry", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, exceptions: list[str] | None = None) -> Model:
    """Fits lexicon and curve on the sample. What reaches the driver are at most 20 * ENTRIES counted entries and 4 numbers for each sampled row."""
    exceptions = EXCEPTIONS if exceptions is None else exceptions
    drawn = written(sample(docs, labels, most).select("text", "toxic"), "labelled")
    totals = {r["toxic"]: r["n"] for r in drawn.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    if min(bad, good) < SUPPORT:
        return Model(BUILT_IN, -4.0, [4.0, 2.0, 2.0], exceptions)
    counted = drawn.repartition(16).mapInArrow(_counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # only telling entries compete for the places
    telling = counted.where(F.col("toxic") >= SUPPORT).where(F.col("toxic") >= PURITY * (F.col("toxic") + F.col("clean") * bad / good))
    wanted = telling.orderBy(F.desc("toxic"), "clean", "entry").limit(20 * ENTRIES).collect()
    support, clean = {r["entry"]: r["toxic"] for r in wanted}, {r["entry"]: r["clean"] for r in wanted}
    lexicon = choose(support, clean, bad, good)
    model = Model(BUILT_IN | lexicon, 0.0, [0.0] * 3, exceptions)
    lex, exc = model.lexicon, model.exceptions

    def measured(batches):
        for batch in batches:
            rows = [features(*hits(t or "", lex, exc)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array([int(bool(y)) for y in batch.column(1).to_pylist()], pa.int64())], names=["x", "y"])

    rows = drawn.mapInArrow(measured, "x array<double>, y long").collect()
    model.bias, model.slopes = logistic(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))
    return model


def choose(support: dict[str, int], clean: dict[str, int], bad: int, good: int) -> dict[str, float]:
    """The telling entries with their log odds. A longer beginning is left out where a shorter one tells as much."""
    odds = {e: float(np.log((n + 0.5) / (bad + 1)) - np.log((clean[e] + 0.5) / (good + 1))) for e, n in support.items()}
    chosen: dict[str, float] = {}
    for entry in sorted(odds, key=lambda e: (len(e), e)):
        stem = entry.rstrip()
        shorter = [chosen[stem[:k]] for k in range(SHORTEST + 1, len(stem) + (entry != stem)) if stem[:k] in chosen]
        if not shorter or max(shorter) < odds[entry] - 0.7:
            chosen[entry] = odds[entry]
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 60) -> tuple[float, list[float]]:
    """Newton's method, with a ridge on the slopes."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(a.shape[1]), ridge * np.diag([1e-3, *[1.0] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), [float(v) for v in w[1:]]


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the score of every whole text."""

    def work(keys: list, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(by_slices(work), "doc_id long, score double")


def rejecting(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores below `threshold`."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = part.column(at)
                keep = [model.score(texts[k].as_py() or "") < threshold for k in range(part.num_rows)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
