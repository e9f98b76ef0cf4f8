"""The filter audit against plain counting, with nulls, blanks, long texts, repeats, ties and empty tables."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def some_texts():
    rng = random.Random(3)
    letters = ["a", "B", "é", "日", "😀", " ", " ", "\n", "\t", "#", "\x85", "\xa0"]
    texts = ["".join(rng.choices(letters[: rng.randint(2, len(letters))], k=rng.randint(0, 300))) for _ in range(300)]
    return ["", " ", "word", "same same", "AAAA bbbb", *texts, "one two three " * 200, "x" * 4000, " ".join(f"w{i % 90}" for i in range(3000)) + " " + "y" * 2000]


@pytest.mark.parametrize("block", [1 << 20, 1000, 64])
def test_counts(monkeypatch, block):
    """Blocks of many documents, long documents in pieces, words longer than a block."""
    monkeypatch.setattr(audit, "BLOCK", block)
    texts = some_texts()
    for kind in (pa.string(), pa.large_string()):
        held = pa.array(["left out", *texts], kind).slice(1)
        counts, digests = audit.counted(audit.Scanner(), held)
        assert counts.tolist() == [plain(x) for x in texts]
        assert (len(set(digests))) == len(set(texts))


def test_colliding_hashes(monkeypatch):
    """Where all words have one hash, bytes settle what is distinct."""
    monkeypatch.setattr(audit, "OF_BYTE", np.zeros(256, np.uint64))
    texts = some_texts()[:100]
    assert audit.counted(audit.Scanner(), pa.array(texts))[0].tolist() == [plain(x) for x in texts]


def by_hand(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, x, _ in docs:
        if i is not None:
            first[x or ""] = min(i, first.get(x or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    fails = []
    for i, x, lang in docs:
        words, distinct, capitals, points, symbols = plain(x or "")
        bits = [words < 100, 100 * distinct < 80 * words, 100 * capitals > 10 * points, symbols > 0, i is not None and i > first[x or ""]]
        fails.append((lang or "", {f for f, b in zip("ABCDE", bits, strict=True) if b}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        rows, shares = [f for f in fails if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in rows if f in r[1] and not r[1] & before]
                shares[f] += len(here)
                out[part, "".join(order), step] = [
                    sum(not r[1] & (before | {f}) for r in rows), len(here), sum(f in r[1] and bool(r[1] & before) for r in rows), sum(r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shares[order[step - 1]])
    return out


def test_audit(spark):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = real + [(r[0] + 10_000, r[1], r[2]) for r in real[::3]] + [real[5], real[5], (real[5][0], "other text, same id", "en")]
    docs += [(None, None, None), (None, "", ""), (20_000, None, None), (20_001, "", None), (None, real[0][1], "en"), (20_002, "many words " * 500_000, "de"), (20_003, "x" * 3_000_000, "de")]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()]
    labels += [(docs[0][0], 0, 1), (20_000, 1, None), (None, 1, 1), (99_999, 1, 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("clash")).withColumn("mask", F.lit(3)).withColumn("digest", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5))
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in audit.audited(rows, marks).collect()}
    want = by_hand(docs, labels)
    assert got == want and len(got) == 600 * len({d[2] or "" for d in docs})
    # every document is removed once in each order, or stays
    for part in {k[0] for k in got}:
        assert sum(v[6] for k, v in got.items() if k[0] == part and k[1] == "ABCDE") == 120 * (sum(d[2] == part or (not d[2] and not part) for d in docs) - got[part, "ABCDE", 5][0])


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(docs, labels).count() == 0
    assert audit.audited(spark.createDataFrame([(1, "x", "en")], docs.schema), labels).count() == 600
