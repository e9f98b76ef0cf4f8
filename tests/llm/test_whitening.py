"""Whitening against fractions and a plain eigendecomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import whitening


def by_hand(vectors):
    x = [[math.floor(Fraction(c) * 64) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    z = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    covariance = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(v * v for v in r) for r in z], np.array([[float(Fraction(v, n)) for v in r] for r in z]), covariance


def check(got, vectors, ids):
    n, deviation, centred, covariance = by_hand(vectors)
    values = np.linalg.eigh(covariance)[0][::-1]
    k = min(32, len(values))
    white = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    assert all(sorted(got[i]) == list(range(1, k + 1)) for i in ids)
    for row, i in enumerate(ids):
        assert {(r.n, int(r.deviation)) for r in got[i].values()} == {(n, deviation[row])}
    for c in range(k):
        assert got[ids[0]][c + 1].explained == pytest.approx(values[c] / np.trace(covariance), rel=1e-9)
    # directions that give back what was projected: cov(x, w) = V v / sqrt(e) = sqrt(e) v
    v = centred.T @ white / n / np.sqrt(values[:k])
    assert np.abs(np.linalg.norm(v, axis=0) - 1).max() < 1e-8
    assert np.abs(covariance @ v - v * values[:k]).max() < 1e-8 * values[0]
    error = np.abs(np.cov(white.T, bias=True) - np.eye(k)).max()
    found = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(found) == 1 and found.pop() < 1e-6 and error < 1e-6


def by_id(df):
    out = {}
    for r in df.collect():
        assert r.component not in out.setdefault(r.vec_id, {})
        out[r.vec_id][r.component] = r
    return out


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumn("n", F.lit(0)).withColumn("key", F.lit(1)).withColumn("whitened", F.lit(1))
    rows = table.select("vec_id", "embedding").collect()
    check(by_id(whitening.whitened(table.repartition(7))), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_unusable_rows(spark):
    rng = np.random.default_rng(1)
    good = rng.normal(size=(40, 5)).tolist()
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [1.0] * 4]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(by_id(whitening.whitened(table)), good, list(range(40)))


def test_large_numbers(spark):
    """Beyond what floating point and 64 bits hold, sums and deviations stay exact."""
    rng = np.random.default_rng(2)
    good = (rng.normal(size=(30, 3)) * [1e9, 1e10, 1e11]).tolist()
    check(by_id(whitening.whitened(spark.createDataFrame(list(enumerate(good)), "vec_id long, embedding array<double>"))), good, list(range(30)))
    wide = [[1e16, 1.0], [-1e16, 2.0], [3e15, 7.0], [0.0, -5.0]]
    got = by_id(whitening.whitened(spark.createDataFrame(list(enumerate(wide)), "vec_id long, embedding array<double>")))
    n, deviation, _, covariance = by_hand(wide)
    assert [int(got[i][1].deviation) for i in range(4)] == deviation
    assert got[0][1].explained == pytest.approx(np.linalg.eigvalsh(covariance)[-1] / np.trace(covariance))
    ends = [[1e300], [-1e300], [0.0]]
    got = by_id(whitening.whitened(spark.createDataFrame(list(enumerate(ends)), "vec_id long, embedding array<double>")))
    x = [2**63 - 1, -(2**63), 1_000_000]
    assert [got[i][1].deviation for i in range(3)] == [v if (v := (3 * a - sum(x)) ** 2) < 10**38 else None for a in x]


def test_exact_sums(spark):
    """In any split of the rows, and with products beyond 2^53."""
    y = np.random.default_rng(3).integers(-(2**40), 2**40, (50, 4))
    want = y.astype(object)
    s, p = whitening.sums_and_products(y.astype(np.float64))
    assert s.tolist() == want.sum(axis=0).tolist() and p.tolist() == want.T.dot(want).tolist()
    for v in (0, -1, 2**31, -(2**31), 2**63, -(2**200) + 5, 3**90):
        assert sum(digit << (32 * at) for at, digit in whitening.limbs(v)) == v
        assert all(-(2**31) <= digit < 2**32 for _, digit in whitening.limbs(v))
    rows = spark.createDataFrame([([float(v) / 64 for v in r],) for r in y.tolist()], "vector array<double>")
    n, sums, exact = whitening.scatter(rows.repartition(6), 4)
    assert (n, sums) == (50, want.sum(axis=0).tolist())
    assert exact.tolist() == (50 * want.T.dot(want) - np.outer(want.sum(axis=0), want.sum(axis=0))).tolist()


def test_no_variance_and_repeats(spark):
    rows = [(1, [1.0, 2.0, 3.0])] * 3 + [(None, [1.0, 2.0, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 12 and all(r.whitened is None and r.n == 4 and r.deviation == 0 and r.identity_error is None for r in got)
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 2.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 6 and all((r.whitened is None) == (r.component == 2) for r in got) and got[0].identity_error < 1e-9


def test_empty(spark):
    out = whitening.whitened(spark.createDataFrame([], "vec_id int, embedding array<float>"))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
