"""Whitening of embeddings from an exact integer scatter.

Entries become integers, x = floor(64 c) + 1,000,000. Tasks subtract the shift and add up counts, sums and products of
all rows as integers of any size, which leave them in limbs of 32 bits that Spark sums; so the driver gets what depends
on the dimension alone. There n X'X - SS' is formed exactly, and only then divided and handed to an eigensolver. Rows
are projected in tasks, with a matrix of as many columns as there are components.

Sums of integers don't depend on order, so components are the same however the table is split. Products of a block are
taken in floating point where all partial sums stay below 2^53 and hence exact, else in integers of any size.

Defined results. Vectors that are null or hold null or non-finite entries are left out, and so are vectors of another
length than the most frequent one (of equally frequent lengths the greater). Entries beyond the range of a long count as
its ends. Components without variance (eigenvalue below 1e-12 of the greatest, as with few or equal vectors) have null
in `whitened`, and count neither in `identity_error` nor elsewhere. Repeated rows, repeated and null ids count as often
as they occur. An empty table gives an empty table. Other columns are not read and can't clash. A deviation beyond 38
digits is null. Vectors are held in blocks of 4096 rows, fewer where they are longer than 4096 entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 4096 * 4096

#: Eigenvalues that are no more than this part of the greatest one are rounding.
NO_VARIANCE = 1e-12
LIMB = 32
LONG = (-(2**63), 2**63 - 1)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector (as doubles) of the rows that count."""
    finite = F.forall(F.col("vector"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    usual = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (usual.d if usual else 0))


def blocks(batches: Iterator[pa.RecordBatch], d: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Bounded runs of rows with floor(64 c), the integers less the shift; integers of any size where they are beyond 2^53."""
    step = max(1, min(4096, BLOCK // d))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            values = np.asarray(part.column(at).flatten(), dtype=np.float64).reshape(part.num_rows, d)
            with np.errstate(over="ignore"):
                y = np.floor(values * SCALE)
            if y.size and np.abs(y).max() >= 2.0**53:
                low, high = LONG[0] - SHIFT, LONG[1] - SHIFT
                y = np.array([[low if v <= low else high if v >= high else int(v) for v in row] for row in y.tolist()], dtype=object)
            yield part, y


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A whole number in digits of 32 bits, of which only the last is signed."""
    at = 0
    while not -(2 ** (LIMB - 1)) <= value < 2 ** (LIMB - 1):
        yield at, value & (2**LIMB - 1)
        value >>= LIMB
        at += 1
    yield at, value


def sums_and_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of columns and y'y of whole numbers, exact, as integers of any size."""
    if y.dtype != object:
        if len(y) * max(1.0, float(np.abs(y).max(initial=0.0))) ** 2 < 2.0**53:
            return y.sum(axis=0).astype(np.int64).astype(object), (y.T @ y).astype(np.int64).astype(object)
        y = y.astype(np.int64).astype(object)
    return y.sum(axis=0), y.T.dot(y)


@dataclass
class Fit:
    """n, sums and eigenpairs, of which `vectors` has one in each column, by falling eigenvalue; sums are those less the shift."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def kept(self) -> np.ndarray:
        return self.values > max(0.0, NO_VARIANCE * float(self.values[0]))


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """The count, the sums and n X'X - SS', exactly; the last doesn't depend on the shift."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        for _, y in blocks(batches, d):
            s, p = sums_and_products(y)
            n, sums, total = n + len(y), sums + s, total + p
        found = [(-1, -1, *limb) for limb in limbs(n)] + [(i, -1, *limb) for i in range(d) for limb in limbs(sums[i])]
        found += [(i, j, *limb) for i in range(d) for j in range(i, d) for limb in limbs(total[i, j])]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "at", "limb"])

    held = rows.select("vector").mapInArrow(run, "i int, j int, at int, limb long").groupBy("i", "j", "at").agg(F.sum("limb").alias("limb"))
    found: dict[tuple[int, int], int] = {}
    for r in held.collect():  # as many rows as the matrix has entries
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.limb << (LIMB * r.at))
    n, sums = found[-1, -1], [found[i, -1] for i in range(d)]
    exact = np.empty((d, d), dtype=object)
    for i in range(d):
        for j in range(i, d):
            exact[i, j] = exact[j, i] = n * found[i, j] - sums[i] * sums[j]
    return n, sums, exact


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """From all rows that `usable` gives; None where there are none."""
    first = rows.first()
    if first is None:
        return None
    n, sums, exact = scatter(rows, d := len(first.vector))
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()])  # quotients of integers, each rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    trace = sum(exact[i, i] for i in range(d)) / (n * n)
    k = min(components, d)
    return Fit(n, sums, values[:k].copy(), (vectors * signs)[:, :k].copy(), values[:k] / trace if trace else np.zeros(k))


def deviations(y: np.ndarray, model: Fit) -> tuple[np.ndarray, pa.Array]:
    """n x - S divided by n, and the sum of its squares before the division."""
    most = model.n * int(max(abs(v) for v in (y.max(initial=0), y.min(initial=0)))) + max(map(abs, model.sums))
    if y.shape[1] * most * most < 2**63:
        z = y.astype(np.int64) * model.n - np.array(model.sums, dtype=np.int64)
        return z / model.n, pa.array((z * z).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
    z = np.array([[int(v) * model.n - s for v, s in zip(row, model.sums, strict=True)] for row in y.tolist()], dtype=object)
    squares = [sum(v * v for v in row) for row in z.tolist()]
    return np.array([[v / model.n for v in row] for row in z.tolist()]), pa.array([Decimal(v) if v < 10**38 else None for v in squares], pa.decimal128(38, 0))


def projected(y: np.ndarray, model: Fit) -> tuple[np.ndarray, pa.Array]:
    """Whitened rows, with NaN for components without variance, and deviations."""
    z, squares = deviations(y, model)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.kept, z @ model.vectors / np.sqrt(np.maximum(model.values, 0.0)), np.nan), squares


def identity_error(rows: DataFrame, model: Fit) -> float | None:
    """The greatest absolute entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    d, kept = len(model.sums), np.flatnonzero(model.kept)
    if not len(kept):
        return None

    def summed(centre: np.ndarray, square: bool) -> dict[tuple[int, int], float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(kept), len(kept) if square else 1))
            for _, y in blocks(batches, d):
                w = projected(y, model)[0][:, kept] - centre
                total += w.T @ w if square else w.sum(axis=0)[:, None]
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

        held = rows.select("vector").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg((F.sum("s") / model.n).alias("s"))
        return {(r.i, r.j): r.s for r in held.collect()}  # as many as there are pairs of components

    means = summed(np.zeros(len(kept)), False)
    found = summed(np.array([means[i, 0] for i in range(len(kept))]), True)
    return max(abs(s - (i == j)) for (i, j), s in found.items())


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    rows = usable(table, key, vector)
    model = fit(rows, components)
    kind = table.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    error, k, d = identity_error(rows, model), len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, y in blocks(batches, d, at=1):
            w, squares = projected(y, model)
            each = pa.array(np.repeat(np.arange(len(y)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(y) * k, model.n)), squares.take(each),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, len(y))), pa.array([error] * (len(y) * k), pa.float64()),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
