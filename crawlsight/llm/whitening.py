"""Embedding whitening from a bit-sliced scatter matrix.

Entries become whole numbers x = floor(64 c) + 1,000,000. Every task shifts the distinct vectors by
the least entry of each dimension and cuts them into bit planes: one bit of one dimension over all
rows of a block, packed into 64-bit words. The number of rows with both of two bits set is the
popcount of two planes' AND, and such counts, weighted by their powers of two, are exact sums of
products. Tasks send those sums, whose size is given by the dimensions and not by the rows, in limbs
of 31 bits; the covariance n G - S S' is formed in whole numbers, so it is centred exactly before the
first rounding, which is the division by n squared in front of `eigh`.

Defined results: rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped,
and so are vectors that do not have the most frequent length (of equally frequent ones the longest).
Copies of one vector count once in the fit; each of their rows is returned. Entries beyond 2^55 count
as 2^55. Where an eigenvalue is zero up to rounding (one vector, constant or dependent dimensions)
`whitened` is null, as no scale gives it variance 1; `explained` is null where all vectors are equal, and
`identity_error` covers the components that are scaled, null if there are none. A deviation beyond a
long is null. An empty table gives no rows. Columns beside id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import remove, scratch_dir

SCALE, OFFSET = 64, 1_000_000
BLOCK = 1 << 14      # rows whose planes are held at once
FOLDED = 1 << 24     # rows after which a task's counts are folded into limbs, so that no sum passes 64 bits
LIMB = 31            # bits of a limb
LARGEST = float(1 << 55)
LONG = 1 << 63
OUTPUT = ("component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


def whole_numbers(vector: Column) -> Column:
    """The vector as longs; null where it is not to be used."""
    entries = vector.cast("array<double>")
    usable = (F.size(entries) > 0) & F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    bounded = lambda c: F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST))
    return F.when(usable, F.transform(
        entries, lambda c: F.floor(bounded(c) * SCALE).cast("long") + OFFSET))


def usable_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns of the id and x, without the rows that have no usable vector."""
    return vectors.select(F.col(id_col), whole_numbers(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """One row of 64-bit words per (dimension, bit), the rows of `x` along its bits."""
    cut = [((x[:, i] >> b) & 1).astype(np.uint8) for i, m in enumerate(bits) for b in range(m)]
    packed = np.packbits(np.array(cut), axis=1)
    wide = np.zeros((len(cut), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, :packed.shape[1]] = packed
    return wide.view(np.uint64)


def _both(planes: np.ndarray) -> np.ndarray:
    """How many rows have both bits set, for every pair of planes."""
    out = np.zeros((len(planes), len(planes)), np.int64)
    for k, plane in enumerate(planes):
        out[k, k:] = np.bitwise_count(planes[k:] & plane).sum(axis=1, dtype=np.int64)
    return out + np.triu(out, 1).T


def _add_limbs(limbs: np.ndarray, counts: np.ndarray, bits: list[int]) -> None:
    """Add the weighted counts to limbs[l, i, j], then carry so that each limb but the last is below 2^31."""
    owner = np.repeat(np.arange(len(bits)), bits)
    place = np.concatenate([np.arange(m) for m in bits])
    weight = place[:, None] + place[None, :]
    cells = np.broadcast_arrays(weight // LIMB, owner[:, None], owner[None, :])
    np.add.at(limbs, tuple(cells), counts << (weight % LIMB))
    for low in range(len(limbs) - 1):
        limbs[low + 1] += limbs[low] >> LIMB
        limbs[low] &= (1 << LIMB) - 1


def scatter(distinct: DataFrame, least: list[int], most: list[int]) -> list[list[int]]:
    """Exact sums of products over the rows of `x` minus `least`, with a constant 1 as last dimension."""
    dims = len(least)
    bits = [(high - low).bit_length() for low, high in zip(least, most)] + [1]
    n_limbs = (2 * max(bits) + 62) // LIMB + 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = np.zeros((n_limbs, dims + 1, dims + 1), np.int64)
        counts, rows = np.zeros((sum(bits), sum(bits)), np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), dims) - np.array(least, np.int64)
            for start in range(0, len(x), BLOCK):
                part = x[start:start + BLOCK]
                counts += _both(_planes(np.column_stack([part, np.ones(len(part), np.int64)]), bits))
                rows += len(part)
                if rows >= FOLDED:
                    _add_limbs(limbs, counts, bits)
                    counts[:], rows = 0, 0
        _add_limbs(limbs, counts, bits)
        flat = limbs.transpose(1, 0, 2).reshape(dims + 1, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims + 1), pa.int32()), pa.array(list(flat), pa.list_(pa.int64()))], ["i", "limbs"])

    sums = (distinct.mapInArrow(task, "i int, limbs array<long>")
            .select("i", F.posexplode("limbs").alias("at", "limb")).groupBy("i", "at").agg(F.sum("limb").alias("limb")))
    out = [[0] * (dims + 1) for _ in range(dims + 1)]
    for i, at, limb in sums.collect():  # dims squared times the limbs, whatever the number of rows
        out[i][at % (dims + 1)] += limb << (LIMB * (at // (dims + 1)))
    return out


@dataclass
class Whitening:
    """What every row is projected with; all fields are bounded by the number of dimensions."""

    dims: int
    n: int
    sums: list[int]
    reach: int                 # largest difference of two entries in one dimension
    weights: np.ndarray        # dims x components, already over sqrt(e); NaN where e is zero
    explained: list[float | None]
    identity_error: float | None


def solve(products: list[list[int]], least: list[int], components: int, reach: int) -> Whitening:
    """Components from the exact sums of products of `scatter`."""
    dims, n = len(least), products[-1][-1]
    shifted = [row[-1] for row in products[:-1]]
    covariance = np.array([[(n * products[i][j] - shifted[i] * shifted[j]) / (n * n) for j in range(dims)]
                           for i in range(dims)])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    spread = values > dims * np.finfo(float).eps * max(float(values[0]), 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weights = np.where(spread, vectors / np.sqrt(np.where(spread, values, np.nan)), np.nan)
    used = weights[:, spread]
    error = float(np.abs(used.T @ covariance @ used - np.eye(used.shape[1])).max()) if spread.any() else None
    explained = [max(float(e), 0.0) / trace if trace > 0 else None for e in values]
    return Whitening(dims, n, [s + n * low for s, low in zip(shifted, least)], reach, weights, explained, error)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
        components: int = 16) -> Whitening | None:
    """Fit over every distinct vector; None where no row has a usable one."""
    rows = usable_rows(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return None
    spark, dims = vectors.sparkSession, length["d"]
    path = scratch_dir(spark, "distinct-vectors")
    rows.filter(F.size("x") == dims).select("x").distinct().write.parquet(path)
    try:
        distinct = spark.read.schema("x array<long>").parquet(path)
        bounds = (distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i")
                  .agg(F.min("c").alias("least"), F.max("c").alias("most")).orderBy("i").collect())
        least, most = [b["least"] for b in bounds], [b["most"] for b in bounds]
        reach = max(high - low for low, high in zip(least, most))
        return solve(scatter(distinct, least, most), least, components, reach)
    finally:
        remove(spark, path)


def _deviations(x: np.ndarray, fitted: Whitening) -> pa.Array:
    """Sums of (n x - S) squared, exact."""
    if (fitted.n * fitted.reach) ** 2 * fitted.dims < LONG:
        away = fitted.n * (x - np.array([s // fitted.n for s in fitted.sums]))
        away -= np.array([s % fitted.n for s in fitted.sums])
        return pa.array((away * away).sum(axis=1), pa.int64())
    exact = [sum((fitted.n * v - s) ** 2 for v, s in zip(row, fitted.sums)) for row in x.tolist()]
    return pa.array([d if d < LONG else None for d in exact], pa.int64())


def whiten(vectors: DataFrame, fitted: Whitening | None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: the id, then the columns of OUTPUT."""
    rows = usable_rows(vectors, id_col, vector_col)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {OUTPUT}"
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    many = len(fitted.explained)
    # x - S/n from whole numbers: the mean's whole part goes before, its fraction after the conversion
    whole = np.array([s // fitted.n for s in fitted.sums])
    fraction = np.array([(s % fitted.n) / fitted.n for s in fitted.sums])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), fitted.dims)
            white = ((x - whole) - fraction) @ fitted.weights
            at = np.repeat(np.arange(len(x)), many)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), fitted.n, np.int64)),
                _deviations(x, fitted).take(pa.array(at)),
                pa.array(white.reshape(-1), pa.float64(), from_pandas=True),
                pa.array(fitted.explained * len(x), pa.float64()),
                pa.array([fitted.identity_error] * len(at), pa.float64()),
            ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == fitted.dims).mapInArrow(project, schema)
