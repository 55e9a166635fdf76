"""Embedding whitening by MLlib's singular value decomposition of centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch

#: Fixed-point form of an entry c: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size or more, times SCALE, don't fit the fixed-point form.
TOO_LARGE = float(1 << 62)
#: Singular values below this share of the first are rounding of a Gramian of doubles: no variance to scale by.
LEAST_SHARE = 1e-6


@dataclass
class Whitening:
    """What rows are whitened by: n fit vectors with per-dimension ``sums``, and components as columns.

    ``eigenvalues`` are those of the fit vectors' covariance (divisor n) and fall;
    ``variance`` is the covariance's trace.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float
    identity_error: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.variance) for e in self.eigenvalues]


def fixed_point(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, x) for each usable row: entries as longs, floor(64 c) + 1000000.

    Rows go whose vector is null, empty, or holds a null, a NaN, an infinity or an entry
    of 2**56 or more. Where lengths differ, the commonest is meant (of two alike the
    larger), and rows of others go too. Null ids stay, and so do repeated rows.
    """
    entries = F.transform(column, lambda c: c.cast("double"))
    usable = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c * SCALE) < TOO_LARGE) & ~F.isnan(c))
    rows = vectors.where(F.size(column) > 0).where(usable).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(2).collect()
    return rows.where(F.size("x") == sizes[0]["size"]) if len(sizes) > 1 else rows


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of fit vectors and their sums by dimension: as many numbers as a vector has come to the driver."""
    found = fit.select(F.posexplode("x").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("place").collect()
    return (found[0]["n"], [r["s"] for r in found]) if found else (0, [])


def _row_matrix(rows: DataFrame, column: str | Column) -> RowMatrix:
    """A distributed matrix of a column of arrays."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v"))


def _spread_of(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """n x - S, and each row's exact sum of its squares (null beyond 38 digits)."""
    exact = n * x - sums if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) < 2**62 else n * x.astype(object) - sums.astype(object)
    if float(np.abs(exact).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**62:
        squares = (exact * exact).sum(axis=1).astype(np.int64)
        return exact.astype(np.float64), pa.array(squares).cast(pa.decimal128(38, 0))
    wide = exact.astype(object)
    squares = [int(v) for v in (wide * wide).sum(axis=1)]
    return exact.astype(np.float64), pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0))


def _project(n: int, sums: list[int], axes: np.ndarray):
    """Rows' exact deviations and their projections on ``axes``, columns scaled to unit variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.array(sums, np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(sums)) if batch.num_rows else np.zeros((0, len(sums)), np.int64)
            away, deviation = _spread_of(x, n, totals)
            whitened = (away / n) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * axes.shape[1], pa.int32()), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, lists], names=["vec_id", "deviation", "whitened"])

    return run


def _projected(rows: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    return rows.mapInArrow(_project(n, sums, axes), "vec_id long, deviation decimal(38,0), whitened array<double>")


def fit_whitening(rows: DataFrame, components: int = 16) -> Whitening:
    """Fit on the distinct vectors of ``rows`` (vec_id, x), at most ``components`` components.

    Distinct vectors are written once. Their sums give centred rows (n x - S) / n, whose
    differences are exact before the division; computeSVD on these rows gives the
    components, and a singular value s the eigenvalue s * s / n. All of a vector's
    dimensions are asked for, since MLlib then decomposes the summed Gramian to double
    precision, and stops an iteration at 1e-10 else. The total variance is the sum of the
    exact integer deviations over n**3. A second pass over the fit vectors measures how
    far the whitened ones' covariance is from the identity.

    Components of no variance are left out, so n = 1 or an empty table has none.
    Memory of the driver and of the aggregating tasks is that of a square matrix of a
    vector's dimensions, whatever the number of rows.
    """
    scratch = Scratch(rows.sparkSession)
    fit = scratch.keep(rows.select("x").distinct().select(F.lit(None).cast("long").alias("vec_id"), "x"), "whitening-fit")
    n, sums = _moments(fit)
    d = len(sums)
    out = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)
    if n > 1:
        centred = _projected(fit, n, sums, np.eye(d))
        found = _row_matrix(centred, "whitened").computeSVD(d, rCond=LEAST_SHARE)
        values = found.s.toArray()[:components] ** 2 / n
        axes = found.V.toArray()[:, : len(values)]
        scaled = scratch.keep(_projected(fit, n, sums, axes / np.sqrt(values)), "whitening-rows")
        squares = scaled.agg(F.sum("deviation")).first()[0]
        means = [r["m"] for r in scaled.select(F.posexplode("whitened").alias("place", "w")).groupBy("place").agg(F.avg("w").alias("m")).orderBy("place").collect()]
        away = F.zip_with("whitened", F.array(*map(F.lit, means)), lambda w, m: w - m)
        covariance = _row_matrix(scaled, away).computeGramianMatrix().toArray() / n
        out = Whitening(n, sums, axes, values, float(int(squares)) / float(n) ** 3, float(np.abs(covariance - np.eye(len(values))).max()))
    scratch.discard()
    return out


def whiten(rows: DataFrame, by: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) for each row of ``rows`` (vec_id, x).

    ``whitened`` has an entry for each component: (x - S / n) projected on it, over the
    root of its eigenvalue; it is empty where there are none. ``deviation`` is the exact
    sum over dimensions of (n x - S) ** 2, null where 38 digits don't hold it.
    """
    axes = by.components / np.sqrt(by.eigenvalues) if len(by.eigenvalues) else np.zeros((len(by.sums), 0))
    return _projected(rows.select("vec_id", "x"), max(by.n, 1), by.sums, axes)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long doesn't hold is null."""
    rows = fixed_point(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    by = fit_whitening(rows, 16)
    told = whiten(rows, by).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, by.explained or [0.0])), F.col("place") + 1)
    return told.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(by.identity_error).alias("identity_error"))
