"""Whitened principal components of the embeddings, by the Gramian of exactly centred rows.

A vector's entries become the integers x = floor(256 c). The fit list holds each distinct x vector
once. Its size n and sums S are exact integers, so n x - S is exact too, and a centred entry
(n x - S) / n is rounded once. MLlib's RowMatrix over the centred rows gives their Gramian, whose
n-th part is the covariance V (a matrix of dimensions squared: all that the driver holds). Its unit
eigenvectors are found locally; they, n and S go to every task, which whitens its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy, written

_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the vectors that take part."""
    c = F.transform(vector_col, lambda v: v.cast("double"))
    whole = F.col("c").isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), c.alias("c")).where(F.coalesce(whole, F.lit(False))).select("id", F.transform("c", lambda v: F.floor(v * 256).cast("long")).alias("x"))


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in 64 bits where all fit, else as Python's integers."""
    most = max((abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))), default=0)
    if n * most + max(map(abs, sums), default=0) < 1 << 63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1 if len(column) else 0)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(n, S): each task's sums are exact, and one row of them is left for each dimension of each task."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if len(b):
                s = _rows(b.column("x")).astype(object).sum(axis=0) if len(b) < 2 else _exact_sum(_rows(b.column("x")))
                n, total = n + len(b), s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(v) for v in total])], ["i", "n", "s"])

    found = fit.select("x").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()  # a row a dimension
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _exact_sum(x: np.ndarray) -> np.ndarray:
    small = max(abs(int(x.max())), abs(int(x.min()))) * len(x) < 1 << 63
    return (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)


def _covariance(centred: DataFrame, n: int) -> np.ndarray:
    """The Gramian of the rows of a column `v` of arrays, divided by n."""
    ml = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("v").alias("v")), "v")
    return RowMatrix(ml).computeGramianMatrix().toArray() / n


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): rows for each vector and each component up to `most`.

    Components are numbered from 1 by falling eigenvalue, with the sign that makes their largest
    entry positive. identity_error is measured on the fit list: the largest absolute entry of the
    covariance of whitened less the identity, over the components returned.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another
    length than the most frequent one (the shorter of equally frequent). Repeated rows and rows of
    one or of null id are rows of their own. A component without variance (an eigenvalue within the
    rounding of the sum of all) can't be whitened and has no rows, so that a single vector, equal
    ones, empty vectors and an empty table give none. deviation is null where it doesn't fit 64 bits.
    Other columns aren't read. The driver holds a matrix of the dimensions squared.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = integers(vectors, id_col, vector_col)
    none = lambda: spark.createDataFrame([], f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None or not length.d:
        return none()
    rows = rows.where(F.size("x") == length.d)
    fit = written(rows.select("x").distinct())
    n, sums = _sums(fit)

    @tidy
    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (_centred(_rows(b.column("x")), n, sums) / n).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float64()))], ["v"])

    centred = fit.mapInArrow(centre, "v array<double>")
    covariance = _covariance(centred, n)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    total = float(np.trace(covariance))
    k = min(most, int((values > total * length.d * np.finfo(float).eps).sum()))
    if not k:
        return none()
    axes = axes[:, :k] * np.sign(axes[np.abs(axes[:, :k]).argmax(axis=0), np.arange(k)])
    turn, explained = axes / np.sqrt(values[:k]), values[:k] / total

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column("v")) @ turn
            yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.list_(pa.float64()))], ["v"])

    error = float(np.abs(_covariance(centred.mapInArrow(project, "v array<double>"), n) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((n, sums, turn))  # 2 + k numbers a dimension

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, turn = shared.value
        for f in frames:
            if not len(f):
                continue
            z = _centred(np.stack(f.x.to_numpy()).astype(np.int64), n, sums)
            small = z.dtype == np.int64 and (most := max(abs(int(z.max())), abs(int(z.min())))) ** 2 * z.shape[1] < 1 << 63
            deviation = (z * z).sum(axis=1) if small else (z.astype(object) ** 2).sum(axis=1)
            w = (z / n).astype(np.float64) @ turn
            yield pd.DataFrame({
                "id": np.repeat(f.id.to_numpy(object), k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(f)), "n": n,
                "deviation": pd.array([int(v) if v < 1 << 63 else None for v in np.repeat(deviation, k)], "Int64"),
                "whitened": w.ravel(), "explained": np.tile(explained, len(f)), "identity_error": error,
            })

    # as strings, since pandas reads numbers with nulls among them as floats
    out = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(whiten, f"id string, {_OUT}")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
