"""What the vector operators share: usable vectors, their principal axes, the chance to share a bucket."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """(``id``, ``v`` array<float>) of the records whose vector has ``size`` finite numbers, not all zero.

    A key in several rows is one record: the row with the largest vector hash counts, so repeated rows change nothing.
    NULL keys, NULL vectors, other lengths, NaN, infinity and NULL elements are left out.
    """
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == size))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.max_by("v", F.xxhash64("v")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow list column of equal lengths as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mean, axes, variances) of all unit vectors, largest variance first.

    Each task adds up its rows' moments; the driver gets one size x size matrix per task's worth of sums, added up by Spark.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = unit(matrix(batch.column(0)))
            if len(x):
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        values = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "x"])

    sums = vectors.select("v").mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    if not len(sums) or sums[0] == 0:
        return 0, np.zeros(size), np.eye(size), np.ones(size)
    n, mean = int(sums[0]), sums[1 : size + 1] / sums[0]
    variances, axes = np.linalg.eigh(sums[size + 1 :].reshape(size, size) / n - np.outer(mean, mean))
    return n, mean, axes[:, ::-1], np.maximum(variances[::-1], 1e-12)


def same_bucket(variance: float, width: float) -> float:
    """Chance that two independent normal values of this variance fall into one bucket of this width (random offset)."""
    s = sqrt(2 * variance)
    z = width / s
    return erf(z / sqrt(2)) - sqrt(2 / np.pi) / z * (1 - np.exp(-z * z / 2))
