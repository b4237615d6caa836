"""Vector arithmetic on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of the products of two arrays, in double precision; NULL if either is NULL."""
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; NULL if either has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def usable(vector: Column | str, size: int) -> Column:
    """True for ``size`` finite numbers that are not all zero."""
    v = _col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(df: DataFrame, vector: str, to: str = "u") -> DataFrame:
    """``df`` with ``to``, the vector at length 1 in double precision; rows with norm 0 or NULL are dropped."""
    scaled = df.withColumn("_norm", norm(vector)).where("_norm > 0")
    return scaled.withColumn(to, F.transform(vector, lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


def mean_vector(df: DataFrame, by: list[str], vector: str, size: int, to: str = "centroid") -> DataFrame:
    """The mean vector of every group: ``size`` averages in one combined aggregate, nothing is exploded or collected."""
    means = df.groupBy(*by).agg(*[F.avg(F.col(vector)[i]).alias(f"_m{i}") for i in range(size)], F.count(F.lit(1)).alias("n_vectors"))
    return means.select(*by, "n_vectors", F.array(*[f"_m{i}" for i in range(size)]).alias(to))


def min_max(value: Column | str, by: list[str]) -> Column:
    """``value`` scaled to 0..1 within its group; 1 where the group is flat."""
    value, w = _col(value), W.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low > 1e-12, (value - low) / (high - low)).otherwise(F.lit(1.0))


def softmax(logits: Column | str) -> Column:
    """Softmax over an array of logits."""
    logits = _col(logits)
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / _total(powers))
