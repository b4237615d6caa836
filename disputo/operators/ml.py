"""Dimension reduction and clustering of policy centroids and of pools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputo.functions.vectors import dot, mean_vector
from disputo.runtime import small
from disputo.schema import DEFAULTS


def covariance(df: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with n - 1) of a vector column; every task adds up its rows' moments, Spark adds up the tasks' sums."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

    rows = df.where(F.size(vector) == size).select(vector)
    sums = rows.mapInArrow(moments, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    if not len(sums):
        return 0, np.zeros(size), np.zeros((size, size))
    n = int(sums[0])
    mean = sums[1 : size + 1] / max(n, 1)
    return n, mean, (sums[size + 1 :].reshape(size, size) - n * np.outer(mean, mean)) / max(n - 1, 1)


def pca(df: DataFrame, vector: str, size: int, k: int, to: str = "reduced") -> tuple[DataFrame, np.ndarray]:
    """``df`` with ``to``, the k leading components of the centred vector, and the components' share of the variance.

    Signs are fixed so that each axis' largest coefficient is positive.
    """
    _, mean, cov = covariance(df, vector, size)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    weights = [F.array(*[F.lit(float(w)) for w in axis]) for axis in axes.T]
    centred = F.zip_with(F.col(vector), F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    reduced = F.array(*[F.aggregate(F.zip_with(F.col("_c"), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for w in weights])
    return df.withColumn("_c", centred).withColumn(to, reduced).drop("_c"), values / np.trace(cov)


def k_means(df: DataFrame, vector: str, ks: list[int], seed: int = DEFAULTS.seed) -> DataFrame:
    """``df`` once per k with ``k`` and ``cluster``."""
    rows = df.withColumn("_f", array_to_vector(vector))
    out = None
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster", initSteps=5, maxIter=50).fit(rows)
        one = model.transform(rows).drop("_f").withColumn("k", F.lit(k))
        out = one if out is None else out.union(one)
    return out


def cluster_report(df: DataFrame, by: str, vector: str, size: int, cluster: str = "cluster") -> DataFrame:
    """Per clustering ``by``: ``silhouette``, ``davies_bouldin``, ``calinski_harabasz``, ``n_clusters``, ``noise_share`` (cluster -1).

    All from each cluster's size, centre and squared length, so no two rows meet: the mean squared distance of a row to a cluster is that to its centre
    plus the cluster's own spread.  The silhouette is of squared distances, 0 for rows alone in their cluster.  Noise counts only in its
    share; the three measures are NULL below two clusters.
    """
    rows = df.select(by, F.col(cluster).alias("c"), F.col(vector).alias("v")).withColumn("sq", dot("v", "v"))
    kept = rows.where("c >= 0")
    centres = mean_vector(kept, [by, "c"], "v", size, "m").withColumnRenamed("n_vectors", "n")
    centres = small(centres.join(kept.groupBy(by, "c").agg(F.avg("sq").alias("mean_sq")), [by, "c"]).withColumn("spread", F.greatest(F.col("mean_sq") - dot("m", "m"), F.lit(0.0))))
    far = kept.withColumnRenamed("c", "own").join(centres, by)
    square = F.greatest(F.col("sq") - 2 * dot("v", "m") + dot("m", "m"), F.lit(0.0))
    toward = F.when(F.col("c") == F.col("own"), F.when(F.col("n") > 1, (square + F.col("spread")) * F.col("n") / (F.col("n") - 1))).otherwise(square + F.col("spread"))
    rows_id = ["own", "v"]
    met = far.withColumns({"toward": toward, "square": square}).groupBy(by, *rows_id).agg(
        F.max(F.when(F.col("c") == F.col("own"), F.col("toward"))).alias("inside"), F.min(F.when(F.col("c") != F.col("own"), F.col("toward"))).alias("outside"),
        F.max(F.when(F.col("c") == F.col("own"), F.sqrt("square"))).alias("radius"), F.max(F.when(F.col("c") == F.col("own"), F.col("square"))).alias("within"), (F.count(F.lit(1)) / F.countDistinct("c")).alias("copies"),
    )
    each = F.when(F.col("inside").isNull(), 0.0).otherwise((F.col("outside") - F.col("inside")) / F.greatest("outside", "inside", F.lit(1e-300)))
    sums = met.groupBy(by).agg((F.sum(each * F.col("copies")) / F.sum("copies")).alias("silhouette"), F.sum(F.col("within") * F.col("copies")).alias("within"))
    radius = met.groupBy(by, F.col("own").alias("c")).agg((F.sum(F.col("radius") * F.col("copies")) / F.sum("copies")).alias("radius"))
    sized = small(centres.select(by, "c", "n", "m").join(radius, [by, "c"]))
    other = sized.select(by, F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("radius").alias("radius2"))
    apart = F.sqrt(dot("m", "m") - 2 * dot("m", "m2") + dot("m2", "m2"))
    worst = sized.join(other, by).where("c <> c2").withColumn("r", (F.col("radius") + F.col("radius2")) / apart).groupBy(by, "c").agg(F.max("r").alias("r"))
    bouldin = worst.groupBy(by).agg(F.avg("r").alias("davies_bouldin"))
    whole = mean_vector(kept, [by], "v", size, "g").withColumnRenamed("n_vectors", "total")
    across = sized.join(small(whole), by).groupBy(by).agg(
        F.sum(F.col("n") * (dot("m", "m") - 2 * dot("m", "g") + dot("g", "g"))).alias("across"), F.count(F.lit(1)).cast("int").alias("n_clusters"), F.max("total").alias("total")
    )
    noise = rows.groupBy(by).agg(F.avg((F.col("c") < 0).cast("double")).alias("noise_share"))
    joined = noise.join(across, by, "left").join(sums, by, "left").join(bouldin, by, "left")
    some = (F.col("n_clusters") > 1) & (F.col("n_clusters") < F.col("total"))
    harabasz = F.col("across") / (F.col("n_clusters") - 1) / F.nullif(F.col("within") / (F.col("total") - F.col("n_clusters")), F.lit(0.0))
    measures = {"silhouette": F.col("silhouette"), "davies_bouldin": F.col("davies_bouldin"), "calinski_harabasz": harabasz}
    return joined.select(by, *[F.when(some, m).alias(name) for name, m in measures.items()], F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), "noise_share")


def average_linkage(u: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of unit vectors: the two clusters of the least mean cosine distance are merged while it is below ``threshold``."""
    n = len(u)
    groups = [[i] for i in range(n)]
    if n < 2:
        return np.zeros(n, dtype=int)
    distance = 1 - u @ u.T
    np.fill_diagonal(distance, np.inf)
    alive = np.ones(n, dtype=bool)
    while alive.sum() > 1:
        i, j = divmod(int(distance.argmin()), n)
        if distance[i, j] >= threshold:
            break
        a, b = len(groups[i]), len(groups[j])
        merged = (a * distance[i] + b * distance[j]) / (a + b)
        distance[i], distance[:, i] = merged, merged
        distance[i, i] = np.inf
        distance[j], distance[:, j] = np.inf, np.inf
        groups[i] += groups[j]
        alive[j] = False
    labels = np.empty(n, dtype=int)
    for number, i in enumerate(sorted(np.flatnonzero(alive), key=lambda i: min(groups[i]))):
        labels[groups[i]] = number
    return labels


def cluster_groups(df: DataFrame, by: list[str], key: str, vector: str, method: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``by``, ``key``, ``cluster`` by a method of this module on each group; groups are pools or dimension tables, capped by the caller."""
    kinds = dict(df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        return rows[[*by, key]].assign(cluster=method(np.stack(rows[vector].to_numpy())).astype(np.int32))

    return df.select(*by, key, vector).groupBy(*by).applyInPandas(run, ", ".join(f"{b} {kinds[b]}" for b in [*by, key]) + ", cluster int")
