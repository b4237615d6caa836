"""Retrieval of stance-aware top-k lists: centroid, query, diversity and seeded random selection over a grid."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.vectors import cosine, dot, mean_vector
from disputo.operators.corpus import seeded_order
from disputo.runtime import small
from disputo.schema import DEFAULTS, Settings

POOL = ["policy", "stance"]


def constrained_pool(pool: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """The first ``size`` of every pool that have a vector; the cap comes before the vector filter.  Unknown policies have no rows."""
    return pool.where(F.col("pool_pos") < size).join(vectors.select("arg_id", "u"), "arg_id")


def centroid_scores(pool: DataFrame, size: int = DEFAULTS.vector_size, by: tuple[str, ...] = ("policy", "stance")) -> DataFrame:
    """``pool`` with ``score``, the cosine to the centroid of its group."""
    centroids = mean_vector(pool, list(by), "u", size).drop("n_vectors")
    return pool.join(small(centroids), list(by)).withColumn("score", cosine("u", "centroid")).drop("centroid")


def query_scores(pool: DataFrame, queries: DataFrame) -> DataFrame:
    """``pool`` with ``score``, the cosine to its policy's query vector (``queries``: policy, q); policies without query have no rows."""
    return pool.join(small(queries), "policy").withColumn("score", F.coalesce(cosine("u", "q"), F.lit(0.0))).drop("q")


def top_k(scored: DataFrame, k: int, by: list[str] | None = None, score: str = "score", tie: str = "arg_id") -> DataFrame:
    """The k best of each group with ``rank`` from 1; equal scores (to 9 decimals) rank by ``tie``."""
    order = W.partitionBy(*(by or POOL)).orderBy(F.desc(F.round(score, 9)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def greedy(vectors: np.ndarray, relevance: np.ndarray, k: int, lam: float) -> list[int]:
    """Maximal marginal relevance: positions in the order they are taken; equal values go to the lower position.

    The similarity to what was taken is kept up to date, so a step costs one product with the new vector.
    """
    n = len(vectors)
    if n <= k:
        return list(range(n))
    low, high = relevance.min(), relevance.max()
    relevance = np.round((relevance - low) / (high - low), 9) if high - low > 1e-12 else np.ones(n)
    taken, closest, free = [int(np.argmax(relevance))], np.full(n, -np.inf), np.ones(n, dtype=bool)
    while len(taken) < k:
        free[taken[-1]] = False
        closest = np.maximum(closest, vectors @ vectors[taken[-1]])
        value = np.where(free, np.round(lam * relevance - (1 - lam) * closest, 9), -np.inf)
        taken.append(int(np.argmax(value)))
    return taken


def mmr(pool: DataFrame, k: int, score: str = "score", lam: float = DEFAULTS.mmr_lambda, by: tuple[str, ...] = ("policy", "stance")) -> DataFrame:
    """``by``, ``arg_id``, ``rank``: k of each pool, relevant and unlike each other.

    ``pool``: by, arg_id, pool_pos, u, score.  Relevance is the score scaled to 0..1 in the pool.  A pool of at most k comes out whole, in pool
    order.  Groups are pools, whose size the caller has capped (``constrained_pool``).
    """
    names = list(by)
    kinds = dict(pool.dtypes)

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pool_pos", "arg_id"])
        order = greedy(np.stack(rows["u"].to_numpy()), rows[score].to_numpy(dtype=float), k, lam)
        out = rows.iloc[order][[*names, "arg_id"]].copy()
        out["rank"] = np.arange(1, len(order) + 1, dtype=np.int32)
        return out

    schema = ", ".join(f"{n} {kinds[n]}" for n in (*names, "arg_id")) + ", rank int"
    return pool.select(*names, "arg_id", "pool_pos", "u", score).groupBy(*names).applyInPandas(select, schema)


def seeded_random(pool: DataFrame, k: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """k of every pool in the order of a seeded hash, the same in any engine."""
    order = W.partitionBy(*POOL).orderBy(seeded_order(seed, "policy", "arg_id"), "arg_id")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def library_random(pool: DataFrame, k: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """k of every pool as ``random.Random(f"{seed}|{policy}")`` samples them, PRO first, both stances from one generator."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        generator = random.Random(f"{seed}|{rows['policy'].iloc[0]}")
        parts = []
        for stance in (1, -1):
            side = rows[rows["stance"] == stance].sort_values("pool_pos")
            chosen = generator.sample(range(len(side)), min(k, len(side)))
            part = side.iloc[chosen].copy()
            part["rank"] = np.arange(1, len(chosen) + 1, dtype=np.int32)
            parts.append(part)
        return pd.concat(parts)

    return pool.select(*POOL, "pool_pos", "arg_id").groupBy("policy").applyInPandas(draw, "policy string, stance int, pool_pos int, arg_id string, rank int")


def seeded_shuffle(pool: DataFrame, seed_text: str, least: int = 0) -> DataFrame:
    """Pools with new positions ``shuffled_pos``, shuffled by ``random.Random`` seeded with "seed_text|policy|stance"; pools of at most ``least`` keep theirs."""

    def shuffle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pool_pos")
        order = list(range(len(rows)))
        if len(rows) > least:
            random.Random(f"{seed_text}|{rows['policy'].iloc[0]}|{rows['stance'].iloc[0]}").shuffle(order)
        out = rows.iloc[order].copy()
        out["shuffled_pos"] = np.arange(len(out), dtype=np.int32)
        return out

    return pool.select(*POOL, "pool_pos", "arg_id").groupBy(*POOL).applyInPandas(shuffle, "policy string, stance int, pool_pos int, arg_id string, shuffled_pos int")


def batches(df: DataFrame, by: list[str], order: str, size: int = 30) -> DataFrame:
    """``df`` with ``batch``: 0 for the first ``size`` rows of each group, and so on."""
    return df.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1) / size).cast("int"))


def grid_top_k(pool: DataFrame, vectors: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Centroid top-k of all (pool, k) configurations in one job: pool, k, policy, stance, rank, arg_id.

    Rows are replicated once per pool size they belong to; ranks are found once per pool size, and a k is a prefix of them.
    """
    sizes = F.filter(F.array(*[F.lit(p) for p in settings.pools]), lambda p: F.col("pool_pos") < p)
    rows = pool.join(vectors.select("arg_id", "u"), "arg_id").withColumn("pool", F.explode(sizes))
    scored = centroid_scores(rows, settings.vector_size, ("pool", "policy", "stance"))
    ranked = top_k(scored, max(settings.ks), ["pool", "policy", "stance"])
    ks = F.filter(F.array(*[F.lit(k) for k in settings.ks]), lambda k: (F.col("rank") <= k) & (k <= F.col("pool")))
    return ranked.withColumn("k", F.explode(ks)).select("pool", "k", "policy", "stance", "rank", "arg_id")


def redundancy(lists: DataFrame, vectors: DataFrame, by: list[str]) -> DataFrame:
    """Mean pairwise cosine of each list, 0 for lists of fewer than two.

    From the sum of the unit vectors: (|sum|^2 - n) / (n (n - 1)), so no pair is formed.
    """
    rows = lists.join(vectors.select("arg_id", "u"), "arg_id")
    size = DEFAULTS.vector_size
    sums = mean_vector(rows, by, "u", size)
    n = F.col("n_vectors")
    pairs = (dot("centroid", "centroid") * n * n - n) / (n * (n - 1))
    return sums.select(*by, n.alias("n_items"), F.when(n > 1, pairs).otherwise(0.0).alias("redundancy"))
