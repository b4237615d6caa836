"""The retrieval sweep: every system's lists for all (pool, k) configurations, and their evaluation by configuration and system."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import gain
from disputo.functions.vectors import cosine, dot, mean_vector
from disputo.operators import graph, retrieval
from disputo.operators.metrics import RELEVANT
from disputo.runtime import cut, small
from disputo.schema import DEFAULTS, Settings

SYSTEMS = ("System A", "System B", "Baseline A", "Baseline B", "SimpleRAG")
CONFIG = ["pool", "k", "system"]
LIST = [*CONFIG, "policy", "stance"]


def _sizes(pools: tuple[int, ...], position: Column) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in pools]), lambda p: position < p)


def _prefixes(ranked: DataFrame, settings: Settings, system: str) -> DataFrame:
    """Lists of all k from rows (pool, policy, stance, arg_id, rank) of which every list is a prefix."""
    ks = F.filter(F.array(*[F.lit(k) for k in settings.ks]), lambda k: (F.col("rank") <= k) & (k <= F.col("pool")))
    rows = ranked.withColumn("k", F.explode(ks)).withColumn("system", F.lit(system))
    return rows.select(*LIST, F.col("rank").cast("int").alias("rank"), "arg_id")


def mmr_lists(rows: DataFrame, settings: Settings, system: str) -> DataFrame:
    """Diverse lists of all k at once: the steps of the largest k contain those of the smaller ones; a pool of at most k comes out whole, in its order.

    ``rows``: pool, policy, stance, arg_id, pool_pos, u, score.  A group is one pool, whose size the configuration caps.
    """
    lam, ks = settings.mmr_lambda, settings.ks

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pool_pos", "arg_id"])
        size, n = int(group["pool"].iloc[0]), len(group)
        steps = min(max(ks), n - 1)
        order = retrieval.greedy(np.stack(group["u"].to_numpy()), group["score"].to_numpy(dtype=float), steps, lam) if steps > 0 else []
        parts = []
        for k in (k for k in ks if k <= size):
            part = group.iloc[list(range(n)) if n <= k else order[:k]][["pool", "policy", "stance", "arg_id"]].copy()
            part["k"], part["rank"] = np.int32(k), np.arange(1, len(part) + 1, dtype=np.int32)
            parts.append(part)
        return pd.concat(parts)[["pool", "k", "policy", "stance", "rank", "arg_id"]]

    chosen = rows.select("pool", "policy", "stance", "arg_id", "pool_pos", "u", "score").groupBy("pool", "policy", "stance")
    return chosen.applyInPandas(select, "pool int, k int, policy string, stance int, rank int, arg_id string").withColumn("system", F.lit(system)).select(*LIST, "rank", "arg_id")


def sweep(pool: DataFrame, vectors: DataFrame, edges: DataFrame, ranks: DataFrame, queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``pool``, ``k``, ``system``, ``policy``, ``stance``, ``rank``, ``arg_id``: the lists of all systems and configurations.

    System A: diverse, by closeness to the centroid.  System B: diverse, by PageRank, over pools expanded by one contradiction hop.  Baseline A: closest to
    the centroid.  Baseline B: in seeded order.  SimpleRAG: closest to the policy's query vector, whatever the pool.
    ``pool``: policy, stance, arg_id, pool_pos; ``edges``: a, b, edge_pos; ``ranks``: arg_id, score; ``queries``: policy, q.  Every input is read once per
    system; rows are replicated by pool size only, and a list's k are prefixes where the system allows it.
    """
    usable = vectors.select("arg_id", "u")
    capped = pool.where(F.col("pool_pos") < max(settings.pools)).join(usable, "arg_id").withColumn("pool", F.explode(_sizes(settings.pools, F.col("pool_pos"))))
    by = ("pool", "policy", "stance")
    scored = cut(retrieval.centroid_scores(capped, settings.vector_size, by))
    closest = retrieval.top_k(scored, max(settings.ks), list(by))
    drawn = F.md5(F.concat_ws("|", F.lit(str(settings.seed)), "policy", "arg_id"))
    random = scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(drawn, "arg_id"))).where(F.col("rank") <= max(settings.ks))
    expanded = None
    for size in settings.pools:
        one = graph.one_hop(pool, edges, size).withColumn("pool", F.lit(size))
        expanded = one if expanded is None else expanded.union(one)
    hopped = expanded.withColumnRenamed("pos", "pool_pos").join(usable, "arg_id").join(ranks.select("arg_id", "score"), "arg_id", "left").fillna(0.0, ["score"])
    asked = retrieval.top_k(retrieval.query_scores(pool.join(usable, "arg_id"), queries), max(settings.ks))
    everywhere = asked.withColumn("pool", F.explode(F.array(*[F.lit(p) for p in settings.pools])))
    parts = [
        mmr_lists(scored, settings, SYSTEMS[0]), mmr_lists(hopped, settings, SYSTEMS[1]),
        _prefixes(closest, settings, SYSTEMS[2]), _prefixes(random, settings, SYSTEMS[3]), _prefixes(everywhere, settings, SYSTEMS[4]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def list_metrics(lists: DataFrame, matches: DataFrame, truth: DataFrame, ks: tuple[int, ...], manifest: DataFrame) -> DataFrame:
    """One row per list: ndcg, ndcg_lin, precision, recall, mean_rel, ild, distractor_rate, exact, semantic and none shares.

    ``matches``: policy, stance, arg_id, grade, match, match_text, u - an argument is matched once, whatever the number of lists that hold it.
    ``truth``: policy, stance, text, grade (one per text); ``manifest``: policy, stance, arg_id of distractors.
    """
    pools = ["policy", "stance"]
    flagged = matches.join(manifest.select(*pools, "arg_id", F.lit(1.0).alias("injected")).distinct(), [*pools, "arg_id"], "left")
    rows = lists.join(flagged, [*pools, "arg_id"])
    relevant = F.col("grade") >= RELEVANT
    log = F.log2(F.col("rank") + 1.0)
    sums = rows.groupBy(*LIST).agg(
        F.sum(gain("grade") / log).alias("dcg"), F.sum(gain("grade", False) / log).alias("dcg_lin"), F.avg(relevant.cast("double")).alias("precision"),
        F.countDistinct(F.when(relevant, F.col("match_text"))).alias("n_hit"), (F.sum("grade") / F.max("k")).alias("mean_rel"),
        F.avg(F.coalesce("injected", F.lit(0.0))).alias("distractor_rate"), *[F.avg((F.col("match") == m).cast("double")).alias(m) for m in ("exact", "semantic", "none")],
    )
    n = F.col("n_vectors")
    spread = mean_vector(rows.where("u IS NOT NULL"), LIST, "u", DEFAULTS.vector_size)
    spread = spread.select(*LIST, F.when(n > 1, 1 - (dot("centroid", "centroid") * n * n - n) / (n * (n - 1))).otherwise(0.0).alias("ild"))
    order = W.partitionBy(*pools).orderBy(F.desc("grade"), "text")
    first = truth.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(ks))
    within = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("place") <= k)
    place = F.log2(F.col("place") + 1.0)
    ideal = first.withColumn("k", F.explode(within)).groupBy(*pools, "k").agg(F.sum(gain("grade") / place).alias("idcg"), F.sum(gain("grade", False) / place).alias("idcg_lin"))
    totals = truth.groupBy(*pools).agg(F.count_if(relevant).alias("n_relevant"))
    joined = sums.join(spread, LIST, "left").join(ideal, [*pools, "k"], "left").join(totals, pools, "left")

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)), F.lit(0.0))

    return joined.select(
        *LIST, share("dcg", "idcg").alias("ndcg"), share("dcg_lin", "idcg_lin").alias("ndcg_lin"), "precision", (F.col("n_hit") / F.nullif("n_relevant", F.lit(0))).alias("recall"),
        "mean_rel", F.coalesce("ild", F.lit(0.0)).alias("ild"), "distractor_rate", "exact", "semantic", "none",
    )


METRICS = ("ndcg", "ndcg_lin", "precision", "recall", "mean_rel", "ild", "distractor_rate", "exact", "semantic", "none")


def by_system(each: DataFrame) -> DataFrame:
    """Mean of every metric over the policies by configuration, system and stance, and of nDCG the population std; NULLs do not count."""
    means = [F.avg(m).alias(f"{m}_mean") for m in METRICS]
    return each.groupBy(*CONFIG, "stance").agg(F.count(F.lit(1)).alias("n_policies"), *means, F.stddev_pop("ndcg").alias("ndcg_std"))


def entailed_by(lists: DataFrame, pool: DataFrame, entailments: DataFrame) -> DataFrame:
    """``system``, ``policy``, ``stance``, ``arg_id``, ``entail``: how strongly what a system listed for a policy entails each argument of the policy.

    ``entailments``: premise, hypothesis, entail.  A listed argument entails itself with 1; NULL where nothing listed speaks for the argument.
    Only scored pairs are joined, so the work follows the pairs.
    """
    listed = lists.select("system", "policy", F.col("arg_id").alias("premise"))
    own = listed.select("system", "policy", F.col("premise").alias("arg_id"), F.lit(1.0).alias("entail"))
    spoken = listed.join(entailments, "premise").select("system", "policy", F.col("hypothesis").alias("arg_id"), "entail")
    best = own.union(spoken).groupBy("system", "policy", "arg_id").agg(F.max("entail").alias("entail"))
    everyone = pool.select("policy", "stance", "arg_id").join(small(lists.select("system", "policy").distinct()), "policy")
    return everyone.join(best, ["system", "policy", "arg_id"], "left").select("system", "policy", "stance", "arg_id", "entail")


def pro_ratio(df: DataFrame, by: list[str], bar: float = 0.4) -> DataFrame:
    """PRO share of a group's arguments entailed above ``bar`` (the share of all its arguments where none is), and its distance from that share."""
    side, over = F.col("stance") == 1, F.coalesce(F.col("entail") > bar, F.lit(False))
    counts = df.groupBy(*by).agg(F.avg(side.cast("double")).alias("source"), F.count_if(over).alias("n"), F.count_if(over & side).alias("pro"))
    ratio = F.when(F.col("n") > 0, F.col("pro") / F.col("n")).otherwise(F.col("source"))
    return counts.select(*by, ratio.alias("pro_ratio"), F.abs(ratio - F.col("source")).alias("distortion"))


def reference_cosine(candidates: DataFrame, references: DataFrame, by: str = "policy") -> DataFrame:
    """Every candidate (system, by, v) with ``score``, the cosine with its reference (by, r); candidates without a reference are left out."""
    return candidates.join(small(references.select(by, "r")), by).select("system", by, cosine("v", "r").alias("score"))
