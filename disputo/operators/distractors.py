"""Hardened pools: siblings, candidates, distractor copies, levels, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import slug, strip
from disputo.functions.vectors import dot, mean_vector, unit
from disputo.runtime import small
from disputo.schema import DEFAULTS, Settings


def metapolicy_siblings(policies: DataFrame) -> DataFrame:
    """(``policy``, ``sibling``): other policies of the same metapolicy; policies without one have none."""
    known = policies.where("metapolicy_id IS NOT NULL").select("policy", "metapolicy_id")
    other = known.withColumnRenamed("policy", "sibling")
    return known.join(other, "metapolicy_id").where("policy <> sibling").select("policy", "sibling")


def majority_metapolicy(arguments: DataFrame) -> DataFrame:
    """(``policy``, ``metapolicy_id``) by the majority of the policy's arguments; ties go to the smaller id."""
    counts = arguments.where("metapolicy_id IS NOT NULL").groupBy("policy", "metapolicy_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("policy").agg(F.max(F.struct("n", (-F.col("metapolicy_id")).alias("m")))["m"].alias("m"))
    return best.select("policy", (-F.col("m")).alias("metapolicy_id"))


def policy_centroids(vectors: DataFrame, size: int = DEFAULTS.vector_size) -> DataFrame:
    """(``policy``, ``centroid``): mean of the policy's unit vectors, at length 1."""
    return unit(mean_vector(vectors, ["policy"], "u", size), "centroid", "unit_centroid").select("policy", F.col("unit_centroid").alias("centroid"))


def centroid_siblings(centroids: DataFrame, n: int = DEFAULTS.sibling_policies) -> DataFrame:
    """(``policy``, ``sibling``, ``rank``): the n policies with the closest centroids.

    Policies are a dimension: the smaller side is broadcast only if its counted size allows it.
    """
    other = small(centroids.select(F.col("policy").alias("sibling"), F.col("centroid").alias("c2")))
    scored = centroids.join(other, F.col("policy") != F.col("sibling")).withColumn("cos", F.round(dot("centroid", "c2"), 9))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("policy").orderBy(F.desc("cos"), "sibling")))
    return ranked.where(F.col("rank") <= n).select("policy", "sibling", "rank")


def candidates(pool: DataFrame, siblings: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Sibling arguments of the same stance that may be copied into a policy: policy, stance, arg_id, text, u.

    ``pool``: policy, stance, arg_id, text, u.  Arguments and texts that the policy has are left out; of equal texts the one with the smallest id
    is kept.  Only arguments with text and vector are candidates.
    """
    wanted = siblings if targets is None else siblings.join(small(targets.select("policy").distinct()), "policy", "left_semi")
    usable = pool.where((strip("text") != "") & F.col("u").isNotNull()).select(F.col("policy").alias("sibling"), "stance", "arg_id", strip("text").alias("text"), "u")
    found = usable.join(small(wanted.select("policy", "sibling")), "sibling").drop("sibling")
    own_ids = pool.select("policy", "arg_id").distinct()
    own_texts = pool.select("policy", strip("text").alias("text")).distinct()
    fresh = found.join(own_ids, ["policy", "arg_id"], "left_anti").join(own_texts, ["policy", "text"], "left_anti")
    first = W.partitionBy("policy", "stance", "text").orderBy("arg_id")
    return fresh.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def nearest(found: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """The n candidates of each policy and stance closest to the policy's centroid, with ``rank`` and ``score``; all of them for n = -1."""
    scored = found.join(small(centroids), "policy").withColumn("score", F.round(dot("u", "centroid"), 9)).drop("centroid")
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("policy", "stance").orderBy(F.desc("score"), "arg_id")))
    return ranked if n < 0 else ranked.where(F.col("rank") <= n)


def drawn(found: DataFrame, n: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """n candidates of each policy and stance in the order of a seeded hash, with ``rank``: the random selection, the same in any engine."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "policy", F.col("stance").cast("string"), "arg_id"))
    order = W.partitionBy("policy", "stance").orderBy(key, "arg_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def metapolicies(policies: DataFrame, arguments: DataFrame) -> tuple[str | None, DataFrame]:
    """('policy' or 'argument' or None, (policy, metapolicy_id)): taken from the policy records if any has one, else by majority from the arguments' records."""
    own = policies.where(F.col("metapolicy_id").isNotNull()).select("policy", "metapolicy_id")
    if not own.isEmpty():
        return "policy", own
    found = majority_metapolicy(arguments)
    return (None if found.isEmpty() else "argument"), found


def copies(chosen: DataFrame) -> DataFrame:
    """Distractors: fresh ids, the target's policy and stance, flag, no PageRank, and where they come from."""
    fresh = F.concat("arg_id", F.lit("__distractor_into__"), slug("policy"))
    return chosen.select(fresh.alias("new_id"), "policy", "stance", "text", "rank", F.lit(True).alias("is_distractor"), F.lit(None).cast("double").alias("pagerank_score"), F.col("arg_id").alias("distractor_source_id"))


def hardened(pool: DataFrame, distractors: DataFrame, seed: int = DEFAULTS.seed, level: int = 0) -> DataFrame:
    """Native pools and their distractors, interleaved in seeded order: policy, stance, arg_id, is_distractor, pool_pos.

    A pool into which nothing was injected keeps its order, so level 0 is the native pool.
    """
    native = pool.select("policy", "stance", "arg_id", F.lit(False).alias("is_distractor"), F.col("pool_pos").alias("at"))
    added = distractors.select("policy", "stance", F.col("new_id").alias("arg_id"), "is_distractor", F.lit(None).cast("int").alias("at"))
    both = native.union(added)
    injected = F.max(F.col("is_distractor")).over(W.partitionBy("policy", "stance"))
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("policy"), F.col("stance").cast("string"), F.lit(str(level)), F.col("arg_id")))
    order = W.partitionBy("policy", "stance").orderBy(F.when(F.col("injected"), F.lit(0)).otherwise(F.col("at")), "drawn", "arg_id")
    return both.withColumn("injected", injected).withColumn("drawn", drawn).withColumn("pool_pos", F.row_number().over(order) - 1).select("policy", "stance", "arg_id", "is_distractor", "pool_pos")


def levels(pool: DataFrame, siblings: DataFrame, centroids: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Hardened pools of all levels in one table with ``level``; candidates are ranked once, a level is a prefix of them."""
    ranked = nearest(candidates(pool, siblings), centroids, -1)
    out = None
    for level in settings.levels:
        chosen = ranked.where(F.lit(False)) if level == 0 else ranked if level < 0 else ranked.where(F.col("rank") <= level)
        one = hardened(pool, copies(chosen), settings.seed, level).withColumn("level", F.lit(level))
        out = one if out is None else out.union(one)
    return out


def rank_floor(df: DataFrame, value: str = "pagerank_score") -> DataFrame:
    """``df`` with missing scores set to the smallest native score of the same policy and stance."""
    floor = F.min(F.when(~F.col("is_distractor"), F.col(value))).over(W.partitionBy("policy", "stance"))
    return df.withColumn(value, F.coalesce(value, floor))


def injection_stats(pool: DataFrame, found: DataFrame, injected: DataFrame, base_rate: float = 0.577) -> DataFrame:
    """Per policy: native, candidate and injected arguments and the lowest base rate after injection."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("policy").agg(F.count(F.lit(1)).alias(name))

    joined = counted(pool, "n_native").join(counted(found, "n_candidates"), "policy", "left").join(counted(injected, "n_injected"), "policy", "left").fillna(0)
    return joined.withColumn("projected_base_rate", base_rate * F.col("n_native") / (F.col("n_native") + F.col("n_injected")))


def edge_audit(distractors: DataFrame, edges: DataFrame) -> DataFrame:
    """Per policy: distractors, and how many have a contradiction, an equivalence, any of both, in per cent.  ``edges``: rel, a, b; ``distractors``: policy, arg_id."""
    ends = edges.select("rel", F.col("a").alias("arg_id")).union(edges.select("rel", "b")).groupBy("arg_id").agg(F.max(F.col("rel") == "CONTRADICTS").alias("contra"), F.max(F.col("rel") == "EQUIVALENT").alias("equiv"))
    flagged = distractors.join(ends, "arg_id", "left").fillna(False, ["contra", "equiv"])
    either = F.col("contra") | F.col("equiv")
    return flagged.groupBy("policy").agg(F.count(F.lit(1)).alias("n_distractors"), F.count_if("contra").alias("n_contra"), F.count_if("equiv").alias("n_equiv"), F.count_if(either).alias("n_any"), F.round(100 * F.avg(either.cast("double")), 6).alias("pct_any"))


def tightness(vectors: DataFrame, by: list[str], size: int = DEFAULTS.vector_size) -> DataFrame:
    """Mean pairwise cosine of distractors and natives of each group and their ratio; NULL below two of either.  ``vectors``: by, u, is_distractor."""
    sums = mean_vector(vectors, [*by, "is_distractor"], "u", size)
    n = F.col("n_vectors")
    mean = F.when(n > 1, (dot("centroid", "centroid") * n * n - n) / (n * (n - 1)))
    wide = sums.withColumn("m", mean).groupBy(*by).agg(F.max(F.when(F.col("is_distractor"), F.col("m"))).alias("distractor_cosine"), F.max(F.when(~F.col("is_distractor"), F.col("m"))).alias("native_cosine"))
    return wide.withColumn("ratio", F.col("distractor_cosine") / F.nullif("native_cosine", F.lit(0.0)))
