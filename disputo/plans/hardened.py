"""Queries on hardened pools and on clusterings of policies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.operators import distractors, ml
from disputo.plans._views import ARGS, EDGES, POOL, PV, VECS, Registry, arguments, edges, policy_table, pool, pool_vectors, rounded, stripped, vectors
from disputo.plans.graphs import _RANKS, ranks
from disputo.runtime import cut
from disputo.schema import Settings

query = Registry()
_DIM = "dim AS (SELECT policy, any_value(metapolicy_id) AS metapolicy_id FROM policies WHERE policy IS NOT NULL GROUP BY 1), sib AS (SELECT a.policy, b.policy AS sibling FROM dim a JOIN dim b USING (metapolicy_id) WHERE a.policy <> b.policy)"
_CENT = """pm AS (SELECT policy, i, avg(x) AS m FROM (SELECT policy, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM pv) GROUP BY ALL), pl AS (SELECT policy, sqrt(sum(m * m)) AS n FROM pm GROUP BY 1), cent AS (SELECT policy, list(m / n ORDER BY i) AS c FROM pm JOIN pl USING (policy) GROUP BY 1)"""
_CAND = f"""own AS (SELECT DISTINCT policy, {stripped('text')} AS text FROM pool), cand AS (SELECT s.policy, p.stance, p.arg_id, {stripped('p.text')} AS text, p.u FROM pv p JOIN sib s ON s.sibling = p.policy WHERE {stripped('p.text')} <> '' AND NOT EXISTS (SELECT 1 FROM own o WHERE o.policy = s.policy AND o.text = {stripped('p.text')})
  QUALIFY row_number() OVER (PARTITION BY s.policy, p.stance, {stripped('p.text')} ORDER BY p.arg_id) = 1), ranked AS (SELECT c.*, round(list_dot_product(u, cent.c), 9) AS score, row_number() OVER (PARTITION BY c.policy, stance ORDER BY round(list_dot_product(u, cent.c), 9) DESC, arg_id)::INTEGER AS rank FROM cand c JOIN cent USING (policy))"""
SETTINGS = Settings()


def hard_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pools with vectors where there are any, siblings, centroids)."""
    rows = cut(pool(spark, d, text=True).join(vectors(spark, d).select("arg_id", "u"), "arg_id", "left"))
    return rows, distractors.metapolicy_siblings(policy_table(spark, d)), distractors.policy_centroids(rows.where("u IS NOT NULL"))


@query(f"WITH {_DIM} SELECT policy, sibling FROM sib")
def hard_metapolicy_siblings(spark: SparkSession, d: str) -> DataFrame:
    return distractors.metapolicy_siblings(policy_table(spark, d))


@query(f"""WITH {ARGS}, {_DIM}, x AS (SELECT policy, m, count(*) AS n FROM (SELECT a.policy, dim.metapolicy_id AS m FROM args a JOIN dim USING (policy)) WHERE m IS NOT NULL GROUP BY ALL) SELECT policy, m AS metapolicy_id FROM x QUALIFY row_number() OVER (PARTITION BY policy ORDER BY n DESC, m) = 1""")
def hard_majority_metapolicy(spark: SparkSession, d: str) -> DataFrame:
    """Each policy's metapolicy by majority of its arguments."""
    rows = arguments(spark, d, "policy").join(policy_table(spark, d).select("policy", "metapolicy_id"), "policy")
    return distractors.majority_metapolicy(rows)


@query(f"""WITH {PV}, {_CENT} SELECT a.policy, b.policy AS sibling, row_number() OVER (PARTITION BY a.policy ORDER BY round(list_dot_product(a.c, b.c), 9) DESC, b.policy)::INTEGER AS rank FROM cent a JOIN cent b ON a.policy <> b.policy QUALIFY rank <= 4""")
def hard_centroid_siblings(spark: SparkSession, d: str) -> DataFrame:
    """The four policies with the closest centroids."""
    return distractors.centroid_siblings(distractors.policy_centroids(pool_vectors(spark, d)))


@query(f"""WITH {PV}, {_DIM}, {_CENT}, {_CAND} SELECT policy, stance, count(*) AS n FROM cand GROUP BY ALL""")
def hard_candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    rows, siblings, _ = hard_parts(spark, d)
    return distractors.candidates(rows, siblings).groupBy("policy", "stance").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PV}, {_DIM}, {_CENT}, {_CAND} SELECT policy, stance, arg_id || '__distractor_into__' || trim(regexp_replace(lower(policy), '[^a-z0-9]+', '_', 'g'), '_') AS new_id, arg_id AS distractor_source_id, rank FROM ranked WHERE rank <= 100""")
def hard_distractors(spark: SparkSession, d: str) -> DataFrame:
    """The hundred sibling arguments closest to each policy's centroid, copied into its pools."""
    rows, siblings, centroids = hard_parts(spark, d)
    return distractors.copies(distractors.nearest(distractors.candidates(rows, siblings), centroids, 100)).select("policy", "stance", "new_id", "distractor_source_id", "rank")


@query(f"""WITH {PV}, {_DIM}, {_CENT}, {_CAND}, lv AS (SELECT unnest({list(SETTINGS.levels)}) AS level), inj AS (SELECT level, policy, stance, arg_id || '__distractor_into__' || trim(regexp_replace(lower(policy), '[^a-z0-9]+', '_', 'g'), '_') AS arg_id FROM ranked, lv WHERE level < 0 OR rank <= level),
u2 AS (SELECT level, policy, stance, arg_id, false AS is_distractor, pool_pos AS at_pos FROM pool, lv UNION ALL SELECT level, policy, stance, arg_id, true, NULL FROM inj), f AS (SELECT *, bool_or(is_distractor) OVER (PARTITION BY level, policy, stance) AS injected FROM u2)
SELECT level, policy, stance, arg_id, is_distractor, (row_number() OVER (PARTITION BY level, policy, stance ORDER BY CASE WHEN injected THEN 0 ELSE at_pos END, md5('42|' || policy || '|' || stance || '|' || level || '|' || arg_id), arg_id) - 1)::INTEGER AS pool_pos FROM f""")
def hard_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pools of all levels: native, 50, 100 and 200 distractors a side, all of them."""
    rows, siblings, centroids = hard_parts(spark, d)
    return distractors.levels(rows, siblings, centroids, SETTINGS).select("level", "policy", "stance", "arg_id", "is_distractor", "pool_pos")


@query(f"""WITH {PV}, {_DIM}, {_CENT}, {_CAND}, n AS (SELECT policy, count(*) AS n_native FROM pool GROUP BY 1), c AS (SELECT policy, count(*) AS n_candidates FROM cand GROUP BY 1), i AS (SELECT policy, count(*) AS n_injected FROM ranked WHERE rank <= 10 GROUP BY 1)
SELECT policy, n_native, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_injected, 0) AS n_injected, round(0.577::DOUBLE * n_native / (n_native + coalesce(n_injected, 0)), 6) AS projected_base_rate FROM n LEFT JOIN c USING (policy) LEFT JOIN i USING (policy)""")
def hard_injection_stats(spark: SparkSession, d: str) -> DataFrame:
    rows, siblings, centroids = hard_parts(spark, d)
    found = distractors.candidates(rows, siblings)
    return rounded(distractors.injection_stats(rows, found, distractors.nearest(found, centroids, 10)))


@query(f"""WITH {POOL}, {EDGES}, e AS (SELECT rel, a AS arg_id FROM edges WHERE a IS NOT NULL UNION ALL SELECT rel, b FROM edges WHERE a IS NOT NULL), x AS (SELECT arg_id, bool_or(rel = 'CONTRADICTS') AS c, bool_or(rel = 'EQUIVALENT') AS q FROM e GROUP BY 1)
SELECT policy, count(*) AS n_distractors, count(*) FILTER (coalesce(c, false)) AS n_contra, count(*) FILTER (coalesce(q, false)) AS n_equiv, count(*) FILTER (coalesce(c, false) OR coalesce(q, false)) AS n_any,
 round(100 * avg((coalesce(c, false) OR coalesce(q, false))::INTEGER), 6) AS pct_any FROM pool LEFT JOIN x USING (arg_id) WHERE is_distractor GROUP BY 1""")
def hard_edge_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many distractors of each policy have mined edges."""
    return rounded(distractors.edge_audit(pool(spark, d).where("is_distractor").select("policy", "arg_id"), edges(spark, d).where("a IS NOT NULL").select("rel", "a", "b")))


@query(f"""WITH {PV}, dm AS (SELECT policy, metapolicy_id FROM policies), t AS (SELECT dm.metapolicy_id, is_distractor, arg_id, u FROM pv JOIN dm USING (policy)), p AS (SELECT a.metapolicy_id, a.is_distractor, avg(list_dot_product(a.u, b.u)) AS m FROM t a JOIN t b ON a.metapolicy_id = b.metapolicy_id AND a.is_distractor = b.is_distractor AND a.arg_id < b.arg_id GROUP BY ALL),
g AS (SELECT DISTINCT metapolicy_id FROM t) SELECT metapolicy_id, round(max(CASE WHEN is_distractor THEN m END), 6) AS distractor_cosine, round(max(CASE WHEN NOT is_distractor THEN m END), 6) AS native_cosine, round(max(CASE WHEN is_distractor THEN m END) / nullif(max(CASE WHEN NOT is_distractor THEN m END), 0), 6) AS ratio FROM g LEFT JOIN p USING (metapolicy_id) GROUP BY 1""")
def hard_tightness(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine among distractors against that among natives, per metapolicy."""
    rows = pool_vectors(spark, d).join(policy_table(spark, d).select("policy", "metapolicy_id"), "policy")
    return rounded(distractors.tightness(rows, ["metapolicy_id"]))


@query(f"""WITH RECURSIVE {POOL}, {_RANKS}, x AS (SELECT p.*, CASE WHEN NOT p.is_distractor THEN round(r.rank, 8) END AS own FROM pool p LEFT JOIN r ON r.id = p.arg_id) SELECT arg_id, round(coalesce(own, min(own) OVER (PARTITION BY policy, stance)), 8) AS pagerank_score FROM x""")
def hard_rank_floor(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of distractors set to the smallest native rank of their pool."""
    scores = ranks(spark, d).select(F.col("id").alias("arg_id"), F.round("rank", 8).alias("score"))
    rows = pool(spark, d).join(scores, "arg_id", "left").withColumn("pagerank_score", F.when(~F.col("is_distractor"), F.col("score")))
    return distractors.rank_floor(rows).select("arg_id", "pagerank_score")


@query(f"""WITH {PV}, {_DIM}, {_CENT}, {_CAND} SELECT policy, stance, arg_id AS distractor_source_id, row_number() OVER (PARTITION BY policy, stance ORDER BY md5('42|' || policy || '|' || stance || '|' || arg_id), arg_id)::INTEGER AS rank FROM cand QUALIFY rank <= 50""")
def hard_random_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Fifty candidates of each policy and stance, drawn instead of chosen by closeness."""
    rows, siblings, _ = hard_parts(spark, d)
    return distractors.drawn(distractors.candidates(rows, siblings), 50).select("policy", "stance", F.col("arg_id").alias("distractor_source_id"), "rank")


def reduced_policies(spark: SparkSession, d: str, k: int = 20) -> tuple[DataFrame, list[float]]:
    centroids = distractors.policy_centroids(pool_vectors(spark, d))
    reduced, shares = ml.pca(centroids, "centroid", 64, k)
    return reduced.select("policy", "reduced"), list(shares)


@query()
def ml_policy_components(spark: SparkSession, d: str) -> DataFrame:
    """Leading component of every policy's centroid (PCA, tested against numpy)."""
    reduced, _ = reduced_policies(spark, d)
    return rounded(reduced.select("policy", F.col("reduced")[0].alias("first"), F.col("reduced")[1].alias("second")))


@query()
def ml_cluster_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Quality of k-means for several k on reduced centroids of the policies, and of the metapolicies themselves."""
    reduced, _ = reduced_policies(spark, d)
    reduced = cut(reduced)
    means = ml.k_means(reduced, "reduced", [5, 8, 10]).select(F.format_string("kmeans_%d", "k").alias("method"), "reduced", "cluster")
    given = policy_table(spark, d).select("policy", F.coalesce("metapolicy_id", F.lit(-1)).alias("cluster"))
    named = reduced.join(given, "policy").select(F.lit("metapolicies").alias("method"), "reduced", "cluster")
    return rounded(ml.cluster_report(cut(means.union(named)), "method", "reduced", 20))


@query()
def ml_subtopics(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage subtopics (distance 0.15) of each pool's first 200 arguments (the pool size is the feature)."""
    rows = pool_vectors(spark, d).where("pool_pos < 200")
    return ml.cluster_groups(rows, ["policy", "stance"], "arg_id", "u", partial(ml.average_linkage, threshold=0.15))


QUERIES, ORACLES = query.queries, query.oracles
