"""Relation queries: candidates, adjudication, conflicts, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.operators import relations
from disputo.plans._views import ARGS, EDGES, POOL, PV, VECS, Registry, arguments, edges, policy_table, pool, pool_vectors, rounded, vectors
from disputo.sources import files

query = Registry()
FLOORS, TAUS = (0.70, 0.75, 0.80, 0.85), (0.5, 0.6, 0.7, 0.8, 0.9)
_CONTRA = f"""{PV}, contra AS (SELECT p.policy, p.arg_id AS source, c.arg_id AS target, list_dot_product(p.u, c.u) AS cosine FROM pv p JOIN pv c ON p.policy = c.policy AND p.stance = 1 AND c.stance = -1 WHERE list_dot_product(p.u, c.u) >= 0.7)"""
_EQUIV = """equiv AS (SELECT a.policy, a.arg_id AS source, b.arg_id AS target, list_dot_product(a.u, b.u) AS cosine FROM pv a JOIN pv b ON a.policy = b.policy AND a.stance = b.stance AND a.pool_pos < b.pool_pos WHERE list_dot_product(a.u, b.u) >= 0.75)"""
_FLAGS = "flags AS (SELECT arg_id, coalesce(is_distractor, false) AS dd FROM args)"
_SCORED = f"""{EDGES}, scored AS (SELECT rel, a AS source, b AS target, cosine, mined_at, policy, CASE rel WHEN 'CONTRADICTS' THEN least(contra_fwd, contra_bwd) ELSE least(entail_fwd, entail_bwd) END AS score,
  contra_fwd, contra_bwd, entail_fwd, entail_bwd, CASE WHEN method = 'nli+llm' THEN confidence >= 0.65 END AS verdict FROM edges WHERE a IS NOT NULL AND rel IN ('CONTRADICTS', 'EQUIVALENT')),
complete AS (SELECT * FROM scored WHERE CASE rel WHEN 'CONTRADICTS' THEN contra_fwd IS NOT NULL AND contra_bwd IS NOT NULL ELSE entail_fwd IS NOT NULL AND entail_bwd IS NOT NULL END),
adj AS (SELECT *, CASE rel WHEN 'CONTRADICTS' THEN 0.9 ELSE 0.6 END AS tau, coalesce(score >= 0.4 AND score < 0.7 AND verdict IS NOT NULL, false) AS judged FROM complete),
accepted AS (SELECT rel, source, target, policy, mined_at, score AS confidence, CASE WHEN judged THEN 'nli+llm' ELSE 'nli' END AS method FROM adj WHERE CASE WHEN judged THEN verdict ELSE score >= tau END)"""
_BEST = """best AS (SELECT rel, least(source, target) AS pair_a, greatest(source, target) AS pair_b, max(confidence) AS confidence FROM accepted WHERE source <> target GROUP BY ALL)"""


def scored_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d).where(F.col("a").isNotNull() & F.col("rel").isin("CONTRADICTS", "EQUIVALENT"))
    score = F.when(F.col("rel") == "CONTRADICTS", relations.bidirectional("contra_fwd", "contra_bwd")).otherwise(relations.bidirectional("entail_fwd", "entail_bwd"))
    verdict = F.when(F.col("method") == "nli+llm", F.col("confidence") >= 0.65)
    return rows.select("rel", F.col("a").alias("source"), F.col("b").alias("target"), "cosine", "policy", "mined_at", score.alias("score"), verdict.alias("verdict"))


def accepted_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_edges(spark, d)
    contra = relations.adjudicate(rows.where("rel = 'CONTRADICTS'"), "score", 0.9, "verdict")
    return contra.union(relations.adjudicate(rows.where("rel = 'EQUIVALENT'"), "score", 0.6, "verdict"))


@query(f"WITH {_CONTRA} SELECT policy, source, target, round(cosine, 6) AS cosine FROM contra")
def relations_contradiction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.contradiction_candidates(pool_vectors(spark, d)))


@query(f"WITH {PV}, {_EQUIV} SELECT policy, source, target, round(cosine, 6) AS cosine FROM equiv")
def relations_equivalence_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.equivalence_candidates(pool_vectors(spark, d)))


@query(f"""WITH {PV}, dim AS (SELECT policy, metapolicy_id, row_number() OVER (PARTITION BY metapolicy_id ORDER BY policy) AS policy_pos FROM policies WHERE metapolicy_id IS NOT NULL), m AS (SELECT * FROM pv JOIN dim USING (policy))
SELECT a.metapolicy_id, a.arg_id AS source, b.arg_id AS target, round(list_dot_product(a.u, b.u), 6) AS cosine FROM m a JOIN m b ON a.metapolicy_id = b.metapolicy_id AND a.policy_pos < b.policy_pos WHERE list_dot_product(a.u, b.u) >= 0.48""")
def relations_coherence_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different policies of one metapolicy (floor 0.48: these vectors have none above 0.7)."""
    order = W.partitionBy("metapolicy_id").orderBy("policy")
    dimension = policy_table(spark, d).where("metapolicy_id IS NOT NULL").withColumn("policy_pos", F.row_number().over(order)).select("policy", "metapolicy_id", "policy_pos")
    return rounded(relations.coherence_candidates(pool_vectors(spark, d).join(F.broadcast(dimension), "policy"), 0.48))


@query(f"""WITH {PV}, {_EQUIV}, {_FLAGS} SELECT e.policy, e.source, e.target, round(e.cosine, 6) AS cosine FROM equiv e JOIN flags f ON f.arg_id = e.source JOIN flags g ON g.arg_id = e.target WHERE NOT (f.dd AND g.dd)""")
def relations_candidates_without_distractor_pairs(spark: SparkSession, d: str) -> DataFrame:
    kept = relations.without_distractor_pairs(relations.equivalence_candidates(pool_vectors(spark, d)), arguments(spark, d, "is_distractor"))
    return rounded(kept.select("policy", "source", "target", "cosine"))


@query(f"""WITH {ARGS}, {EDGES}, {_FLAGS} SELECT e.rel, CASE WHEN f.dd AND g.dd THEN 'distractor-distractor' WHEN f.dd OR g.dd THEN 'native-distractor' ELSE 'native-native' END AS pair_type, count(*) AS n
FROM (SELECT rel, a, b FROM edges WHERE a IS NOT NULL) e JOIN flags f ON f.arg_id = e.a JOIN flags g ON g.arg_id = e.b GROUP BY ALL""")
def relations_pair_types(spark: SparkSession, d: str) -> DataFrame:
    """Edges between known arguments by relation and kind of pair."""
    ended = edges(spark, d).where("a IS NOT NULL").select("rel", F.col("a").alias("source"), F.col("b").alias("target"))
    known = arguments(spark, d, "is_distractor").select("arg_id", "is_distractor")
    for end in ("source", "target"):
        ended = ended.join(known.select(F.col("arg_id").alias(end)), end, "left_semi")
    flagged = relations.flag_distractor_pairs(ended, known)
    return flagged.groupBy("rel", relations.pair_type().alias("pair_type")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT nullif(trim(source), '') AS s, nullif(trim(target), '') AS t, nullif(trim(arg1_id), '') AS a, nullif(trim(arg2_id), '') AS b FROM relations_generated)
SELECT count(*) FILTER (s IS NOT NULL AND t IS NOT NULL) AS n_source_target, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_arg1_arg2,
count(*) FILTER (NOT (s IS NOT NULL AND t IS NOT NULL) AND NOT (a IS NOT NULL AND b IS NOT NULL)) AS n_neither, 'source/target' AS majority FROM e""")
def relations_end_conventions(spark: SparkSession, d: str) -> DataFrame:
    return relations.convention(edges(spark, d))


@query(f"""WITH {EDGES} SELECT DISTINCT a, b FROM edges WHERE rel = 'EQUIVALENT' AND a IS NOT NULL""")
def relations_edge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("rel = 'EQUIVALENT' AND a IS NOT NULL").select("a", "b").distinct()


@query(f"""WITH {_SCORED} SELECT rel, method, count(*) AS n, round(avg(confidence), 6) AS confidence FROM (SELECT rel, method, round(confidence, 4) AS confidence FROM accepted) GROUP BY ALL""")
def relations_adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """Accepted edges by relation and by who decided."""
    return rounded(accepted_edges(spark, d).groupBy("rel", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence")))


@query(f"""WITH {_SCORED}, {_BEST} SELECT rel, pair_a, pair_b, round(confidence, 4) AS confidence FROM best""")
def relations_best_per_pair(spark: SparkSession, d: str) -> DataFrame:
    return relations.best_per_pair(accepted_edges(spark, d), ["mined_at"], "rel").select("rel", "pair_a", "pair_b", "confidence")


@query(f"""WITH {_SCORED}, {_BEST}, c AS (SELECT pair_a, pair_b, round(confidence, 4) AS c FROM best WHERE rel = 'CONTRADICTS'), e AS (SELECT pair_a, pair_b, round(confidence, 4) AS e FROM best WHERE rel = 'EQUIVALENT')
SELECT pair_a, pair_b, CASE WHEN e IS NULL OR c >= e THEN 'CONTRADICTS' ELSE 'EQUIVALENT' END AS rel, CASE WHEN e IS NULL OR c >= e THEN c ELSE e END AS confidence FROM c FULL JOIN e USING (pair_a, pair_b)""")
def relations_resolved(spark: SparkSession, d: str) -> DataFrame:
    """One relation per pair."""
    best = relations.best_per_pair(accepted_edges(spark, d), ["mined_at"], "rel")
    return relations.resolve(best.where("rel = 'CONTRADICTS'"), best.where("rel = 'EQUIVALENT'"))


@query(f"""WITH {_SCORED}, {_BEST} SELECT count(*) AS n_in_both FROM (SELECT pair_a, pair_b FROM best WHERE rel = 'CONTRADICTS' INTERSECT SELECT pair_a, pair_b FROM best WHERE rel = 'EQUIVALENT')""")
def relations_in_both(spark: SparkSession, d: str) -> DataFrame:
    best = relations.best_per_pair(accepted_edges(spark, d), ["mined_at"], "rel")
    keys = [best.where(F.col("rel") == r).select("pair_a", "pair_b") for r in ("CONTRADICTS", "EQUIVALENT")]
    return keys[0].intersect(keys[1]).agg(F.count(F.lit(1)).alias("n_in_both"))


_CELLS = " UNION ALL ".join(f"SELECT {f} AS floor, {t} AS tau" for f in FLOORS for t in TAUS)


@query(f"""WITH {_SCORED}, {POOL}, possible AS (SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) FILTER (stance = 1) * count(*) FILTER (stance = -1) AS n FROM pool GROUP BY policy)), cells AS ({_CELLS})
SELECT floor::DOUBLE AS floor, tau::DOUBLE AS tau, count(*) FILTER (cosine >= floor AND score >= tau) AS kept, round(count(*) FILTER (cosine >= floor AND score >= tau) / any_value(n)::DOUBLE, 6) AS share FROM complete, cells, possible WHERE rel = 'CONTRADICTS' GROUP BY ALL""")
def relations_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Kept contradictions over a grid of floors and thresholds."""
    sides = pool(spark, d).groupBy("policy").agg((F.count_if(F.col("stance") == 1) * F.count_if(F.col("stance") == -1)).alias("n"))
    possible = sides.agg(F.sum("n").alias("n_possible"))
    return rounded(relations.saturation(scored_edges(spark, d).where("rel = 'CONTRADICTS'"), possible, FLOORS, TAUS))


@query("""WITH v AS (SELECT cosine, row_number() OVER (ORDER BY cosine) - 1 AS pos, count(*) OVER () AS n FROM relations_generated WHERE cosine IS NOT NULL)
SELECT p::DOUBLE AS p, any_value(cosine) AS value FROM v, (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]) AS p) WHERE pos = least(n - 1, floor(p::DOUBLE * n)) GROUP BY 1""")
def relations_cosine_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles that are values of the data, not interpolated."""
    return relations.step_quantiles(edges(spark, d), "cosine", (0.05, 0.25, 0.5, 0.75, 0.95))


@query(f"""WITH {_CONTRA}, s AS (SELECT policy, count(*) FILTER (stance = 1) * count(*) FILTER (stance = -1) AS n_possible FROM pv GROUP BY 1), c AS (SELECT policy, count(*) AS n_candidates FROM contra GROUP BY 1),
x AS (SELECT policy, n_possible, coalesce(n_candidates, 0) AS n_candidates FROM s LEFT JOIN c USING (policy)), r AS (SELECT *, row_number() OVER (ORDER BY n_candidates DESC, policy) AS rn, count(*) OVER () AS n FROM x)
SELECT policy, n_possible, n_candidates, CASE WHEN rn = 1 THEN 'most' WHEN rn = n // 2 + 1 THEN 'median' ELSE 'least' END AS pick FROM r WHERE rn IN (1, n // 2 + 1, n)""")
def relations_saturation_picks(spark: SparkSession, d: str) -> DataFrame:
    """The policies with the most, the median and the fewest candidates."""
    rows = pool_vectors(spark, d)
    return relations.saturation_picks(relations.candidate_stats(relations.contradiction_candidates(rows), rows), "n_candidates", "policy")


@query("""SELECT count(*) FILTER (upper(rel) LIKE '%CONTRADICT%' AND upper(rel) NOT LIKE '%COHERENCE%') AS n, 4950.0::DOUBLE AS low, 6050.0::DOUBLE AS high,
  count(*) FILTER (upper(rel) LIKE '%CONTRADICT%' AND upper(rel) NOT LIKE '%COHERENCE%') BETWEEN 4950 AND 6050 AS ok FROM relations_generated""")
def relations_edge_guard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.edge_guard(edges(spark, d), 5500))


@query(f"""WITH {_SCORED} SELECT rel, source, target, mined_at, '' AS label FROM complete QUALIFY row_number() OVER (PARTITION BY rel ORDER BY md5('42|' || source || '|' || target || '|' || epoch_us(mined_at)), source, target, epoch_us(mined_at)) <= 50""")
def relations_label_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty scored candidates per relation for labelling by hand (the sample is the feature)."""
    rows = scored_edges(spark, d).where("score IS NOT NULL").withColumn("mined", F.unix_micros(F.col("mined_at").cast("timestamp")))
    return files.label_sample(rows, "rel", ["source", "target", "mined"], 50).select("rel", "source", "target", "mined_at", "label")


@query(f"""WITH {EDGES}, m AS (SELECT DISTINCT 'EQUIVALENT' AS rel) SELECT rel, count(*) AS n FROM edges WHERE a IS NOT NULL AND rel <> 'EQUIVALENT' GROUP BY 1
UNION ALL (WITH {_SCORED} SELECT 'EQUIVALENT', count(*) FROM accepted WHERE rel = 'EQUIVALENT')""")
def relations_merged_version(spark: SparkSession, d: str) -> DataFrame:
    """The relation counts of a graph whose equivalences were replaced by the newly accepted ones."""
    current = edges(spark, d).where("a IS NOT NULL").select("rel", F.col("a").alias("source"), F.col("b").alias("target"))
    mined = accepted_edges(spark, d).where("rel = 'EQUIVALENT'").select("rel", "source", "target")
    return files.merge_edges(current, mined).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLES = query.queries, query.oracles
