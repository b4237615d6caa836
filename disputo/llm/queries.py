"""Queries of the numbered problems over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.llm import clusters, components, consensus, copies, forms, leakage, mixing, neardup, similar
from disputo.runtime import cut, table

VECTOR = 64


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.equivalence_groups(table(spark, d, "relations_generated"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, d, "debater_dataset_with_clusters"), "arg_id", "embedding", VECTOR)[0]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).where("n_members > 1").select(F.col("id").alias("arg_id"), "cluster_key")


def p3_typical_members(spark: SparkSession, d: str) -> DataFrame:
    """Size and three most typical arguments of every cluster of two or more."""
    typical = clusters.most_typical(_clusters(spark, d).where("n_members > 1"))
    return typical.select("cluster_key", "n_members", F.col("rank").cast("int").alias("typical_rank"), F.col("id").alias("arg_id"))


def p3_densest_members(spark: SparkSession, d: str) -> DataFrame:
    """Of every cluster of two or more its size, the rows in its densest cell, and the first three of them."""
    vectors = table(spark, d, "debater_dataset_with_clusters")
    dense = clusters.densest_members(vectors, _clusters(spark, d).where("n_members > 1"), "arg_id", "embedding", VECTOR)
    return dense.select("cluster_key", "n_members", "n_cell", F.col("rank").cast("int").alias("cell_rank"), F.col("id").alias("arg_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    best = similar.most_similar(table(spark, d, "debater_dataset_with_clusters"), "arg_id", "embedding", VECTOR, 5, least=0.8)
    return similar.neighbour_pairs(best).select(F.col("a").alias("arg_id_a"), F.col("b").alias("arg_id_b"))


def p4_five_most_similar(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar arguments, however similar, of every argument whose number is divisible by 20."""
    vectors = table(spark, d, "debater_dataset_with_clusters")
    number = F.regexp_extract("arg_id", r"^arg_(\d+)$", 1).try_cast("long")
    queries = vectors.select(F.col("arg_id").alias("id")).where(number % 20 == 0)
    best = similar.most_similar(vectors, "arg_id", "embedding", VECTOR, 5, queries=queries)
    return best.select(F.col("q").alias("arg_id"), F.col("o").alias("similar_id"), F.col("rank").cast("int").alias("similar_rank"), F.round("cosine", 6).alias("cosine"))


def p4_search_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the partners with a cosine of at least 0.80 the collision search found before the exact check, over all rows."""
    best = similar.most_similar(table(spark, d, "debater_dataset_with_clusters"), "arg_id", "embedding", VECTOR, 5, least=0.8)
    return best.agg(F.count(F.lit(1)).alias("n_partners"), F.count_if("searched").alias("n_searched"), F.round(F.avg(F.col("searched").cast("double")), 6).alias("recall"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    arguments = table(spark, d, "arguments_clean").select(F.lit("arguments_clean").alias("src"), F.col("arg_id").alias("rec_key"), F.col("argument").alias("text"))
    documents = table(spark, d, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("rec_key"), "text")
    return arguments.union(documents)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        copies.copy_groups(_texts(spark, d).where(F.col("src") == src), "rec_key", "text").select(F.lit(src).alias("src"), F.col("key").alias("rec_key"), "group_key", "n_copies")
        for src in ("arguments_clean", "documents")
    ]
    return parts[0].union(parts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where("n_copies > 1").select("src", "rec_key", "group_key")


def p5_distinct_contents(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct content, with its number of copies."""
    return _copies(spark, d).where("rec_key = group_key").select("src", "group_key", "n_copies")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = neardup.near_duplicates(_texts(spark, d), "src", "rec_key", "text", threshold=0.75, shingle=1)
    return neardup.expanded_pairs(links, members)


def p6_link_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records whose five-word shingles are at least 0.8 alike: class and number of similar classes of every record."""
    counts = neardup.class_link_counts(*neardup.similar_contents(_texts(spark, d), "src", "rec_key", "text"))
    return counts.select("src", F.col("key").alias("rec_key"), "class_id", "n_links")


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every record that has versions or copies: records linked as in p6_found, directly or through others."""
    pairs, _, members = neardup.similar_contents(_texts(spark, d), "src", "rec_key", "text", threshold=0.75, shingle=1)
    return neardup.near_groups(pairs, members).select("src", F.col("key").alias("rec_key"), "group_key", "n_records")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.consensus(table(spark, d, "graded_judgments"))
    return items.select(F.col("item").alias("item_id"), F.col("consensus_grade").cast("int").alias("consensus_grade"))


def p7_annotator_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, annotators = consensus.consensus(table(spark, d, "graded_judgments"))
    return annotators.select(F.col("annotator").alias("annotator_id"), "n", F.round("reliability", 6).alias("reliability"), F.round("weight", 6).alias("weight"), "trusted")


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement per policy, and over all policies as ``kappa_mean`` and ``alpha_ordinal_mean`` (policy NULL)."""
    judgments = table(spark, d, "graded_judgments")
    votes = cut(consensus.valid_judgments(judgments))
    groups = judgments.where("item_id IS NOT NULL AND policy IS NOT NULL").groupBy(F.col("item_id").alias("item")).agg(F.min("policy").alias("grp"))
    per = cut(consensus.agreement(votes, groups))
    each = per.select(F.col("grp").alias("policy"), "n_items", F.round("kappa", 6).alias("kappa_mean"), F.round("alpha_ordinal", 6).alias("alpha_ordinal_mean"))
    every = per.agg(F.sum("n_items").alias("n_items"), F.round(F.avg("kappa"), 6).alias("kappa_mean"), F.round(F.avg("alpha_ordinal"), 6).alias("alpha_ordinal_mean"))
    return each.union(every.select(F.lit(None).cast("string").alias("policy"), "n_items", "kappa_mean", "alpha_ordinal_mean"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item: documents that hold part of it, the largest part and the number that hold at least half."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.max("coverage"), 6).alias("max_coverage"), F.sum((F.col("coverage") >= 0.5).cast("long")).alias("n_half"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is taken."""
    kept, _ = mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return kept.select("doc_id", "source", "tokens", "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.withColumns({c: F.round(c, 6) for c in ("budget_tokens", "actual_share")})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = forms.same_form_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_consistent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text in its one form."""
    return table(spark, d, "documents").select("doc_id", forms.consistent_form("text").alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in list(globals().items()) if callable(f) and name[0] == "p" and name[1:].split("_")[0].isdigit()
}
# Brute force in SQL where that is feasible on whole tables.
_VECS = """v AS (SELECT arg_id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM debater_dataset_with_clusters
  WHERE arg_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
p AS (SELECT a.arg_id AS a, b.arg_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.arg_id <> b.arg_id WHERE list_cosine_similarity(a.e, b.e) >= 0.8)"""
_CLUSTER = "l AS (SELECT a AS arg_id, least(a, min(b)) AS cluster_key FROM p GROUP BY a)"
_PAIRS = [(g, h) for g in range(4) for h in range(g + 1, 4)]
_ORDINAL = {(g, h): "(" + " + ".join([f"(n{g} + n{h}) / 2", *[f"n{k}" for k in range(g + 1, h)]]) + ")" for g, h in _PAIRS}
_AGREEMENT = f"""WITH v AS (SELECT item_id, annotator_id, arg_max(grade, (judged_at, grade)) AS grade FROM graded_judgments WHERE grade BETWEEN 0 AND 3 AND item_id IS NOT NULL AND annotator_id IS NOT NULL GROUP BY ALL),
g AS (SELECT item_id, min(policy) AS policy FROM graded_judgments WHERE item_id IS NOT NULL AND policy IS NOT NULL GROUP BY 1), i AS (SELECT item_id, {", ".join(f"count(*) FILTER (grade = {g}) AS c{g}" for g in range(4))}, count(*) AS m FROM v GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT policy, count(*) AS n_items, {", ".join(f"sum(c{g})::DOUBLE AS n{g}" for g in range(4))}, sum(m)::DOUBLE AS t, {", ".join(f"sum(2.0::DOUBLE * c{g} * c{h} / (m - 1)) AS o{g}{h}" for g, h in _PAIRS)} FROM i JOIN g USING (item_id) GROUP BY 1),
x AS (SELECT policy, n_items, t, ({" + ".join(f"o{g}{h} * {(g - h) ** 2}" for g, h in _PAIRS)}) / t AS d1, {" + ".join(f"2 * n{g} * n{h} * {(g - h) ** 2}" for g, h in _PAIRS)} AS e1,
 ({" + ".join(f"o{g}{h} * power({_ORDINAL[g, h]}, 2)" for g, h in _PAIRS)}) / t AS d2, {" + ".join(f"2 * n{g} * n{h} * power({_ORDINAL[g, h]}, 2)" for g, h in _PAIRS)} AS e2 FROM s),
a AS (SELECT policy, n_items, CASE WHEN e1 = 0 THEN 1.0 ELSE 1 - d1 / (e1 / (t * t)) END AS k, CASE WHEN e2 = 0 THEN 1.0 ELSE 1 - d2 / (e2 / (t * (t - 1))) END AS al FROM x)
SELECT policy, n_items, round(k, 6) AS kappa_mean, round(al, 6) AS alpha_ordinal_mean FROM a UNION ALL SELECT NULL, sum(n_items)::BIGINT, round(avg(k), 6), round(avg(al), 6) FROM a"""
ORACLES: dict[str, str] = {
    "p7_agreement": _AGREEMENT,
    "p2_found": """WITH RECURSIVE n AS (SELECT lower(trim(rel)) AS rel, nullif(lower(trim(source)), '') AS s, nullif(lower(trim(target)), '') AS t, nullif(lower(trim(arg1_id)), '') AS x, nullif(lower(trim(arg2_id)), '') AS y FROM relations_generated),
e AS (SELECT CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN s ELSE x END AS a, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN t ELSE y END AS b FROM n WHERE rel = 'equivalent' AND ((s IS NOT NULL AND t IS NOT NULL) OR (x IS NOT NULL AND y IS NOT NULL))),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT node AS arg_id, min(seen) AS group_id FROM r GROUP BY 1""",
    "p3_found": f"WITH {_VECS} SELECT a AS arg_id, least(a, min(b)) AS cluster_key FROM p GROUP BY a",
    "p3_typical_members": f"""WITH {_VECS}, {_CLUSTER}, un AS (SELECT l.cluster_key, l.arg_id, list_transform(v.e, lambda x: x / sqrt(list_sum(list_transform(v.e, lambda y: y * y)))) AS u FROM l JOIN v USING (arg_id)),
t AS (SELECT cluster_key, list(s ORDER BY i) AS s FROM (SELECT cluster_key, i, sum(x) AS s FROM (SELECT cluster_key, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM un) GROUP BY ALL) GROUP BY 1)
SELECT cluster_key, count(*) OVER (PARTITION BY cluster_key) AS n_members, row_number() OVER (PARTITION BY cluster_key ORDER BY round(list_cosine_similarity(u, s), 9) DESC, arg_id)::INTEGER AS typical_rank, arg_id FROM un JOIN t USING (cluster_key) QUALIFY typical_rank <= 3""",
    "p3_densest_members": f"""WITH {_VECS}, {_CLUSTER}, un AS (SELECT l.cluster_key, l.arg_id, [floor(v.e[i] / sqrt(list_sum(list_transform(v.e, lambda y: y * y))) / 0.1::DOUBLE)::INTEGER for i in [1, 2, 3, 4]] AS cell, count(*) OVER (PARTITION BY cluster_key) AS n_members FROM l JOIN v USING (arg_id)),
c AS (SELECT * FROM (SELECT cluster_key, cell, count(*) AS n_cell FROM un GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster_key ORDER BY n_cell DESC, cell) = 1)
SELECT cluster_key, n_members, n_cell, row_number() OVER (PARTITION BY cluster_key ORDER BY arg_id)::INTEGER AS cell_rank, arg_id FROM un JOIN c USING (cluster_key, cell) QUALIFY cell_rank <= 3""",
    "p4_five_most_similar": """WITH v AS (SELECT arg_id, any_value(list_transform(embedding, lambda x: x::DOUBLE)) AS e FROM debater_dataset_with_clusters
  WHERE arg_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
q AS (SELECT * FROM v WHERE try_cast(regexp_extract(arg_id, '^arg_(\\d+)$', 1) AS BIGINT) % 20 = 0), p AS (SELECT q.arg_id, v.arg_id AS similar_id, list_cosine_similarity(q.e, v.e) AS c FROM q JOIN v ON q.arg_id <> v.arg_id)
SELECT arg_id, similar_id, row_number() OVER (PARTITION BY arg_id ORDER BY c DESC, similar_id)::INTEGER AS similar_rank, round(c, 6) AS cosine FROM p QUALIFY similar_rank <= 5""",
    "p4_found": f"WITH {_VECS}, k AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5) SELECT DISTINCT least(a, b) AS arg_id_a, greatest(a, b) AS arg_id_b FROM k",
}
