"""Evaluation queries: matched lists, ranking and diversity metrics, conflicts, summaries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.functions.scalars import strip
from disputo.functions.vectors import mean_vector
from disputo.operators import corpus, metrics, ml
from disputo.plans._views import ARGS, EDGES, PV, VECS, Registry, arguments, edges, pool, rounded, stripped, vectors
from disputo.plans.judged import _CONSENSUS, graded
from disputo.runtime import cut, table
from disputo.sources import files

query = Registry()
BY = ["policy", "stance"]
K = 5

# the judged lists: items of each policy and stance in their given position order, as the system "given"
_LISTS = f"""{_CONSENSUS}, {ARGS}, {VECS}, gt AS (SELECT c.policy, c.stance, {stripped('a.argument')} AS text, max(c.grade) AS grade FROM cons c JOIN args a USING (arg_id) GROUP BY ALL),
li AS (SELECT c.policy, c.stance, c.arg_id, a.argument AS text, u, row_number() OVER (PARTITION BY c.policy, c.stance ORDER BY c.pos, c.item_id)::INTEGER AS rank FROM cons c JOIN args a USING (arg_id) LEFT JOIN vecs USING (arg_id)),
gu AS (SELECT c.policy, c.stance, {stripped('a.argument')} AS text, arg_max(u, c.grade) AS gu FROM cons c JOIN args a USING (arg_id) LEFT JOIN vecs USING (arg_id) GROUP BY ALL),
near AS (SELECT l.policy, l.stance, {stripped('l.text')} AS key, gt.text AS gt_text, gt.grade, round(list_cosine_similarity(l.u, gu.gu), 9) AS cs FROM li l JOIN gt USING (policy, stance) JOIN gu ON gu.policy = gt.policy AND gu.stance = gt.stance AND gu.text = gt.text
  WHERE l.u IS NOT NULL AND gu.gu IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gt g WHERE g.policy = l.policy AND g.stance = l.stance AND g.text = {stripped('l.text')})),
best AS (SELECT policy, stance, key, arg_max(gt_text, (cs, -grade, gt_text)) AS gt_text, arg_max(grade, (cs, -grade, gt_text)) AS grade FROM near WHERE cs >= 0.75 GROUP BY ALL),
m AS (SELECT l.policy, l.stance, l.arg_id, l.text, l.u, l.rank, coalesce(gt.grade, b.grade, 0) AS grade, CASE WHEN gt.grade IS NOT NULL THEN 'exact' WHEN b.gt_text IS NOT NULL THEN 'semantic' ELSE 'none' END AS match, coalesce(gt.text, b.gt_text) AS match_text
  FROM li l LEFT JOIN gt ON gt.policy = l.policy AND gt.stance = l.stance AND gt.text = {stripped('l.text')} LEFT JOIN best b ON b.policy = l.policy AND b.stance = l.stance AND b.key = {stripped('l.text')})"""


def judged_items(spark: SparkSession, d: str) -> DataFrame:
    """All graded items with text and vector, stored: lists and truth are both made of them."""
    texts = arguments(spark, d, "argument").select("arg_id", F.col("argument").alias("text"))
    return cut(graded(spark, d).join(texts, "arg_id").join(vectors(spark, d).select("arg_id", "u"), "arg_id", "left"))


def ground_truth(items: DataFrame) -> DataFrame:
    """The graded texts that lists are held against."""
    return items.select("policy", "stance", "text", "grade", "u")


def given_lists(items: DataFrame) -> DataFrame:
    """All judged items as lists, in their given order."""
    places = corpus.positional_ids(items.select(*BY, "arg_id", "pos", "item_id", "text", "u"), ["pos", "item_id"], "place", by=BY)
    return places.select(*BY, "arg_id", "text", "u", (F.col("place") + 1).cast("int").alias("rank"))


def matched(items: DataFrame) -> DataFrame:
    return metrics.match_grades(given_lists(items), ground_truth(items))


def truth_texts(items: DataFrame) -> DataFrame:
    return ground_truth(items).withColumn("text", strip("text")).groupBy(*BY, "text").agg(F.max("grade").alias("grade"))


@query(f"WITH {_LISTS} SELECT policy, stance, arg_id, rank, grade, match FROM m")
def eval_matches(spark: SparkSession, d: str) -> DataFrame:
    """Exact, then nearest, then no match of every listed argument."""
    return matched(judged_items(spark, d)).select(*BY, "arg_id", "rank", "grade", "match")


def _ranking_sql(gain: str) -> str:
    return f"""{_LISTS}, x AS (SELECT policy, stance, sum({gain.format('grade')} / log2(rank + 1)) AS dcg, count(*) AS n_items, avg((grade >= 2)::INTEGER) AS precision, count(DISTINCT CASE WHEN grade >= 2 THEN match_text END) AS n_hit, sum(grade) / {K}.0::DOUBLE AS mean_rel,
 avg((match = 'exact')::INTEGER) AS exact_share, avg((match = 'semantic')::INTEGER) AS semantic_share FROM m WHERE rank <= {K} GROUP BY ALL), rel AS (SELECT policy, stance, count(*) FILTER (grade >= 2) AS n_relevant FROM gt GROUP BY ALL),
 ideal AS (SELECT policy, stance, sum({gain.format('grade')} / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY policy, stance ORDER BY grade DESC, text) AS r FROM gt) WHERE r <= {K} GROUP BY ALL)
 SELECT policy, stance, n_items, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg, round(precision, 6) AS precision, round(n_hit / nullif(n_relevant, 0)::DOUBLE, 6) AS recall, round(mean_rel, 6) AS mean_rel, round(exact_share, 6) AS exact_share, round(semantic_share, 6) AS semantic_share,
 round(1 - exact_share - semantic_share, 6) + 0.0 AS none_share FROM x LEFT JOIN rel USING (policy, stance) LEFT JOIN ideal USING (policy, stance)"""


@query("WITH " + _ranking_sql("(power(2.0::DOUBLE, {0}) - 1)"))
def eval_ranking(spark: SparkSession, d: str) -> DataFrame:
    """nDCG, precision, recall, mean relevance and match shares at 5."""
    items = judged_items(spark, d)
    return rounded(metrics.ranking_metrics(matched(items), truth_texts(items), BY, K))


@query("WITH " + _ranking_sql("{0}::DOUBLE"))
def eval_ranking_linear(spark: SparkSession, d: str) -> DataFrame:
    """The same with linear gains."""
    items = judged_items(spark, d)
    return rounded(metrics.ranking_metrics(matched(items), truth_texts(items), BY, K, exponential=False))


@query(f"""WITH {_LISTS}, cl AS (SELECT gt.policy, gt.stance, gt.text, length(gt.text) % 4 AS cluster FROM gt WHERE grade >= 2), t AS (SELECT policy, stance, count(DISTINCT cluster) AS n FROM cl GROUP BY ALL),
h AS (SELECT m.policy, m.stance, count(DISTINCT cluster) AS k FROM m JOIN cl ON cl.policy = m.policy AND cl.stance = m.stance AND cl.text = m.match_text WHERE rank <= {K} AND m.grade >= 2 GROUP BY ALL)
SELECT policy, stance, round(CASE WHEN n >= 2 THEN coalesce(k, 0) / n::DOUBLE END, 6) AS s_recall FROM t LEFT JOIN h USING (policy, stance)""")
def eval_subtopic_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of relevant subtopics hit (subtopics given by text length here, as input)."""
    items = judged_items(spark, d)
    clusters = truth_texts(items).where("grade >= 2").withColumn("cluster", F.length("text") % 4).drop("grade")
    return rounded(metrics.subtopic_recall(matched(items), clusters, BY, K))


@query()
def eval_subtopic_recall_linked(spark: SparkSession, d: str) -> DataFrame:
    """The same with subtopics by average linkage of the relevant arguments of each judged pool (its first 200, the size that is judged; tested against plain loops)."""
    items = judged_items(spark, d)
    judged = corpus.positional_ids(items.where("grade >= 2 AND u IS NOT NULL").select(*BY, "text", "u", "pos", "item_id"), ["pos", "item_id"], "place", by=BY).where("place < 200")
    once = judged.withColumn("text", strip("text")).groupBy(*BY, "text").agg(F.min_by("u", "item_id").alias("u"))
    clusters = ml.cluster_groups(once, BY, "text", "u", partial(ml.average_linkage, threshold=0.15))
    return rounded(metrics.subtopic_recall(matched(items), clusters, BY, K))


@query(f"WITH {_LISTS} SELECT policy, stance, arg_id, rank FROM m WHERE {stripped('text')} IN (SELECT g.text FROM gt g WHERE g.policy = m.policy AND g.stance = m.stance AND g.grade >= 2)")
def eval_relevant_listed(spark: SparkSession, d: str) -> DataFrame:
    """Listed arguments whose text is among the relevant ones of their pool."""
    items = judged_items(spark, d)
    relevant = truth_texts(items).where("grade >= 2").select(*BY, F.col("text").alias("key"))
    return given_lists(items).withColumn("key", strip("text")).join(relevant, [*BY, "key"], "left_semi").select(*BY, "arg_id", "rank")


_PAIRS = "SELECT a.policy, a.stance, avg(list_dot_product(a.u, b.u)) AS c FROM {0} a JOIN {0} b ON a.policy = b.policy AND a.stance = b.stance AND a.arg_id < b.arg_id GROUP BY ALL"


@query(f"""WITH {_LISTS}, v AS (SELECT * FROM m WHERE u IS NOT NULL), r AS (SELECT * FROM v WHERE grade >= 2), p AS ({_PAIRS.format('v')}), q AS ({_PAIRS.format('r')}), g AS (SELECT DISTINCT policy, stance FROM m)
SELECT policy, stance, round(coalesce(1 - p.c, 0), 6) AS ild, round(coalesce(1 - q.c, 0), 6) AS eild FROM g LEFT JOIN p USING (policy, stance) LEFT JOIN q USING (policy, stance)""")
def eval_diversity(spark: SparkSession, d: str) -> DataFrame:
    """Diversity of the lists, and of their relevant items."""
    rows = cut(matched(judged_items(spark, d)))
    each = metrics.diversity(rows, BY).join(metrics.diversity(rows, BY, True).withColumnRenamed("ild", "eild"), BY)
    return rounded(each)


@query(f"""WITH {_LISTS}, mf AS (SELECT DISTINCT policy, stance, {stripped('argument')} AS key FROM args WHERE is_distractor) SELECT m.policy, m.stance, round(avg((mf.key IS NOT NULL)::INTEGER), 6) AS distractor_rate FROM m LEFT JOIN mf ON mf.policy = m.policy AND mf.stance = m.stance AND mf.key = {stripped('m.text')} GROUP BY ALL""")
def eval_distractor_rate(spark: SparkSession, d: str) -> DataFrame:
    manifest = arguments(spark, d, "is_distractor", "policy", "stance", "argument").where("is_distractor").select("policy", "stance", F.col("argument").alias("text"))
    return rounded(metrics.distractor_rate(given_lists(judged_items(spark, d)), manifest, BY))


_SCORES = f"""{EDGES}, sc AS (SELECT a AS premise, b AS hypothesis, max(contra_fwd) AS contra FROM edges WHERE rel = 'CONTRADICTS' AND a IS NOT NULL AND contra_fwd IS NOT NULL GROUP BY ALL)"""


def contra_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = edges(spark, d).where("rel = 'CONTRADICTS' AND a IS NOT NULL AND contra_fwd IS NOT NULL")
    return rows.groupBy(F.col("a").alias("premise"), F.col("b").alias("hypothesis")).agg(F.max("contra_fwd").alias("contra"))


@query(f"""WITH {PV}, {_SCORES}, s AS (SELECT policy, count(*) FILTER (stance = 1) AS p, count(*) FILTER (stance = -1) AS c FROM pool GROUP BY 1), x AS (SELECT p.policy, sum(contra::DECIMAL(30,15))::DOUBLE AS t, count(*) FILTER (contra > 0.5) AS k FROM sc JOIN pool p ON p.arg_id = premise AND p.stance = 1 JOIN pool c ON c.arg_id = hypothesis AND c.stance = -1 AND c.policy = p.policy GROUP BY 1)
SELECT policy, round(CASE WHEN p * c > 0 THEN coalesce(t, 0) / (p * c) ELSE 0 END, 6) AS conflict_density, coalesce(k, 0) AS n_conflicts FROM s LEFT JOIN x USING (policy)""")
def eval_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Conflict density and count of whole policies, from scored pairs."""
    return rounded(metrics.conflict(pool(spark, d), contra_scores(spark, d), ["policy"]))


@query(f"""WITH {_LISTS}, x AS (SELECT policy, max(CASE WHEN stance = 1 THEN g END) AS pro, max(CASE WHEN stance = -1 THEN g END) AS con FROM (SELECT policy, stance, avg(grade) AS g FROM m WHERE rank <= {K} GROUP BY ALL) GROUP BY 1)
SELECT policy, round((pro + con) / 2, 6) AS strict, round(coalesce((pro + con) / 2, pro, con), 6) AS lenient FROM x""")
def eval_pair_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of PRO and CON, NULL if one is missing or of what there is."""
    sides = matched(judged_items(spark, d)).where(F.col("rank") <= K).groupBy(*BY).agg(F.avg("grade").alias("g"))
    wide = sides.groupBy("policy").agg(*[F.max(F.when(F.col("stance") == s, F.col("g"))).alias(n) for s, n in ((1, "pro"), (-1, "con"))])
    return rounded(wide.select("policy", metrics.pair_mean("pro", "con").alias("strict"), metrics.pair_mean("pro", "con", True).alias("lenient")))


@query(f"""WITH {_LISTS} SELECT stance, round(avg(g), 6) AS grade_mean, round(stddev_pop(g), 6) AS grade_std, round(avg(p), 6) AS precision_mean, round(stddev_pop(p), 6) AS precision_std FROM (SELECT policy, stance, avg(grade) AS g, avg((grade >= 2)::INTEGER) AS p FROM m WHERE rank <= {K} GROUP BY ALL) GROUP BY 1""")
def eval_system_means(spark: SparkSession, d: str) -> DataFrame:
    lists = matched(judged_items(spark, d)).where(F.col("rank") <= K).groupBy(*BY).agg(F.avg("grade").alias("grade"), F.avg((F.col("grade") >= 2).cast("double")).alias("precision"))
    return rounded(metrics.system_means(lists, ["stance"], ["grade", "precision"]))


@query(f"""WITH {_LISTS}, x AS (SELECT policy, stance, avg(grade) AS g, count(*) AS n FROM m GROUP BY ALL) SELECT policy, round(max(CASE WHEN stance = 1 THEN g END), 6) AS grade_pro, round(max(CASE WHEN stance = -1 THEN g END), 6) AS grade_con, NULL::VARCHAR AS note FROM x GROUP BY 1 UNION ALL SELECT 'all', NULL, NULL, count(*)::VARCHAR FROM x""")
def eval_wide_report(spark: SparkSession, d: str) -> DataFrame:
    """Long metrics pivoted to one row per policy, with a row of other columns put under them."""
    sides = matched(judged_items(spark, d)).groupBy(*BY).agg(F.avg("grade").alias("value"))
    long = sides.withColumn("metric", F.when(F.col("stance") == 1, "grade_pro").otherwise("grade_con"))
    wide = files.wide_metrics(long, ["policy"], ["grade_pro", "grade_con"])
    note = sides.agg(F.count(F.lit(1)).cast("string").alias("note")).withColumn("policy", F.lit("all"))
    return rounded(files.union_rows([wide, note]))


# summaries: an argument counts as entailed by its policy's summary if one of its equivalences says so
_ENT = f"""{ARGS}, {EDGES}, en AS (SELECT a AS arg_id, max(entail_fwd) AS entail FROM edges WHERE rel = 'EQUIVALENT' AND a IS NOT NULL GROUP BY 1), pe AS (SELECT args.policy, args.stance, args.arg_id, entail, coalesce(entail > 0.5, false) AS covered FROM args LEFT JOIN en USING (arg_id) WHERE stance IN (1, -1))"""


def entailed(spark: SparkSession, d: str) -> DataFrame:
    scores = edges(spark, d).where("rel = 'EQUIVALENT' AND a IS NOT NULL").groupBy(F.col("a").alias("arg_id")).agg(F.max("entail_fwd").alias("entail"))
    rows = arguments(spark, d, "policy", "stance").where(F.col("stance").isin(1, -1)).join(scores, "arg_id", "left")
    return rows.withColumn("covered", F.coalesce(F.col("entail") > 0.5, F.lit(False)))


@query(f"WITH {_ENT} SELECT policy, round(avg(covered::INTEGER), 6) AS coverage FROM pe GROUP BY 1")
def summary_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.coverage(entailed(spark, d), ["policy"]))


@query(f"""WITH {_ENT}, x AS (SELECT policy, count(*) FILTER (stance = 1) AS np, count(*) FILTER (stance = -1) AS nc, count(*) FILTER (stance = 1 AND covered) AS p, count(*) FILTER (stance = -1 AND covered) AS c FROM pe GROUP BY 1)
SELECT policy, round(CASE WHEN np = 0 OR nc = 0 THEN NULL WHEN p + c = 0 THEN 0 ELSE 1 - 2 * abs(p / (p + c)::DOUBLE - 0.5) END, 6) AS balance, round(abs(CASE WHEN p + c > 0 THEN p / (p + c)::DOUBLE ELSE np / nullif(np + nc, 0)::DOUBLE END - np / nullif(np + nc, 0)::DOUBLE), 6) AS distortion FROM x""")
def summary_balance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.stance_balance(entailed(spark, d), ["policy"]))


@query(f"""WITH {ARGS}, {VECS}, sv AS (SELECT policy, split_name, i, avg(x) AS m FROM (SELECT policy, split_name, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM args JOIN vecs USING (arg_id) WHERE policy IS NOT NULL AND split_name IS NOT NULL) GROUP BY ALL),
s AS (SELECT policy, split_name, list(m ORDER BY i) AS v FROM sv GROUP BY ALL) , n AS (SELECT policy, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.policy, 1 - avg(list_cosine_similarity(a.v, b.v)) AS dv FROM s a JOIN s b ON a.policy = b.policy AND a.split_name < b.split_name GROUP BY 1)
SELECT policy, round(dv, 6) AS divergence FROM n LEFT JOIN p USING (policy)""")
def summary_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far the mean vectors of the splits, standing for systems, lie apart per policy."""
    from disputo.functions.vectors import unit

    rows = arguments(spark, d, "policy", "split_name").where("policy IS NOT NULL AND split_name IS NOT NULL").join(vectors(spark, d).select("arg_id", "u"), "arg_id")
    systems = unit(mean_vector(rows, ["policy", "split_name"], "u", 64), "centroid", "v")
    return rounded(metrics.divergence(systems, ["policy"], "v"))


@query("""WITH c AS (SELECT policy, CASE WHEN grade BETWEEN 0 AND 3 THEN grade >= 2 END AS s FROM graded_judgments), f AS (SELECT policy, avg(s::INTEGER) AS f FROM c WHERE s IS NOT NULL GROUP BY 1), p AS (SELECT DISTINCT policy FROM policies WHERE policy IS NOT NULL)
SELECT policy, round(coalesce(f, 0), 6) AS faithfulness FROM p LEFT JOIN f USING (policy)""")
def summary_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Supported share of claims (judgments as claims, grade >= 2 as support, unreadable ones left out)."""
    supported = F.when(F.col("grade").between(0, 3), F.col("grade") >= 2)
    claims = table(spark, d, "graded_judgments").select("policy", supported.alias("supported"))
    return rounded(metrics.faithfulness(claims, table(spark, d, "policies").where("policy IS NOT NULL"), ["policy"]))


@query("""WITH s AS (SELECT item_id, side, annotator_id, grade + 1 AS score FROM graded_judgments), ok AS (SELECT item_id FROM s GROUP BY 1 HAVING count(*) FILTER (coalesce(NOT score BETWEEN 1 AND 4, true)) = 0)
SELECT side, annotator_id, round(avg(score), 6) AS mean_score, count(*) AS n FROM s WHERE item_id IN (SELECT item_id FROM ok) GROUP BY ALL""")
def summary_rubric(spark: SparkSession, d: str) -> DataFrame:
    """Mean rubric scores over records without an impossible score."""
    scores = table(spark, d, "graded_judgments").select("item_id", "side", "annotator_id", (F.col("grade") + 1).alias("score"))
    return rounded(metrics.rubric_means(scores, ["item_id"], ["side", "annotator_id"], 1, 4))


@query(f"""WITH {EDGES}, v AS (SELECT policy, CASE WHEN contra_fwd IS NULL OR contra_bwd IS NULL THEN NULL WHEN (contra_fwd >= 0.85) = (contra_bwd >= 0.85) THEN CASE WHEN contra_fwd >= 0.85 THEN 'A' ELSE 'B' END ELSE 'tie' END AS w FROM edges WHERE rel = 'CONTRADICTS')
SELECT policy, count(*) AS n, count(*) FILTER (w = 'A') AS wins, count(*) FILTER (w = 'tie') AS ties, round(avg((w = 'A')::INTEGER), 4) AS win_rate, round(avg((w = 'tie')::INTEGER), 4) AS tie_rate FROM v WHERE w IS NOT NULL GROUP BY 1""")
def summary_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Wins and ties of comparisons made in both orders."""
    rows = edges(spark, d).where("rel = 'CONTRADICTS'")
    verdict = lambda c: F.when(F.col(c) >= 0.85, "A").when(F.col(c).isNotNull(), "B")
    return metrics.win_rates(rows.withColumn("winner", metrics.pairwise_winner(verdict("contra_fwd"), verdict("contra_bwd"))), ["policy"], "winner", "A")


@query("""WITH s AS (SELECT policy, avg(n_chars) AS v FROM documents WHERE source = 'uc2_summary' GROUP BY 1), p AS (SELECT policy, avg(n_chars) AS v FROM documents WHERE source = 'debate_essay' GROUP BY 1)
SELECT policy, round(s.v, 6) AS structured, round(p.v, 6) AS paragraph, round(s.v - p.v, 6) AS delta FROM (SELECT * FROM s WHERE policy IS NOT NULL) s FULL JOIN (SELECT * FROM p WHERE policy IS NOT NULL) p USING (policy)""")
def summary_formats(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of structured summaries and of essays side by side."""
    docs = table(spark, d, "documents").where("policy IS NOT NULL")
    sides = [docs.where(F.col("source") == s).groupBy("policy").agg(F.avg("n_chars").alias("v")) for s in ("uc2_summary", "debate_essay")]
    return rounded(metrics.format_comparison(*sides, ["policy"], "v"))


QUERIES, ORACLES = query.queries, query.oracles
