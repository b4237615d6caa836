"""The sweep of all systems and configurations, its evaluation by system, and the summaries that the lists stand for."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.functions.vectors import mean_vector, unit
from disputo.operators import metrics, sweep
from disputo.plans._views import EDGES, PV, Registry, arguments, edges, pool, rounded, stripped, vectors
from disputo.plans.evaluation import ground_truth, judged_items, truth_texts
from disputo.plans.graphs import _HOP, _RANKS, hop_edges, ranks
from disputo.plans.judged import _CONSENSUS
from disputo.runtime import checkpoint_dir, cut, table
from disputo.schema import DEFAULTS as S
from disputo.sources import files

query = Registry()
#: The configuration whose lists the summaries are about.
POOL_SIZE, K = max(S.pools), min(S.ks)
_G = "pool, policy, stance"


def _greedy_sql(source: str, name: str, k: int) -> str:
    """``{name}n``: ``source`` (pool, policy, stance, arg_id, pool_pos, u, score) with its size and place; ``{name}g``: the place of the first ``k`` greedy steps."""
    out = f"""{name}n AS MATERIALIZED (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY {_G} ORDER BY pool_pos) AS place, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) ELSE 1.0 END AS rel FROM {source} WINDOW w AS (PARTITION BY {_G})),
{name}c1 AS (SELECT *, -1.0::DOUBLE AS near FROM {name}n), {name}s1 AS MATERIALIZED (SELECT * FROM {name}c1 QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY rel DESC, pool_pos) = 1)"""
    for i in range(2, k + 1):
        out += f""",
{name}c{i} AS MATERIALIZED (SELECT c.* REPLACE (greatest(c.near, list_dot_product(c.u, s.u)) AS near) FROM {name}c{i - 1} c JOIN {name}s{i - 1} s USING ({_G}) WHERE c.arg_id <> s.arg_id),
{name}s{i} AS MATERIALIZED (SELECT * FROM {name}c{i} QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY round(0.5 * rel - 0.5 * near, 9) DESC, pool_pos) = 1)"""
    return out + f", {name}g AS (" + " UNION ALL ".join(f"SELECT {_G}, arg_id, {i} AS g FROM {name}s{i}" for i in range(1, k + 1)) + ")"


def _diverse_sql(name: str, system: str) -> str:
    return f"""SELECT pool, k, '{system}' AS system, policy, stance, (CASE WHEN n <= k THEN place ELSE g END)::INTEGER AS rank, arg_id FROM {name}n JOIN grid USING (pool) LEFT JOIN {name}g USING ({_G}, arg_id) WHERE n <= k OR g <= k"""


def _ranked_sql(source: str, order: str, system: str) -> str:
    return f"""SELECT pool, k, '{system}' AS system, policy, stance, rn::INTEGER AS rank, arg_id FROM (SELECT {_G}, arg_id, row_number() OVER (PARTITION BY {_G} ORDER BY {order}) AS rn FROM {source}) JOIN grid USING (pool) WHERE rn <= k"""


def _hops_sql() -> str:
    """One-hop expansions of all pool sizes."""
    parts = []
    for size in S.pools:
        one = _HOP.replace(f"pool_pos < {POOL_SIZE}", f"pool_pos < {size}").replace(f"pool_pos >= {POOL_SIZE}", f"pool_pos >= {size}").replace(f"rn <= {POOL_SIZE // 2}", f"rn <= {max(5, size // 2)}")
        one = re.sub(r"\b(he|both_ways|direct|found|hops|sizes|expanded)\b", rf"\g<1>{size}", one)
        parts.append(one)
    return ", ".join(parts)


_SWEEP = f"""{PV}, {EDGES}, {_hops_sql()}, {_RANKS.replace(EDGES + ',', '').strip()}, grid AS (SELECT p::INTEGER AS pool, k::INTEGER AS k FROM (SELECT unnest({list(S.pools)}) AS p), (SELECT unnest({list(S.ks)}) AS k) WHERE k <= p),
pvp AS (SELECT pool, pv.* FROM pv, (SELECT DISTINCT pool FROM grid) WHERE pool_pos < pool),
cen AS (SELECT {_G}, list_transform(range(1, 65), lambda i: list_avg(list_transform(us, lambda v: v[i]))) AS c FROM (SELECT {_G}, list(u) AS us FROM pvp GROUP BY ALL)),
sca AS MATERIALIZED (SELECT {_G}, arg_id, pool_pos, u, list_cosine_similarity(u, c) AS score FROM pvp JOIN cen USING ({_G})), {_greedy_sql('sca', 'a', max(S.ks))},
scb AS MATERIALIZED (SELECT e.pool, e.policy, e.stance, e.arg_id, e.pos AS pool_pos, v.u, coalesce(round(r.rank, 8), 0) AS score FROM ({' UNION ALL '.join(f'SELECT {size} AS pool, * FROM expanded{size}' for size in S.pools)}) e JOIN vecs v USING (arg_id) LEFT JOIN r ON r.id = e.arg_id), {_greedy_sql('scb', 'b', max(S.ks))},
q AS (SELECT policy, arg_min(u, arg_id) AS q FROM pv GROUP BY 1), scq AS (SELECT p.pool, pv.policy, stance, arg_id, coalesce(list_cosine_similarity(u, q), 0) AS score FROM pv JOIN q USING (policy), (SELECT DISTINCT pool FROM grid) p),
lists AS MATERIALIZED ({_diverse_sql('a', 'System A')} UNION ALL {_diverse_sql('b', 'System B')} UNION ALL {_ranked_sql('sca', 'round(score, 9) DESC, arg_id', 'Baseline A')}
 UNION ALL {_ranked_sql('sca', f"md5('{S.seed}|' || policy || '|' || arg_id), arg_id", 'Baseline B')} UNION ALL {_ranked_sql('scq', 'round(score, 9) DESC, arg_id', 'SimpleRAG')})"""


def all_lists(spark: SparkSession, d: str, settings=S) -> DataFrame:
    rows = pool(spark, d)
    vecs = cut(vectors(spark, d).select("arg_id", "u"))
    queries = rows.join(vecs, "arg_id").groupBy("policy").agg(F.min_by("u", "arg_id").alias("q"))
    scores = cut(ranks(spark, d).select(F.col("id").alias("arg_id"), F.round("rank", 8).alias("score")))
    return sweep.sweep(rows, vecs, cut(hop_edges(spark, d)), scores, queries, settings)


def stored_lists(spark: SparkSession, d: str, settings=S) -> DataFrame:
    """The sweep written as a store partitioned by configuration and system, and read back from it."""
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    files.write_retrieval(all_lists(spark, d, settings).repartition("pool", "k", "system"), path)
    return files.read_retrieval(spark, path).select(*sweep.LIST, "rank", "arg_id")


@query(f"WITH RECURSIVE {_SWEEP} SELECT * FROM lists")
def sweep_uc1(spark: SparkSession, d: str) -> DataFrame:
    """The lists of all five systems and all nineteen configurations."""
    return stored_lists(spark, d)


_EVAL = f"""{_SWEEP}, {_CONSENSUS}, gt AS (SELECT c.policy, c.stance, {stripped('a.argument')} AS text, max(c.grade) AS grade FROM cons c JOIN args a USING (arg_id) GROUP BY ALL),
gu AS (SELECT c.policy, c.stance, {stripped('a.argument')} AS text, arg_max(u, c.grade) AS gu FROM cons c JOIN args a USING (arg_id) LEFT JOIN vecs USING (arg_id) GROUP BY ALL),
li AS (SELECT l.policy, l.stance, l.arg_id, {stripped('a.argument')} AS key, u FROM (SELECT DISTINCT policy, stance, arg_id FROM lists) l JOIN args a USING (arg_id) JOIN vecs USING (arg_id)),
near AS (SELECT l.policy, l.stance, l.key, gt.text AS gt_text, gt.grade, round(list_cosine_similarity(l.u, gu.gu), 9) AS cs FROM li l JOIN gt USING (policy, stance) JOIN gu ON gu.policy = gt.policy AND gu.stance = gt.stance AND gu.text = gt.text
  WHERE gu.gu IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gt g WHERE g.policy = l.policy AND g.stance = l.stance AND g.text = l.key)),
best AS (SELECT policy, stance, key, arg_max(gt_text, (cs, -grade, gt_text)) AS gt_text, arg_max(grade, (cs, -grade, gt_text)) AS grade FROM near WHERE cs >= 0.75 GROUP BY ALL),
m AS MATERIALIZED (SELECT l.policy, l.stance, l.arg_id, l.u, coalesce(gt.grade, b.grade, 0) AS grade, CASE WHEN gt.grade IS NOT NULL THEN 'exact' WHEN b.gt_text IS NOT NULL THEN 'semantic' ELSE 'none' END AS match, coalesce(gt.text, b.gt_text) AS match_text
  FROM li l LEFT JOIN gt ON gt.policy = l.policy AND gt.stance = l.stance AND gt.text = l.key LEFT JOIN best b ON b.policy = l.policy AND b.stance = l.stance AND b.key = l.key),
j AS MATERIALIZED (SELECT l.*, m.u, m.grade, m.match, m.match_text, coalesce(p.is_distractor, false) AS injected FROM lists l JOIN m USING (policy, stance, arg_id) LEFT JOIN pool p USING (policy, stance, arg_id)),
sums AS (SELECT pool, k, system, policy, stance, sum((power(2.0::DOUBLE, grade) - 1) / log2(rank + 1)) AS dcg, sum(grade / log2(rank + 1)) AS dcg_lin, avg((grade >= 2)::INTEGER) AS precision, count(DISTINCT CASE WHEN grade >= 2 THEN match_text END) AS n_hit, sum(grade) / max(k)::DOUBLE AS mean_rel,
  avg(injected::INTEGER) AS distractor_rate, avg((match = 'exact')::INTEGER) AS exact, avg((match = 'semantic')::INTEGER) AS semantic, avg((match = 'none')::INTEGER) AS none FROM j GROUP BY ALL),
ildp AS (SELECT a.pool, a.k, a.system, a.policy, a.stance, 1 - avg(list_dot_product(a.u, b.u)) AS ild FROM j a JOIN j b ON a.pool = b.pool AND a.k = b.k AND a.system = b.system AND a.policy = b.policy AND a.stance = b.stance AND a.rank < b.rank GROUP BY ALL),
gr AS (SELECT *, row_number() OVER (PARTITION BY policy, stance ORDER BY grade DESC, text) AS place FROM gt), ideal AS (SELECT policy, stance, k, sum((power(2.0::DOUBLE, grade) - 1) / log2(place + 1)) AS idcg, sum(grade / log2(place + 1)) AS idcg_lin FROM gr, (SELECT DISTINCT k FROM grid) WHERE place <= k GROUP BY ALL),
rel AS (SELECT policy, stance, count(*) FILTER (grade >= 2) AS n_relevant FROM gt GROUP BY ALL),
each AS (SELECT s.*, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END AS ndcg, CASE WHEN idcg_lin > 0 THEN dcg_lin / idcg_lin ELSE 0 END AS ndcg_lin, n_hit / nullif(n_relevant, 0)::DOUBLE AS recall, coalesce(ild, 0) AS ild FROM sums s LEFT JOIN ildp USING (pool, k, system, policy, stance) LEFT JOIN ideal USING (policy, stance, k) LEFT JOIN rel USING (policy, stance))"""


def matched_arguments(spark: SparkSession, d: str, lists: DataFrame, items: DataFrame) -> DataFrame:
    """The grade of every argument that some list holds, each matched once."""
    listed = lists.select("policy", "stance", "arg_id").distinct()
    texts = arguments(spark, d, "argument").select("arg_id", F.col("argument").alias("text"))
    rows = cut(listed.join(texts, "arg_id").join(vectors(spark, d).select("arg_id", "u"), "arg_id").select("policy", "stance", "arg_id", "text", "u"))
    return metrics.match_grades(rows, ground_truth(items)).drop("text")


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    lists, items = stored_lists(spark, d), judged_items(spark, d)
    manifest = pool(spark, d).where("is_distractor")
    return sweep.list_metrics(lists, cut(matched_arguments(spark, d, lists, items)), truth_texts(items), S.ks, manifest)


@query(f"""WITH RECURSIVE {_EVAL} SELECT pool, k, system, stance, count(*) AS n_policies, {', '.join(f'round(avg({m}), 6) AS {m}_mean' for m in sweep.METRICS)}, round(stddev_pop(ndcg), 6) AS ndcg_std FROM each GROUP BY ALL""")
def eval_by_system(spark: SparkSession, d: str) -> DataFrame:
    """The stored lists of all configurations against the graded items: every metric's mean over the policies by configuration, system and stance."""
    return rounded(sweep.by_system(evaluated(spark, d)))


# what a system listed for a policy at the chosen configuration stands for its summary
_UC2 = f"""{_SWEEP}, {_CONSENSUS}, ul AS (SELECT system, policy, stance, arg_id FROM lists WHERE pool = {POOL_SIZE} AND k = {K}), ee AS (SELECT a, b, max(entail_fwd) AS e FROM (SELECT a, b, entail_fwd FROM edges WHERE rel = 'EQUIVALENT' AND a IS NOT NULL UNION ALL SELECT b, a, entail_bwd FROM edges WHERE rel = 'EQUIVALENT' AND a IS NOT NULL) WHERE entail_fwd IS NOT NULL GROUP BY ALL),
be AS (SELECT system, policy, arg_id, max(e) AS entail FROM (SELECT system, policy, arg_id, 1.0::DOUBLE AS e FROM ul UNION ALL SELECT system, policy, b, e FROM ul JOIN ee ON ee.a = ul.arg_id) GROUP BY ALL),
en AS (SELECT s.system, p.policy, p.stance, p.arg_id, be.entail FROM pool p JOIN (SELECT DISTINCT system, policy FROM ul) s USING (policy) LEFT JOIN be USING (system, policy, arg_id)),
cv AS (SELECT system, policy, avg(coalesce(entail > 0.5, false)::INTEGER) AS coverage, count(*) FILTER (coalesce(entail > 0.4, false)) AS n4, count(*) FILTER (coalesce(entail > 0.4, false) AND stance = 1) AS p4, avg((stance = 1)::INTEGER) AS src FROM en GROUP BY ALL),
pr AS (SELECT system, policy, coverage, CASE WHEN n4 > 0 THEN p4 / n4::DOUBLE ELSE src END AS pro_ratio, abs(CASE WHEN n4 > 0 THEN p4 / n4::DOUBLE ELSE src END - src) AS distortion FROM cv),
sv AS (SELECT system, policy, list(m ORDER BY i) AS v FROM (SELECT system, policy, i, avg(x) AS m FROM (SELECT system, policy, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM ul JOIN vecs USING (arg_id)) GROUP BY ALL) GROUP BY ALL),
rv AS (SELECT policy, list(m ORDER BY i) AS r FROM (SELECT policy, i, avg(x) AS m FROM (SELECT c.policy, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM cons c JOIN vecs USING (arg_id) WHERE grade >= 2) GROUP BY ALL) GROUP BY ALL),
pc AS (SELECT system, policy, list_cosine_similarity(v, r) AS score FROM sv JOIN rv USING (policy))"""


def summaries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lists of the chosen configuration, each system's mean vector per policy)."""
    one = type(S)(pools=(POOL_SIZE,), ks=(K,))
    lists = cut(all_lists(spark, d, one))
    return lists, mean_vector(lists.join(vectors(spark, d).select("arg_id", "u"), "arg_id"), ["system", "policy"], "u", S.vector_size, "v")


@query(f"""WITH RECURSIVE {_UC2} SELECT system, count(*) AS n_summaries, round(avg(coverage), 6) AS coverage_mean, round(stddev_pop(coverage), 6) AS coverage_std, round(avg(pro_ratio), 6) AS pro_ratio_mean, round(stddev_pop(pro_ratio), 6) AS pro_ratio_std,
  round(avg(distortion), 6) AS distortion_mean, round(stddev_pop(distortion), 6) AS distortion_std, round(avg(score), 6) AS score_mean, round(stddev_pop(score), 6) AS score_std FROM pr LEFT JOIN pc USING (system, policy) GROUP BY 1""")
def uc2_summary(spark: SparkSession, d: str) -> DataFrame:
    """By system: coverage, PRO share at the lower bar, its distortion, and closeness to the reference (the judged relevant arguments), mean and std over policies."""
    lists, means = summaries(spark, d)
    found = edges(spark, d).where("rel = 'EQUIVALENT' AND a IS NOT NULL")
    both = found.select(F.col("a").alias("premise"), F.col("b").alias("hypothesis"), F.col("entail_fwd").alias("entail")).union(found.select("b", "a", "entail_bwd"))
    entailments = both.where("entail IS NOT NULL").groupBy("premise", "hypothesis").agg(F.max("entail").alias("entail"))
    spoken = cut(sweep.entailed_by(lists, pool(spark, d), entailments))
    relevant = judged_items(spark, d).where("grade >= 2 AND u IS NOT NULL")
    references = mean_vector(relevant, ["policy"], "u", S.vector_size, "r")
    by = ["system", "policy"]
    each = metrics.coverage(spoken, by).join(sweep.pro_ratio(spoken, by), by).join(sweep.reference_cosine(means, references), by, "left")
    values = ["coverage", "pro_ratio", "distortion", "score"]
    counts = each.groupBy("system").agg(F.count(F.lit(1)).alias("n_summaries"))
    return rounded(counts.join(metrics.system_means(each, ["system"], values), "system"))


@query(f"""WITH RECURSIVE {_UC2}, n AS (SELECT policy, count(*) AS n FROM sv GROUP BY 1), d AS (SELECT a.policy, 1 - avg(list_cosine_similarity(a.v, b.v)) AS dv FROM sv a JOIN sv b ON a.policy = b.policy AND a.system < b.system GROUP BY 1)
SELECT policy, n AS n_systems, round(dv, 6) AS divergence FROM n LEFT JOIN d USING (policy)""")
def uc2_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How far the systems' summaries of each policy lie apart."""
    means = unit(summaries(spark, d)[1], "v", "w")
    sizes = means.groupBy("policy").agg(F.count(F.lit(1)).alias("n_systems"))
    return rounded(sizes.join(metrics.divergence(means, ["policy"], "w"), "policy"))


@query("""WITH p AS (SELECT DISTINCT policy FROM policies WHERE policy IS NOT NULL), x AS (SELECT policy, arg_max(text, (collected_at, doc_id)) FILTER (source = 'uc2_summary' AND text LIKE '%OVERALL_BALANCE: %') AS done,
 arg_max(text, (collected_at, doc_id)) FILTER (source = 'debate_essay') AS essay FROM documents WHERE policy IS NOT NULL GROUP BY 1),
w AS (SELECT policy, done, essay, CASE WHEN trim(regexp_replace(coalesce(essay, ''), '[\\s\\x{00A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(essay, '[\\s\\x{00A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]+', ' ', 'g')), ' ')) END AS n FROM p LEFT JOIN x USING (policy))
SELECT policy, CASE WHEN done IS NOT NULL THEN 'reuse' WHEN essay IS NULL THEN 'skip' WHEN n < 50 THEN 'drop' ELSE 'keep' END AS action FROM w""")
def uc2_plan(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each policy's summary: a labelled one is reused, without any text it is skipped, a paragraph that is too short is dropped."""
    docs = table(spark, d, "documents").where("policy IS NOT NULL")
    newest = F.struct("collected_at", "doc_id", "text")
    labelled = (F.col("source") == "uc2_summary") & F.col("text").contains("OVERALL_BALANCE: ")
    texts = docs.groupBy("policy").agg(F.max(F.when(labelled, newest))["text"].alias("done"), F.max(F.when((F.col("source") == "debate_essay") & F.col("text").isNotNull(), newest))["text"].alias("essay"))
    everyone = table(spark, d, "policies").where("policy IS NOT NULL").select("policy").distinct()
    return everyone.join(texts, "policy", "left").select("policy", metrics.summary_action("done", "essay").alias("action"))


QUERIES, ORACLES = query.queries, query.oracles
