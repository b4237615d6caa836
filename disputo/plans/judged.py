"""Queries over graded judgments: consensus, agreement, base rates, parsed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions import parsing, scalars
from disputo.operators import corpus, judgments
from disputo.plans._views import ARGS, POOL, RATED, Registry, arguments, pool, raters, rounded
from disputo.runtime import table
from disputo.sources import files

query = Registry()
_RULES = ("min", "max", "mean", "primary")
_CONSENSUS = f"""{RATED}, cons AS (SELECT *, list_min(grades) AS grade FROM rated)"""


def graded(spark: SparkSession, d: str) -> DataFrame:
    """Items with the lowest grade of all their raters."""
    return raters(spark, d).withColumn("grade", judgments.consensus_of_all("grades"))


@query(f"""WITH {RATED} SELECT item_id, list_min(grades) AS g_min, list_max(grades) AS g_max, floor(list_avg(grades) + 0.5)::INTEGER AS g_mean, grades[1] AS g_primary FROM rated""")
def judged_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Consensus of all raters of an item by all four rules."""
    return raters(spark, d).select("item_id", *[judgments.consensus_of_all("grades", r).alias(f"g_{r}") for r in _RULES])


_HIST = "count(*) FILTER (grade = 0) AS n_0, count(*) FILTER (grade = 1) AS n_1, count(*) FILTER (grade = 2) AS n_2, count(*) FILTER (grade = 3) AS n_3, count(grade) AS n_graded, count(*) FILTER (grade >= 2) AS n_relevant"


@query(f"WITH {_CONSENSUS} SELECT policy, stance, {_HIST} FROM cons GROUP BY ALL")
def judged_histogram(spark: SparkSession, d: str) -> DataFrame:
    return judgments.histogram(graded(spark, d), ["policy", "stance"], "grade")


@query(f"WITH {_CONSENSUS} SELECT stance, {_HIST} FROM cons GROUP BY ALL")
def judged_merged_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of policies added up per stance."""
    return judgments.merge_histograms(judgments.histogram(graded(spark, d), ["policy", "stance"], "grade"), ["stance"])


@query(f"""WITH {_CONSENSUS}, h AS (SELECT policy, {_HIST} FROM cons GROUP BY 1) SELECT policy, CASE WHEN n_graded = 0 THEN '(no data)' ELSE printf('%.1f', n_relevant * 100.0::DOUBLE / n_graded) || '%' END AS relevant FROM h""")
def judged_percentages(spark: SparkSession, d: str) -> DataFrame:
    h = judgments.histogram(graded(spark, d), ["policy"], "grade")
    return h.select("policy", scalars.percent("n_relevant", "n_graded").alias("relevant"))


def _agree_sql(key: str, join: str = "") -> str:
    """Agreement of all pairs of raters per ``key``, as a table ``agree``: every pair counts once in either order, alpha weighs it by 1 / (raters - 1)."""
    return f"""{RATED}, vk AS (SELECT v.item_id, annotator_id, grade, {key} AS k, len(r.grades) AS m FROM votes v JOIN (SELECT item_id, arg_id AS about, policy, stance, grades FROM rated) r USING (item_id) {join} WHERE len(r.grades) > 1),
pr AS (SELECT x.k, x.grade AS a, y.grade AS b, 1.0::DOUBLE / (x.m - 1) AS w FROM vk x JOIN vk y ON x.item_id = y.item_id AND x.annotator_id <> y.annotator_id),
obs AS (SELECT k, count(*)::DOUBLE AS n2, avg((a - b) * (a - b) / 9.0::DOUBLE) AS o, avg(((a >= 2) = (b >= 2))::INTEGER) AS po, avg((a >= 2)::INTEGER) AS pa, avg((b >= 2)::INTEGER) AS pb FROM pr GROUP BY 1),
ca AS (SELECT k, a AS g, count(*)::DOUBLE AS c FROM pr GROUP BY ALL), ex AS (SELECT x.k, sum(x.c * y.c * (x.g - y.g) * (x.g - y.g) / 9.0::DOUBLE) AS e FROM ca x JOIN ca y USING (k) GROUP BY 1),
nv AS (SELECT k, grade AS g, count(*)::DOUBLE AS c FROM vk GROUP BY ALL), gs AS (SELECT unnest([0, 1, 2, 3]) AS g), full_nv AS (SELECT p.k, gs.g, coalesce(c, 0) AS c FROM (SELECT DISTINCT k FROM vk) p CROSS JOIN gs LEFT JOIN nv ON nv.k = p.k AND nv.g = gs.g),
gap AS (SELECT x.k, x.g AS g, y.g AS h, x.c AS ng, y.c AS nh, power((x.c + y.c) / 2 + coalesce((SELECT sum(z.c) FROM full_nv z WHERE z.k = x.k AND z.g > x.g AND z.g < y.g), 0), 2) AS dd FROM full_nv x JOIN full_nv y ON x.k = y.k AND x.g < y.g),
dob AS (SELECT pr.k, sum(coalesce(gap.dd, 0) * w) / 2 AS s FROM pr LEFT JOIN gap ON gap.k = pr.k AND gap.g = least(a, b) AND gap.h = greatest(a, b) GROUP BY 1), dex AS (SELECT k, sum(2 * ng * nh * dd) AS s FROM gap GROUP BY 1), sz AS (SELECT k, count(*)::DOUBLE AS n FROM vk GROUP BY 1),
agree AS (SELECT k, (n2 / 2)::BIGINT AS n_pairs, CASE WHEN e = 0 THEN 1.0 ELSE 1 - o / (e / (n2 * n2)) END AS qwk, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 THEN 1.0 ELSE (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) END AS binary_kappa,
  CASE WHEN n2 / 2 < 2 THEN NULL WHEN dex.s = 0 THEN 1.0 ELSE 1 - (dob.s / (n / 2)) / (dex.s / (n * (n - 1))) END AS alpha_ordinal FROM obs JOIN ex USING (k) JOIN dob USING (k) JOIN dex USING (k) JOIN sz USING (k))"""


_AGREE = _agree_sql("r.policy")


@query(f"WITH {_AGREE} SELECT k AS policy, n_pairs, round(qwk, 6) + 0.0 AS qwk, round(binary_kappa, 6) + 0.0 AS binary_kappa, round(alpha_ordinal, 6) + 0.0 AS alpha_ordinal FROM agree")
def judged_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Weighted kappa, binary kappa and ordinal alpha of all pairs of raters per policy."""
    return rounded(judgments.agreement_of_all(raters(spark, d), ["policy"]))


@query(f"""WITH {ARGS}, {_agree_sql("coalesce(g.is_distractor, false)", "LEFT JOIN args g ON g.arg_id = r.about")} SELECT k AS is_distractor, n_pairs, round(qwk, 6) + 0.0 AS qwk, round(binary_kappa, 6) + 0.0 AS binary_kappa, round(alpha_ordinal, 6) + 0.0 AS alpha_ordinal FROM agree""")
def judged_kappa_split(spark: SparkSession, d: str) -> DataFrame:
    """Agreement over native and over distractor arguments."""
    flags = arguments(spark, d, "is_distractor").select("arg_id", "is_distractor")
    rows = raters(spark, d).join(flags, "arg_id", "left").withColumn("is_distractor", F.coalesce("is_distractor", F.lit(False)))
    return rounded(judgments.agreement_of_all(rows, ["is_distractor"]))


_SHARES = ", ".join(f"CASE WHEN n_graded = 0 THEN '(no data)' ELSE printf('%.1f', n_{g} * 100.0::DOUBLE / n_graded) || '%' END AS share_{g}" for g in range(4))


@query(f"""WITH {_CONSENSUS}, h AS (SELECT policy, {_HIST} FROM cons GROUP BY 1) SELECT policy, {_SHARES} FROM h""")
def judged_grade_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all four grades per policy."""
    return judgments.grade_shares(judgments.histogram(graded(spark, d), ["policy"], "grade"), ["policy"])


@query(f"""WITH {_AGREE}, p AS (SELECT DISTINCT policy FROM rated), f AS (SELECT CASE WHEN qwk IS NULL THEN 'SINGLE_ANNOTATOR' WHEN round(qwk, 9) >= 0.6 THEN 'HIGH' WHEN round(qwk, 9) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS flag FROM p LEFT JOIN agree ON agree.k = p.policy) SELECT flag, count(*) AS n FROM f GROUP BY 1""")
def judged_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = graded(spark, d)
    agree = judgments.agreement_of_all(raters(spark, d), ["policy"])
    joined = rows.select("policy").distinct().join(agree, "policy", "left")
    return joined.groupBy(judgments.flag(F.round("qwk", 9)).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_AGREE} SELECT count(qwk) AS n, round(avg(qwk), 4) AS mean, round(stddev_pop(qwk), 4) AS std, round(min(qwk), 4) AS low, round(max(qwk), 4) AS high FROM agree")
def judged_kappa_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(judgments.summary(judgments.agreement_of_all(raters(spark, d), ["policy"]), "qwk"))


@query(f"""WITH {_agree_sql("r.policy || '|' || r.stance")}, p AS (SELECT policy, max(CASE WHEN stance = 1 THEN alpha_ordinal END) AS pro, max(CASE WHEN stance = -1 THEN alpha_ordinal END) AS con
FROM (SELECT r.policy, r.stance, alpha_ordinal FROM (SELECT DISTINCT policy, stance FROM rated) r JOIN agree a ON a.k = r.policy || '|' || r.stance) GROUP BY 1)
SELECT policy, round(CASE WHEN pro IS NULL THEN con WHEN con IS NULL THEN pro ELSE (pro + con) / 2 END, 6) AS alpha FROM p""")
def judged_stance_alpha(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the PRO and CON alphas that exist."""
    each = judgments.agreement_of_all(raters(spark, d), ["policy", "stance"])
    sides = [F.max(F.when(F.col("stance") == s, F.col("alpha_ordinal"))).alias(n) for s, n in ((1, "pro"), (-1, "con"))]
    return rounded(each.groupBy("policy").agg(*sides).select("policy", judgments.mean_of_present("pro", "con").alias("alpha")))


@query(f"""WITH {_AGREE}, p AS (SELECT DISTINCT policy FROM rated), r AS (SELECT policy, coalesce(printf('%.3f', round(qwk, 9)), '-') AS kappa, row_number() OVER (ORDER BY round(qwk, 9) ASC NULLS LAST, policy)::INTEGER AS place FROM p LEFT JOIN agree ON agree.k = p.policy) SELECT * FROM r""")
def judged_report(spark: SparkSession, d: str) -> DataFrame:
    """Policies by agreement, those without last, as a printable table."""
    rows = graded(spark, d)
    agree = judgments.agreement_of_all(raters(spark, d), ["policy"]).withColumn("kappa", F.round("qwk", 9))
    joined = rows.select("policy").distinct().join(agree, "policy", "left")
    placed = joined.withColumn("place", F.row_number().over(W.orderBy(F.asc_nulls_last("kappa"), "policy")))
    return files.report(placed.select("policy", "kappa", "place"), ["kappa"])


@query(f"""WITH {_CONSENSUS}, {ARGS}, f AS (SELECT c.policy, coalesce(a.is_distractor, false) AS is_distractor, grade FROM cons c LEFT JOIN args a USING (arg_id)) SELECT is_distractor, count(*) FILTER (grade >= 2) AS n_relevant, count(*) AS n_pool, round(count(*) FILTER (grade >= 2) / count(*)::DOUBLE, 6) AS base_rate FROM f GROUP BY 1""")
def judged_base_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of relevant items among native and distractor arguments."""
    flags = arguments(spark, d, "is_distractor").select("arg_id", "is_distractor")
    rows = graded(spark, d).join(flags, "arg_id", "left").withColumn("is_distractor", F.coalesce("is_distractor", F.lit(False)))
    return rounded(judgments.base_rates(rows, ["is_distractor"]))


@query(f"""WITH {_CONSENSUS}, b AS (SELECT policy, count(*) FILTER (grade >= 2) / count(*)::DOUBLE AS base_rate FROM cons GROUP BY 1) SELECT policy, round(base_rate, 6) AS base_rate, row_number() OVER (ORDER BY CASE WHEN base_rate IS NULL OR base_rate = 0 THEN 1.0 ELSE base_rate END, policy)::INTEGER AS place FROM b""")
def judged_base_rate_order(spark: SparkSession, d: str) -> DataFrame:
    """Policies by base rate; a missing or zero rate sorts as 1."""
    rates = judgments.base_rates(graded(spark, d), ["policy"])
    key = F.when(F.col("base_rate").isNull() | (F.col("base_rate") == 0), 1.0).otherwise(F.col("base_rate"))
    return rounded(rates.withColumn("place", F.row_number().over(W.orderBy(key, "policy"))).select("policy", "base_rate", "place"))


@query(f"WITH {ARGS} SELECT policy, count(*) FILTER (stance = 1) AS n_pro, count(*) FILTER (stance = -1) AS n_con FROM args GROUP BY 1 HAVING n_pro >= 2 AND n_con >= 2")
def judged_policies(spark: SparkSession, d: str) -> DataFrame:
    """Policies with at least two arguments of each stance."""
    return judgments.judged_policies(arguments(spark, d, "policy", "stance"))


@query(f"""WITH {_CONSENSUS}, {ARGS}, t AS (SELECT c.policy, c.stance, a.argument AS text, c.grade, coalesce(a.is_distractor, false) AS dd FROM cons c JOIN args a USING (arg_id)), frozen AS (SELECT * FROM t WHERE NOT dd),
u AS (SELECT policy, stance, text, grade FROM frozen UNION ALL SELECT policy, stance, text, grade FROM t WHERE dd AND grade IS NOT NULL AND policy IN (SELECT policy FROM frozen)) SELECT policy, stance, text, max(grade) AS grade FROM u GROUP BY ALL""")
def judged_merged(spark: SparkSession, d: str) -> DataFrame:
    """Frozen native grades with the distractors' grades added, the highest per text."""
    rows = graded(spark, d).join(arguments(spark, d, "argument", "is_distractor").select("arg_id", F.col("argument").alias("text"), F.coalesce("is_distractor", F.lit(False)).alias("dd")), "arg_id")
    return judgments.merge_judgments(rows.where("NOT dd"), rows.where("dd"))


@query()
def judged_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Resampled interval of the mean kappa (numpy's generator; tested against numpy)."""
    agree = judgments.agreement_of_all(raters(spark, d), ["policy"]).withColumn("statistic", F.lit("qwk"))
    return judgments.bootstrap(agree, ["statistic"], "qwk")


@query(f"SELECT DISTINCT policy, stance, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM ({query.oracles["judged_merged"]}) WHERE grade >= 2")
def judged_relevant(spark: SparkSession, d: str) -> DataFrame:
    """The relevant texts of each pool, native and added, each once."""
    return judgments.relevant_texts(judged_merged(spark, d))


@query(f"""WITH {POOL} SELECT policy, stance, arg_id, rn - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY policy, stance ORDER BY pool_pos) AS rn FROM pool WHERE trim(text) <> '') WHERE rn <= 200""")
def judged_pool(spark: SparkSession, d: str) -> DataFrame:
    """What raters are shown: the first 200 texts of each pool that are not empty (the cap comes after the filter)."""
    rows = pool(spark, d, text=True).where(scalars.strip("text") != "").select("policy", "stance", "arg_id", "pool_pos")
    return corpus.positional_ids(rows, ["pool_pos"], "pos", by=["policy", "stance"]).where("pos < 200").select("policy", "stance", "arg_id", "pos")


@query("""WITH j AS (SELECT annotator_id, grade, row_number() OVER (PARTITION BY annotator_id ORDER BY item_id, judged_at, loaded_at) - 1 AS place FROM graded_judgments), w AS (SELECT annotator_id, (place // 30)::INTEGER AS batch, place % 30 + 1 AS rn, grade FROM j),
n AS (SELECT annotator_id, batch, count(*) AS expected FROM w GROUP BY ALL), ok AS (SELECT annotator_id, batch, rn, grade FROM w WHERE grade BETWEEN 0 AND 3), c AS (SELECT annotator_id, batch, expected FROM n JOIN (SELECT annotator_id, batch, count(*) AS k FROM ok GROUP BY ALL) USING (annotator_id, batch) WHERE k >= expected * 0.9)
SELECT c.annotator_id, c.batch, i.id::INTEGER AS id, ok.grade FROM c, LATERAL (SELECT unnest(range(1, expected + 1)) AS id) i LEFT JOIN ok ON ok.annotator_id = c.annotator_id AND ok.batch = c.batch AND ok.rn = i.id""")
def judged_parsed_answers(spark: SparkSession, d: str) -> DataFrame:
    """All judgments of each annotator in batches of 30, written as model answers and parsed again; a batch below 90 % is rejected."""
    rows = table(spark, d, "graded_judgments").select("annotator_id", "item_id", "judged_at", "loaded_at", "grade")
    rows = corpus.positional_ids(rows, ["item_id", "judged_at", "loaded_at"], "place", by=["annotator_id"])
    rows = rows.withColumns({"batch": F.floor(F.col("place") / 30).cast("int"), "rn": F.col("place") % 30 + 1})
    rows = rows.withColumn("key", F.to_json(F.struct("annotator_id", "batch"), {"ignoreNullFields": "false"}))
    entry = F.format_string('{"id": %d, "grade": %s}', F.col("rn"), F.coalesce(F.col("grade").cast("string"), F.lit("null")))
    answers = rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", entry.alias("e")))), lambda x: x["e"]), ", ").alias("list"), F.count(F.lit(1)).alias("expected"))
    raw = F.concat(F.lit('<think>grading</think>```json\n{"grades": ['), F.col("list"), F.lit("]}```"))
    parsed = parsing.parse_grades(answers.withColumn("raw", raw), "key", "raw", "expected")
    key = F.from_json("key", "annotator_id string, batch int")
    return parsed.select(key["annotator_id"].alias("annotator_id"), key["batch"].alias("batch"), "id", "grade")


_SPACE = r"[\s\x{00A0}\x{2007}\x{2009}\x{202F}\x{3000}]"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?is)<think(ing)?>.*?</think(ing)?>', '', 'g'), '```(?:json)?', '', 'g') AS x FROM documents),
v AS (SELECT doc_id, upper(regexp_extract(x, '(?m)^{_SPACE}*([ABab])(?:[^A-Za-z]|$)', 1)) AS verdict FROM t) SELECT doc_id, verdict FROM v WHERE verdict <> ''""")
def text_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """All documents in which a verdict can be read: a line that starts with a lone A or B."""
    return table(spark, d, "documents").select("doc_id", parsing.parse_ab("text").alias("verdict")).where("verdict IS NOT NULL")


@query("""WITH s AS (SELECT doc_id, text, regexp_extract(text, '(?s)(?:^|\\n)KEY_TENSION: (.*?)(?:\\n(?:STRONGEST_PRO|STRONGEST_CON|MISSING_PERSPECTIVES|OVERALL_BALANCE): |$)', 1) AS t FROM documents WHERE text LIKE '%STRONGEST_PRO: %' AND text LIKE '%STRONGEST_CON: %' AND text LIKE '%KEY_TENSION: %' AND text LIKE '%MISSING_PERSPECTIVES: %' AND text LIKE '%OVERALL_BALANCE: %')
SELECT doc_id, t AS key_tension FROM s WHERE regexp_matches(text, '(?:^|\\n)KEY_TENSION: ')""")
def text_summary_fields(spark: SparkSession, d: str) -> DataFrame:
    """The key tension of every labelled summary."""
    docs = table(spark, d, "documents")
    for name in scalars.SUMMARY_FIELDS:
        docs = docs.where(F.col("text").contains(f"{name}: "))
    return docs.select("doc_id", scalars.summary_field("text", "KEY_TENSION").alias("key_tension")).where("key_tension IS NOT NULL")


@query("""SELECT event_id, (props->>'k')::INTEGER AS k FROM events""")
def text_parsed_json(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects cut inside a list, repaired and parsed (each event's properties, followed by such a list)."""
    broken = F.concat(F.lit("Answer: "), F.regexp_replace("props", r"\}$", ""), F.lit(', "grades": [{"id": 1}'))
    parsed = parsing.parse_json_object(broken, "k int", ("k",), list_recovery=True)
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"))


QUERIES, ORACLES = query.queries, query.oracles
