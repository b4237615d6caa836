"""Evaluation of retrieved lists and of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import acceptable_paragraph, exact_sum, gain, strip
from disputo.functions.vectors import dot, mean_vector
from disputo.operators.relations import chunked_pairs
from disputo.runtime import cut
from disputo.schema import DEFAULTS

RELEVANT = DEFAULTS.relevant_grade


def match_grades(lists: DataFrame, graded: DataFrame, floor: float = DEFAULTS.match_floor) -> DataFrame:
    """``lists`` (policy, stance, arg_id, text, u) with ``grade``, ``match`` and ``match_text``.

    Exact: the trimmed text is a graded one of the same policy and stance.  Else semantic: the nearest graded text's cosine is at
    least ``floor``.  Else none, with grade 0.  ``graded``: policy, stance, text, grade, u (unit vectors) - of equal texts the highest grade counts.
    Only what has no exact match is compared with vectors.
    """
    texts = graded.withColumn("key", strip("text")).groupBy("policy", "stance", "key").agg(F.max("grade").alias("gt_grade"), F.max_by("u", "grade").alias("gu"))
    keyed = lists.withColumn("key", strip("text"))
    exact = keyed.join(texts.drop("gu"), ["policy", "stance", "key"], "left")
    missing = keyed.join(texts, ["policy", "stance", "key"], "left_anti").where("u IS NOT NULL")
    # nearest texts by blocks of bounded size: a pool that holds a third of all rows becomes many tasks
    block = F.to_json(F.struct("policy", "stance"))
    left = missing.select(block.alias("block"), F.col("key").alias("id"), F.lit(0).cast("long").alias("tag"), "u").distinct()
    right = texts.where("gu IS NOT NULL").select(block.alias("block"), F.col("key").alias("id"), F.col("gt_grade").cast("long").alias("tag"), F.col("gu").alias("u"))
    near = chunked_pairs(cut(left), cut(right), floor).withColumns({"pool": F.from_json("block", "policy string, stance int"), "gt_grade": F.col("b_tag").cast("int")})
    best = near.groupBy(F.col("pool.policy").alias("policy"), F.col("pool.stance").alias("stance"), F.col("a").alias("key")).agg(F.max(F.struct(F.round("cosine", 9).alias("c"), F.expr("-gt_grade"), F.col("b").alias("gt_key"), F.col("gt_grade"))).alias("b"))
    joined = exact.join(best, ["policy", "stance", "key"], "left")
    match = F.when(F.col("gt_grade").isNotNull(), "exact").when(F.col("b").isNotNull(), "semantic").otherwise("none")
    return joined.select(*lists.columns, F.coalesce("gt_grade", F.col("b")["gt_grade"], F.lit(0)).alias("grade"), match.alias("match"), F.when(F.col("gt_grade").isNotNull(), F.col("key")).otherwise(F.col("b")["gt_key"]).alias("match_text"))


def dcg(grade: Column | str, rank: Column | str, exponential: bool = True) -> Column:
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.sum(gain(grade, exponential) / F.log2(rank + 1.0))


def ideal_dcg(graded: DataFrame, by: list[str], k: int, exponential: bool = True) -> DataFrame:
    """The best possible DCG of each group's k highest grades (one per text)."""
    ranked = graded.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("grade"), "text"))).where(F.col("rank") <= k)
    return ranked.groupBy(*by).agg(dcg("grade", "rank", exponential).alias("idcg"))


def ranking_metrics(matched: DataFrame, graded: DataFrame, by: list[str], k: int, exponential: bool = True) -> DataFrame:
    """Per list: ndcg, precision, recall, mean_rel, exact_share, semantic_share, none_share, n_items.

    ``matched``: by, rank, grade, match, match_text; ``graded``: by, text, grade (one per text).  Precision divides by the list's length, mean_rel by
    k; ndcg is 0 without an ideal; recall counts graded texts once and is NULL where nothing is relevant.
    """
    graded = graded.groupBy(*by, "text").agg(F.max("grade").alias("grade"))
    relevant = F.col("grade") >= RELEVANT
    pools = graded.groupBy(*by).agg(F.count_if(relevant).alias("n_relevant"))
    lists = matched.where(F.col("rank") <= k).groupBy(*by).agg(
        dcg("grade", "rank", exponential).alias("dcg"), F.count(F.lit(1)).alias("n_items"), F.avg(relevant.cast("double")).alias("precision"),
        F.countDistinct(F.when(relevant, F.col("match_text"))).alias("n_hit"), (F.sum("grade") / k).alias("mean_rel"),
        *[F.avg((F.col("match") == m).cast("double")).alias(f"{m}_share") for m in ("exact", "semantic")],
    )
    joined = lists.join(pools, by, "left").join(ideal_dcg(graded, by, k, exponential), by, "left")
    return joined.select(
        *by, "n_items", F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), F.lit(0.0)).alias("ndcg"), "precision",
        (F.col("n_hit") / F.nullif("n_relevant", F.lit(0))).alias("recall"), "mean_rel", "exact_share", "semantic_share",
        (1 - F.col("exact_share") - F.col("semantic_share")).alias("none_share"),
    )


def subtopic_recall(matched: DataFrame, clusters: DataFrame, by: list[str], k: int) -> DataFrame:
    """Share of a group's relevant clusters that the first k hit; NULL below two clusters.  ``clusters``: by, text, cluster."""
    totals = clusters.groupBy(*by).agg(F.countDistinct("cluster").alias("n_clusters"))
    hits = matched.where((F.col("rank") <= k) & (F.col("grade") >= RELEVANT)).join(clusters.withColumnRenamed("text", "match_text"), [*by, "match_text"])
    hit = hits.groupBy(*by).agg(F.countDistinct("cluster").alias("n_hit"))
    return totals.join(hit, by, "left").select(*by, F.when(F.col("n_clusters") >= 2, F.coalesce("n_hit", F.lit(0)) / F.col("n_clusters")).alias("s_recall"))


def diversity(lists: DataFrame, by: list[str], relevant_only: bool = False, size: int = DEFAULTS.vector_size) -> DataFrame:
    """1 - mean pairwise cosine of each list, 0 below two items; with ``relevant_only`` over its items of grade >= 2.

    ``lists``: by, u (unit vectors; items without one do not count), grade.  From vector sums, without pairs.
    """
    counted = F.col("u").isNotNull() & ((F.col("grade") >= RELEVANT) if relevant_only else F.lit(True))
    sums = mean_vector(lists.where(counted), by, "u", size)
    n = F.col("n_vectors")
    value = F.when(n > 1, 1 - (dot("centroid", "centroid") * n * n - n) / (n * (n - 1))).otherwise(0.0)
    return lists.select(*by).distinct().join(sums.select(*by, value.alias("ild")), by, "left").select(*by, F.coalesce("ild", F.lit(0.0)).alias("ild"))


def distractor_rate(lists: DataFrame, manifest: DataFrame | None, by: list[str]) -> DataFrame:
    """Share of a list's items in the manifest (trimmed text, policy, stance); NULL without a manifest."""
    if manifest is None:
        return lists.select(*by).distinct().withColumn("distractor_rate", F.lit(None).cast("double"))
    known = manifest.select("policy", "stance", strip("text").alias("key"), F.lit(1.0).alias("hit")).distinct()
    flagged = lists.withColumn("key", strip("text")).join(known, ["policy", "stance", "key"], "left")
    return flagged.groupBy(*by).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("distractor_rate"))


def conflict(lists: DataFrame, scores: DataFrame, by: list[str], bar: float = 0.5) -> DataFrame:
    """Per group: mean P(contradiction) over PRO x CON pairs of the lists (``conflict_density``) and pairs above ``bar`` (``n_conflicts``).

    ``scores``: premise, hypothesis, contra; pairs without a score count as 0; 0 where a side is empty.  Only scored pairs are joined; the number
    of all pairs is the product of the sides' sizes.
    """
    sides = lists.groupBy(*by).agg(F.count_if(F.col("stance") == 1).alias("n_pro"), F.count_if(F.col("stance") == -1).alias("n_con"))
    pro = lists.where("stance = 1").select(*by, F.col("arg_id").alias("premise"))
    con = lists.where("stance = -1").select(*by, F.col("arg_id").alias("hypothesis"))
    scored = scores.join(pro, "premise").join(con, [*by, "hypothesis"])
    sums = scored.groupBy(*by).agg(exact_sum("contra").cast("double").alias("total"), F.count_if(F.col("contra") > bar).alias("n_conflicts"))
    pairs = F.col("n_pro") * F.col("n_con")
    return sides.join(sums, by, "left").select(*by, F.when(pairs > 0, F.coalesce("total", F.lit(0.0)) / pairs).otherwise(0.0).alias("conflict_density"), F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))


def pair_mean(a: Column | str, b: Column | str, lenient: bool = False) -> Column:
    """Mean of PRO and CON: NULL if either is, or with ``lenient`` the mean of what there is."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce((a + b) / 2, a, b) if lenient else (a + b) / 2


def system_means(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean and population std of every metric over policies; NULLs do not count."""
    return metrics.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def coverage(df: DataFrame, by: list[str], entail: str = "entail", bar: float = 0.5) -> DataFrame:
    """Share of a group's arguments that its summary entails (P > bar, strict); NULL scores do not entail."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(F.col(entail) > bar, F.lit(False)).cast("double")).alias("coverage"))


def stance_balance(df: DataFrame, by: list[str], covered: str = "covered") -> DataFrame:
    """1 - 2 |p - 0.5| with p the PRO share of covered arguments; NULL where a side has no argument, 0 where none is covered."""
    c = F.col(covered)
    sides = df.groupBy(*by).agg(
        F.count_if(F.col("stance") == 1).alias("n_pro"), F.count_if(F.col("stance") == -1).alias("n_con"),
        F.count_if((F.col("stance") == 1) & c).alias("pro"), F.count_if((F.col("stance") == -1) & c).alias("con"),
    )
    p = F.col("pro") / (F.col("pro") + F.col("con"))
    balance = F.when((F.col("n_pro") == 0) | (F.col("n_con") == 0), F.lit(None).cast("double")).when(F.col("pro") + F.col("con") == 0, 0.0).otherwise(1 - 2 * F.abs(p - 0.5))
    source = F.col("n_pro") / F.nullif(F.col("n_pro") + F.col("n_con"), F.lit(0))
    distortion = F.abs(F.when(F.col("pro") + F.col("con") > 0, p).otherwise(source) - source)
    return sides.select(*by, balance.alias("balance"), distortion.alias("distortion"))


def divergence(df: DataFrame, by: list[str], vector: str = "u", size: int = DEFAULTS.vector_size) -> DataFrame:
    """1 - mean pairwise cosine of the systems' summaries of each group; NULL below two."""
    sums = mean_vector(df, by, vector, size)
    n = F.col("n_vectors")
    return sums.select(*by, F.when(n > 1, 1 - (dot("centroid", "centroid") * n * n - n) / (n * (n - 1))).alias("divergence"))


def faithfulness(claims: DataFrame, summaries: DataFrame, by: list[str]) -> DataFrame:
    """Supported claims / claims; 0 for a summary without claims; claims whose verdict could not be read (NULL) do not count."""
    judged = claims.where("supported IS NOT NULL").groupBy(*by).agg(F.avg(F.col("supported").cast("double")).alias("f"))
    return summaries.select(*by).distinct().join(judged, by, "left").select(*by, F.coalesce("f", F.lit(0.0)).alias("faithfulness"))


def rubric_means(scores: DataFrame, record: list[str], by: list[str], low: float = 1, high: float = 5) -> DataFrame:
    """Mean score per group and criterion over records all of whose scores lie in low..high."""
    bad = scores.groupBy(*record).agg(F.count_if(F.coalesce(~F.col("score").between(low, high), F.lit(True))).alias("bad")).where("bad = 0").drop("bad")
    return scores.join(bad, record, "left_semi").groupBy(*by).agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def pairwise_winner(first: Column | str, second: Column | str) -> Column:
    """The winner of two orderings of one comparison: the system both verdicts name, else a tie; NULL if a verdict is missing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (first, second))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, a).otherwise("tie")


def win_rates(df: DataFrame, by: list[str], winner: str, system: str) -> DataFrame:
    w = F.col(winner)
    return df.where(w.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(w == system).alias("wins"), F.count_if(w == "tie").alias("ties"),
        F.round(F.avg((w == system).cast("double")), 4).alias("win_rate"), F.round(F.avg((w == "tie").cast("double")), 4).alias("tie_rate"),
    )


def summary_action(existing: Column | str, candidate: Column | str) -> Column:
    """'reuse' an existing summary, 'skip' where there is no candidate, 'drop' a candidate that is no acceptable paragraph, else 'keep'."""
    done, text = (F.col(x) if isinstance(x, str) else x for x in (existing, candidate))
    return F.when(done.isNotNull(), "reuse").when(text.isNull(), "skip").when(~acceptable_paragraph(text), "drop").otherwise("keep")


def format_comparison(structured: DataFrame, paragraph: DataFrame, by: list[str], value: str) -> DataFrame:
    """Both formats' values side by side and their difference where both are there."""
    both = structured.select(*by, F.col(value).alias("structured")).join(paragraph.select(*by, F.col(value).alias("paragraph")), by, "full")
    return both.withColumn("delta", F.col("structured") - F.col("paragraph"))
