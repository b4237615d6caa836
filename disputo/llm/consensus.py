"""Problem 7: consensus of several annotators, agreement and reliability.

Confidence-aware truth discovery: an annotator's weight is the chi-squared upper bound on the precision
of their labels (a quantile of chi-squared with as many degrees of freedom as they labelled items, divided
by their weighted distance to the consensus), so annotators with few labels are not trusted on luck.
Weights and consensus labels are estimated in turn until no label changes.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputo.runtime import cut, small


def valid_judgments(df: DataFrame, item: str = "item_id", annotator: str = "annotator_id", grade: str = "grade", at: str = "judged_at", lowest: int = 0, highest: int = 3) -> DataFrame:
    """(``item``, ``annotator``, ``grade``): each annotator's latest valid grade per item.

    NULL grades, grades outside lowest..highest and rows without item or annotator do not count; of grades given at
    the same time the higher one counts, so that repeated rows change nothing.
    """
    rows = df.select(F.col(item).alias("item"), F.col(annotator).alias("annotator"), F.col(grade).cast("int").alias("grade"), F.col(at).alias("at"))
    rows = rows.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("grade").between(lowest, highest))
    return rows.groupBy("item", "annotator").agg(F.max(F.struct("at", "grade"))["grade"].alias("grade"))


def chi_squared(p: float, degrees: Column) -> Column:
    """Quantile of chi-squared by the Wilson-Hilferty cube, as a column of the degrees of freedom."""
    z = NormalDist().inv_cdf(p)
    spread = F.lit(2.0) / (9 * degrees)
    return degrees * F.pow(F.greatest(1 - spread + z * F.sqrt(spread), F.lit(0.01)), 3)


def _votes(votes: DataFrame, weights: DataFrame | None) -> DataFrame:
    """(``item``, ``consensus``): the grade of the largest summed weight; ties go to more votes, then to the lower grade."""
    rows = votes.withColumn("weight", F.lit(1.0)) if weights is None else votes.join(small(weights), "annotator")
    scores = rows.groupBy("item", "grade").agg(F.round(F.sum("weight"), 9).alias("score"), F.count(F.lit(1)).alias("n"))
    return scores.groupBy("item").agg(F.max(F.struct("score", "n", (-F.col("grade")).alias("minus")))["minus"].alias("minus")).select("item", (-F.col("minus")).alias("consensus"))


def _distance(ordinal: bool) -> Column:
    return F.abs(F.col("grade") - F.col("consensus")).cast("double") if ordinal else (F.col("grade") != F.col("consensus")).cast("double")


def _settled(start: DataFrame, step, max_rounds: int) -> DataFrame:
    """The labels (``item``, ``consensus``) at which ``step`` (labels to labels, stored) changes nothing any more.

    Where the labels come back to an earlier state they would swing for ever; then every item takes the lowest of the labels it has
    in that cycle.  RuntimeError if neither happens within ``max_rounds``.
    """

    def signature(labels: DataFrame) -> tuple:
        return tuple(labels.agg(F.count(F.lit(1)), F.sum(F.xxhash64("item", "consensus").cast("decimal(38,0)"))).first())

    states, seen = [start], [signature(start)]
    for _ in range(max_rounds):
        states.append(step(states[-1]))
        now = signature(states[-1])
        if now == seen[-1]:
            return states[-1]
        if now in seen:
            cycle = reduce(DataFrame.union, states[seen.index(now) + 1 :])
            return cut(cycle.groupBy("item").agg(F.min("consensus").alias("consensus")))
        seen.append(now)
    raise RuntimeError(f"labels neither settle nor repeat in {max_rounds} rounds")


def truth_discovery(votes: DataFrame, alpha: float = 0.05, ordinal: bool = False, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(truth, weights) of ``votes`` (item, annotator, grade): truth has ``item``, ``consensus``; weights ``annotator``, ``weight``, ``n``, ``distance``.

    Starts from the plain majority and ends when no item's consensus changes (see _settled for labels that swing).
    An item with one annotator follows that annotator.
    """

    def weigh(truth: DataFrame) -> DataFrame:
        errors = votes.join(truth, "item").groupBy("annotator").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(_distance(ordinal)).alias("distance"))
        return cut(errors.withColumn("weight", chi_squared(alpha / 2, F.col("n")) / F.greatest("distance", F.lit(0.5))))

    truth = _settled(cut(_votes(votes, None)), lambda labels: cut(_votes(votes, weigh(labels).select("annotator", "weight"))), max_rounds)
    return truth, weigh(truth)


def consensus(judgments: DataFrame, alpha: float = 0.05, trust: float = 0.6, max_rounds: int = 60, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of raw judgments.

    items: ``item``, ``consensus_grade``, ``votes``, ``agreement`` (share of the item's annotators that gave the consensus).
    annotators: ``annotator``, ``n``, ``reliability`` (share of their items whose consensus they gave), ``weight``, ``trusted``.
    The truth-discovery labels say who gives the consensus on at least ``trust`` of their items; among
    these annotators the grade given most often wins (ties: larger weight, then the lower grade).  The two steps repeat until
    no label changes (see _settled for labels that swing).  An item that no trusted annotator labelled keeps its truth-discovery label.
    Items without a valid grade have no row.
    """
    votes = cut(valid_judgments(judgments, **columns))
    base, weights = truth_discovery(votes, alpha, max_rounds=max_rounds)

    def reliability(truth: DataFrame) -> DataFrame:
        rated = votes.join(truth, "item").groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("grade") == F.col("consensus")).cast("double")).alias("reliability"))
        return cut(rated.withColumn("trusted", F.col("reliability") >= trust))

    def vote(truth: DataFrame) -> DataFrame:
        trusted = reliability(truth).where("trusted").join(weights.select("annotator", "weight"), "annotator").select("annotator", "weight")
        scores = votes.join(small(trusted), "annotator").groupBy("item", "grade").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 9).alias("w"))
        picked = scores.groupBy("item").agg(F.max(F.struct("n", "w", (-F.col("grade")).alias("minus")))["minus"].alias("minus"))
        return cut(base.join(picked, "item", "left").select("item", F.coalesce(-F.col("minus"), F.col("consensus")).alias("consensus")))

    truth = _settled(base, vote, max_rounds)
    reliable = reliability(truth)
    items = votes.join(truth, "item").groupBy("item").agg(
        F.any_value("consensus").alias("consensus_grade"), F.count(F.lit(1)).alias("votes"), F.avg((F.col("grade") == F.col("consensus")).cast("double")).alias("agreement")
    )
    return items, reliable.join(weights.select("annotator", "weight"), "annotator")


def agreement(votes: DataFrame, groups: DataFrame, grades: int = 4) -> DataFrame:
    """Chance-corrected agreement per group: ``grp``, ``n_items``, ``kappa``, ``alpha_ordinal``.

    ``groups`` has (``item``, ``grp``).  Both statistics come from each item's grade histogram (at most ``grades`` numbers), never
    from pairs of annotators.  kappa weighs a disagreement by the squared distance of the grades; alpha is Krippendorff's with the
    ordinal distance.  Items with fewer than two grades do not count; a group without any has NULLs; no expected disagreement gives 1.
    """
    wide = [F.sum((F.col("grade") == g).cast("long")).alias(f"c{g}") for g in range(grades)]
    items = votes.groupBy("item").agg(*wide, F.count(F.lit(1)).alias("m")).where("m > 1").join(groups, "item")
    marginal = items.groupBy("grp").agg(*[F.sum(f"c{g}").cast("double").alias(f"n{g}") for g in range(grades)], F.count(F.lit(1)).alias("n_items"), F.sum("m").cast("double").alias("total"))
    pairs = [(g, h) for g in range(grades) for h in range(g + 1, grades)]
    observed = items.groupBy("grp").agg(*[F.sum(2.0 * F.col(f"c{g}") * F.col(f"c{h}") / (F.col("m") - 1)).alias(f"o{g}{h}") for g, h in pairs])
    both = marginal.join(observed, "grp")

    def ratio(distance) -> Column:
        do = sum((F.col(f"o{g}{h}") * distance(g, h) for g, h in pairs), F.lit(0.0)) / F.col("total")
        de = sum((2.0 * F.col(f"n{g}") * F.col(f"n{h}") * distance(g, h) for g, h in pairs), F.lit(0.0))
        return do, de

    ordinal = lambda g, h: F.pow(sum((F.col(f"n{k}") for k in range(g, h + 1)), F.lit(0.0)) - (F.col(f"n{g}") + F.col(f"n{h}")) / 2, 2)
    squared = lambda g, h: F.lit(float((g - h) ** 2))
    do, de = ratio(squared)
    kappa = F.when(de == 0, 1.0).otherwise(1 - do / (de / F.pow("total", 2)))
    do2, de2 = ratio(ordinal)
    alpha = F.when(de2 == 0, 1.0).otherwise(1 - do2 / (de2 / (F.col("total") * (F.col("total") - 1))))
    return both.select("grp", "n_items", kappa.alias("kappa"), alpha.alias("alpha_ordinal"))
