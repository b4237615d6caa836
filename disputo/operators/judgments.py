"""Graded relevance judgments of two raters: consensus, histograms, agreement, bootstrap, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputo.functions.scalars import half_up, percent, strip
from disputo.schema import DEFAULTS

GRADES = (0, 1, 2, 3)


def consensus(primary: Column | str, secondary: Column | str, rule: str = "min") -> Column:
    """One grade of two: min, max, mean (halves up) or primary; the only one where one is NULL; an unknown rule is min."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (primary, secondary))
    both = {"max": F.greatest(a, b), "mean": half_up((a + b) / 2), "primary": a}.get(rule, F.least(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(F.coalesce(a, b))


def consensus_of_all(grades: Column | str, rule: str = "min") -> Column:
    """One grade of a list of any length: min, max, mean (halves up) or primary (the first); an unknown rule is min."""
    g = F.col(grades) if isinstance(grades, str) else grades
    total = F.aggregate(g, F.lit(0.0), lambda s, x: s + x)
    return {"max": F.array_max(g), "mean": half_up(total / F.nullif(F.size(g), F.lit(0))), "primary": F.try_element_at(g, F.lit(1))}.get(rule, F.array_min(g))


def histogram(df: DataFrame, by: list[str], grade: str) -> DataFrame:
    """n_0 .. n_3 (0 where a grade does not occur), ``n_graded`` and ``n_relevant`` (grade >= 2) per group."""
    g = F.col(grade)
    return df.groupBy(*by).agg(*[F.count_if(g == x).alias(f"n_{x}") for x in GRADES], F.count(g).alias("n_graded"), F.count_if(g >= DEFAULTS.relevant_grade).alias("n_relevant"))


def merge_histograms(df: DataFrame, by: list[str]) -> DataFrame:
    """Histograms of finer groups added up."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (*[f"n_{x}" for x in GRADES], "n_graded", "n_relevant")])


def _confusion(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Counts of all grade pairs per group (rows with both grades), one row per group: o_ij, n."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = [F.count_if((F.col(a) == i) & (F.col(b) == j)).cast("double").alias(f"o_{i}{j}") for i in GRADES for j in GRADES]
    return rows.groupBy(*by).agg(*cells, F.count(F.lit(1)).alias("n_pairs"))


def _plus(columns) -> Column:
    return sum(columns, F.lit(0.0))


def agreement(df: DataFrame, by: list[str], a: str = "grade_primary", b: str = "grade_secondary") -> DataFrame:
    """Agreement of two raters per group: ``n_pairs``, ``qwk``, ``binary_kappa``, ``alpha_ordinal``.

    Everything follows from the 16 counts of grade pairs, so one combined aggregate does it.  qwk is 1 where no disagreement is expected;
    binary kappa (grade >= 2) is 1 where agreement is certain by chance; alpha is NULL below two pairs and 1 where one value is used.
    Groups without a pair have no row.
    """
    c = _confusion(df, by, a, b)
    n = F.col("n_pairs")
    o = {(i, j): F.col(f"o_{i}{j}") for i in GRADES for j in GRADES}
    qwk, binary = _kappas(o, n)
    return c.select(*by, "n_pairs", qwk.alias("qwk"), binary.alias("binary_kappa"), _alpha(o, n).alias("alpha_ordinal"))


def agreement_of_all(df: DataFrame, by: list[str], grades: str = "grades") -> DataFrame:
    """The same of any number of raters per item (``grades``: list): every pair of raters of an item counts, half in either order.

    Raters have no first and second place here, so both margins of kappa are the same.  Alpha weighs an item's pairs by 1 / (raters - 1),
    as Krippendorff does.  All from each item's grade counts, so no pair is formed.
    """
    k = {f"k_{g}": F.size(grades) - F.size(F.array_remove(grades, g)) for g in GRADES}
    rows = df.where(F.size(grades) > 1).withColumns(k | {"m": F.size(grades)})
    pair = {(i, j): F.col(f"k_{i}") * (F.col(f"k_{j}") - (1 if i == j else 0)) / 2 for i in GRADES for j in GRADES}
    cells = [F.sum(p).alias(f"o_{i}{j}") for (i, j), p in pair.items()] + [F.sum(p / (F.col("m") - 1)).alias(f"w_{i}{j}") for (i, j), p in pair.items()]
    c = rows.groupBy(*by).agg(*cells, F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("n_pairs"), (F.sum("m") / 2).alias("half"))
    qwk, binary = _kappas({p: F.col(f"o_{p[0]}{p[1]}") for p in pair}, F.col("n_pairs"))
    alpha = _alpha({p: F.col(f"w_{p[0]}{p[1]}") for p in pair}, F.col("half"), F.col("n_pairs"))
    return c.select(*by, "n_pairs", qwk.alias("qwk"), binary.alias("binary_kappa"), alpha.alias("alpha_ordinal"))


def _kappas(o: dict[tuple[int, int], Column], n: Column) -> tuple[Column, Column]:
    """qwk and binary kappa from the counts of grade pairs."""
    row = {i: _plus(o[i, j] for j in GRADES) for i in GRADES}
    column = {j: _plus(o[i, j] for i in GRADES) for j in GRADES}
    weight = {(i, j): (i - j) ** 2 / (len(GRADES) - 1) ** 2 for i in GRADES for j in GRADES}
    observed = _plus(o[p] * w for p, w in weight.items()) / n
    expected = _plus(row[i] * column[j] * w for (i, j), w in weight.items()) / (n * n)
    qwk = F.when(expected == 0, 1.0).otherwise(1 - observed / expected)
    yes = [g for g in GRADES if g >= DEFAULTS.relevant_grade]
    same = _plus(o[i, j] for i in GRADES for j in GRADES if (i in yes) == (j in yes)) / n
    pa, pb = _plus(row[i] for i in yes) / n, _plus(column[j] for j in yes) / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return qwk, F.when(F.abs(1 - chance) < 1e-12, 1.0).otherwise((same - chance) / (1 - chance))


def _alpha(o: dict[tuple[int, int], Column], n: Column, pairs: Column | None = None) -> Column:
    """Ordinal alpha from (weighted) counts of grade pairs; ``n``: half the number of grades in them."""
    total = {g: _plus(o[g, j] for j in GRADES) + _plus(o[i, g] for i in GRADES) for g in GRADES}
    gap = {(g, h): F.pow((total[g] + total[h]) / 2 + _plus(total[v] for v in range(g + 1, h)), 2) for g in GRADES for h in GRADES if g < h}
    do = _plus((o[g, h] + o[h, g]) * d for (g, h), d in gap.items()) / n
    de = _plus(2 * total[g] * total[h] * d for (g, h), d in gap.items()) / (2 * n * (2 * n - 1))
    return F.when((n if pairs is None else pairs) < 2, F.lit(None).cast("double")).when(de == 0, 1.0).otherwise(1 - do / de)


def flag(kappa: Column | str) -> Column:
    k = F.col(kappa) if isinstance(kappa, str) else kappa
    return F.when(k.isNull(), "SINGLE_ANNOTATOR").when(k >= 0.6, "HIGH").when(k >= 0.4, "MEDIUM").otherwise("LOW")


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: mean, population std, min, max to 4 decimals; all NULL without values."""
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_pop(v), 4).alias("std"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"))


def mean_of_present(*columns: Column | str) -> Column:
    """Mean of the columns that are not NULL; NULL if all are."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(n, F.lit(0))


def bootstrap(df: DataFrame, by: list[str], value: str, resamples: int = 2000, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval of each group's mean by resampling, from numpy's generator with ``seed``: mean, low, high to 4 decimals.

    Groups are lists of units (policies), which are few.
    """

    def resample(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[value].dropna().to_numpy(dtype=float)
        out = rows[by].iloc[:1].copy()
        if not len(values):
            return out.assign(mean=None, low=None, high=None)
        draws = np.random.default_rng(seed).integers(0, len(values), size=(resamples, len(values)))
        low, high = np.percentile(values[draws].mean(axis=1), [2.5, 97.5])
        return out.assign(mean=round(float(values.mean()), 4), low=round(float(low), 4), high=round(float(high), 4))

    kinds = dict(df.dtypes)
    return df.select(*by, value).groupBy(*by).applyInPandas(resample, ", ".join(f"{b} {kinds[b]}" for b in by) + ", mean double, low double, high double")


def grade_shares(histograms: DataFrame, by: list[str]) -> DataFrame:
    """Each grade's share of a group's graded items, as text in per cent."""
    return histograms.select(*by, *[percent(f"n_{g}", "n_graded").alias(f"share_{g}") for g in GRADES])


def relevant_texts(merged: DataFrame) -> DataFrame:
    """(policy, stance, text): relevant texts, each once however often and by whom it was graded."""
    return merged.where(F.col("grade") >= DEFAULTS.relevant_grade).select("policy", "stance", strip("text").alias("text")).distinct()


def base_rates(df: DataFrame, by: list[str], grade: str = "grade") -> DataFrame:
    """Relevant and judged items per group and their ratio."""
    counted = df.groupBy(*by).agg(F.count_if(F.col(grade) >= DEFAULTS.relevant_grade).alias("n_relevant"), F.count(F.lit(1)).alias("n_pool"))
    return counted.withColumn("base_rate", F.col("n_relevant") / F.col("n_pool"))


def judged_policies(df: DataFrame, least: int = 2) -> DataFrame:
    """Policies with at least ``least`` arguments of each stance."""
    return df.groupBy("policy").agg(F.count_if(F.col("stance") == 1).alias("n_pro"), F.count_if(F.col("stance") == -1).alias("n_con")).where((F.col("n_pro") >= least) & (F.col("n_con") >= least))


def merge_judgments(frozen: DataFrame, added: DataFrame) -> DataFrame:
    """(policy, stance, text, grade): added grades beside frozen ones, the highest per text; NULL grades are skipped; only policies of ``frozen``."""
    new = added.where("grade IS NOT NULL").join(frozen.select("policy").distinct(), "policy", "left_semi")
    both = frozen.select("policy", "stance", "text", "grade").union(new.select("policy", "stance", "text", "grade"))
    return both.groupBy("policy", "stance", "text").agg(F.max("grade").alias("grade"))
