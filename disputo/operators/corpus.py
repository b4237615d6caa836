"""Corpus operators: cleaning, counts, taxonomy joins, strata, keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import stance_label, strip
from disputo.runtime import cut, small


def latest(df: DataFrame, key: str, at: str, columns: list[str] | None = None) -> DataFrame:
    """One row per key, the one that arrived last: ``key``, ``at`` and ``columns`` (all others if not given, no maps); NULL keys are dropped.

    Rows of the same time are ordered by the columns asked for, NULL first.  A combined aggregate, so only these columns are read and
    shuffled and a key with many rows meets in no single task.
    """
    others = columns if columns is not None else [c for c in df.columns if c not in (key, at)]
    last = F.max(F.struct(at, *[c for c in others if c not in (key, at)])).alias("_last")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, "_last.*")


def clean_arguments(df: DataFrame, text: str = "argument", least: int = 35) -> DataFrame:
    """Arguments with trimmed texts of at least ``least`` characters and a label for their stance."""
    return df.withColumn(text, strip(text)).where(F.length(text) >= least).withColumn("stance_label", stance_label("stance"))


def union_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """All splits under each other, with the split's name in ``split_name``."""
    out = None
    for name, df in splits.items():
        part = df.withColumn("split_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def positional_ids(df: DataFrame, order: list[str], to: str = "position", parts: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` with its 0-based position in the given order (which must be total), within each group of ``by`` if given.

    Range-partitioned by group and order: a row's place in its partition less the group's first place there, shifted by the group's rows in
    the partitions before.  Only counts per group and partition are gathered, so no task sees a whole table or a whole large group,
    as a window would.
    """
    spark, by = df.sparkSession, by or []
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    # the id holds the partition and, in its lower 33 bits, the place in it
    placed = cut(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(*by, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = small(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first").withColumnsRenamed({c: f"_by_{c}" for c in by}))
    on = part == F.col("_part")
    for c in by:
        on = on & placed[c].eqNullSafe(F.col(f"_by_{c}"))
    return placed.join(shifts, on).withColumn(to, (F.col("_place") + F.col("_before")).cast("long")).drop("_place", "_part", "_before", *[f"_by_{c}" for c in by])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


QUARTILES = ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))


def quantiles(df: DataFrame, by: list[str], value: str, points: tuple[tuple[float, str], ...] = QUARTILES) -> DataFrame:
    """Interpolated quantiles of a numeric column per group, one column each; NULLs do not count, groups without values have no row.

    Values are numbered by :func:`positional_ids` and the two beside each quantile are picked, so no group's values are held in one buffer.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_id", F.monotonically_increasing_id())
    placed = positional_ids(rows, ["_v", "_id"], "_at", by=by)
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sizes = small(sizes.withColumnsRenamed({c: f"_by_{c}" for c in by}))
    on = F.lit(True)
    for c in by:
        on = on & placed[c].eqNullSafe(F.col(f"_by_{c}"))
    exact = {name: (F.col("_n") - 1) * F.lit(p) for p, name in points}
    beside = [(F.col("_at") == f(x)) for x in exact.values() for f in (F.floor, F.ceil)]
    near = placed.join(sizes, on).where(reduce(lambda a, b: a | b, beside))

    def at(f, x: Column) -> Column:
        return F.max(F.when(F.col("_at") == f(x), F.col("_v")))

    values = [(at(F.floor, x) + (at(F.ceil, x) - at(F.floor, x)) * F.max(x - F.floor(x))).alias(name) for name, x in exact.items()]
    return near.groupBy(*by).agg(*values)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles (interpolated), max of a numeric column per group."""
    summary = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high")]
    whole, parts = df.groupBy(*by).agg(*summary), quantiles(df, by, value)
    if not by:
        joined = whole.join(F.broadcast(parts), F.lit(True), "left")
    else:
        renamed = parts.withColumnsRenamed({c: f"_by_{c}" for c in by})
        on = reduce(lambda a, b: a & b, [whole[c].eqNullSafe(F.col(f"_by_{c}")) for c in by])
        joined = whole.join(renamed, on, "left")
    return joined.select(*by, "n", "mean", "std", "low", *[name for _, name in QUARTILES], "high")


def ambiguous(df: DataFrame, by: str, value: str) -> DataFrame:
    """Groups with more than one distinct value: the number and the sorted values (NULL is no value)."""
    distinct = df.select(by, value).where(F.col(value).isNotNull()).distinct()
    several = distinct.groupBy(by).agg(F.count(F.lit(1)).alias("n_values"), F.sort_array(F.collect_list(value)).alias("values"))
    return several.where("n_values > 1")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``n_rows``, ``n_duplicates`` - rows that repeat another one in these columns."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("c"))
    return groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def with_taxonomy(df: DataFrame, policies: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Each row's metapolicy and topic by its ``policy``; NULL where the policy or its metapolicy is unknown."""
    dimension = policies.select("policy", "metapolicy_id").join(taxonomy, "metapolicy_id", "left").dropDuplicates(["policy"])
    return df.join(small(dimension), "policy", "left")


def fold_metapolicy(policies: DataFrame, old: int, new: int, name: str) -> DataFrame:
    """Policies with one metapolicy folded into another; both columns change together."""
    hit = F.coalesce(F.col("metapolicy_id") == old, F.lit(False))
    return policies.withColumns({"metapolicy_id": F.when(hit, F.lit(new)).otherwise(F.col("metapolicy_id")), "metapolicy_name": F.when(hit, F.lit(name)).otherwise(F.col("metapolicy_name"))})


def stance_edges(arguments: DataFrame, policies: DataFrame) -> DataFrame:
    """SUPPORTS and ATTACKS edges from arguments with stance 1 and -1 to known policies."""
    rows = arguments.where(F.col("stance").isin(1, -1)).join(small(policies.select("policy").distinct()), "policy")
    kind = F.when(F.col("stance") == 1, "SUPPORTS").otherwise("ATTACKS")
    return rows.select(F.col("arg_id").alias("source"), F.col("policy").alias("target"), kind.alias("rel"), F.col("stance_confidence").alias("confidence"))


def orphans(df: DataFrame, key: str, edges: DataFrame, end: str) -> DataFrame:
    """Rows without any edge; no rows if there is none."""
    return df.join(edges.select(F.col(end).alias(key)).distinct(), key, "left_anti")


def terciles(df: DataFrame, value: str, key: str) -> DataFrame:
    """``df`` (a dimension table) with ``tercile`` 0, 1, 2 by size; the remainder goes to the last one; ties in key order."""
    ranked = df.withColumn("_rn", F.row_number().over(W.orderBy(value, key))).withColumn("_third", F.expr(f"count(*) over () div 3"))
    return ranked.withColumn("tercile", F.when(F.col("_rn") <= F.col("_third"), 0).when(F.col("_rn") <= 2 * F.col("_third"), 1).otherwise(2)).drop("_rn", "_third")


def seeded_order(seed: int, *key: str) -> Column:
    """A reproducible random order: the hash of the seed and the key, the same in any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per stratum in seeded order."""
    order = W.partitionBy(stratum).orderBy(seeded_order(seed, key), key)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def terms(text: Column | str, pattern: str = r"[a-z][a-z]+") -> Column:
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(f"({pattern})"), F.lit(1))


def tf_idf(df: DataFrame, group: str, text: str, stop_words: tuple[str, ...] = (), top: int = 3) -> DataFrame:
    """The ``top`` terms of each group by smoothed, length-normalised TF-IDF: ``group``, ``rank``, ``term``, ``score``.

    A group's texts together are one document, but they are never concatenated: terms are counted by a combined aggregate.
    Ties go to the smaller term.  Groups without terms have no rows.
    """
    found = df.where(F.col(group).isNotNull()).select(group, F.explode(terms(text)).alias("term"))
    if stop_words:
        found = found.where(~F.col("term").isin(*stop_words))
    tf = cut(found.groupBy(group, "term").agg(F.count(F.lit(1)).alias("tf")))
    n_groups = tf.agg(F.countDistinct(group).alias("n_groups"))
    df_counts = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df_counts, "term").join(F.broadcast(n_groups)).withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n_groups")) / (1.0 + F.col("df"))) + 1))
    lengths = weighed.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    scored = weighed.join(small(lengths), group).withColumn("score", F.round(F.col("w") / F.col("len"), 9))
    order = W.partitionBy(group).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(group, "rank", "term", "score")


def topic_names(keywords: DataFrame, group: str) -> DataFrame:
    """'Topic: A & B & C' of each group's keywords, in rank order (at most as many as keywords were asked for)."""
    listed = keywords.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return listed.select(group, F.initcap(F.concat(F.lit("topic: "), F.array_join(F.transform("k", lambda x: x["term"]), " & "))).alias("topic_name"))
