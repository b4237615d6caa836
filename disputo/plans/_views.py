"""Views that the plans share, as DataFrames and as the same common table expressions in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.functions.vectors import unit, usable
from disputo.operators.corpus import latest, positional_ids
from disputo.operators.relations import clean_ends
from disputo.runtime import blank, cut, table

SIZE = 64


class Registry:
    """Queries of one module and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to ``digits`` decimals (and no negative zero), for comparison between engines."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def arguments(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest delivery of every argument: ``arg_id``, ``loaded_at`` and the named columns, the only ones that are read."""
    return latest(table(spark, d, "arguments_clean"), "arg_id", "loaded_at", list(columns))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "debater_dataset_with_clusters").where(usable("embedding", SIZE))
    return unit(latest(rows, "arg_id", "loaded_at", ["cluster_id", "embedding"]), "embedding").select("arg_id", "cluster_id", "u")


def pool(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """The pools (policy, stance) with ``pool_pos``, each argument's place by id; stored, as queries read it several times."""
    wanted = ["policy", "stance", "is_distractor", *(["argument"] if text else [])]
    rows = arguments(spark, d, *wanted).where(F.col("stance").isin(1, -1) & F.col("policy").isNotNull())
    texts = [F.col("argument").alias("text")] if text else []
    rows = rows.select("policy", "stance", "arg_id", *texts, F.coalesce("is_distractor", F.lit(False)).alias("is_distractor"))
    return positional_ids(rows, ["arg_id"], "pool_pos", by=["policy", "stance"])


def pool_vectors(spark: SparkSession, d: str, text: bool = False) -> DataFrame:
    """The pools' arguments that have a vector, stored."""
    return cut(pool(spark, d, text).join(vectors(spark, d).select("arg_id", "u"), "arg_id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations with tidy names and ends ``a``, ``b`` (NULL if incomplete)."""
    rows = table(spark, d, "relations_generated").withColumns({c: F.lower(blank(c)) for c in ("source", "target", "arg1_id", "arg2_id")})
    return clean_ends(rows.withColumn("rel", F.upper(blank("rel"))))


def raters(spark: SparkSession, d: str) -> DataFrame:
    """One row per graded item with ``grades``: the latest possible grade of every annotator, in the order of their ids."""
    rows = table(spark, d, "graded_judgments").where(F.col("grade").between(0, 3))
    votes = rows.groupBy("item_id", "annotator_id").agg(F.max(F.struct("judged_at", "grade"))["grade"].alias("grade"), *[F.min(c).alias(c) for c in ("arg_id", "policy", "stance", "pos")])
    every = F.array_sort(F.collect_list(F.struct("annotator_id", "grade")))
    return votes.groupBy("item_id").agg(*[F.min(c).alias(c) for c in ("arg_id", "policy", "stance", "pos")], F.transform(every, lambda x: x["grade"]).alias("grades"))


def policy_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "policies").where("policy IS NOT NULL").dropDuplicates(["policy"])


ARGS = """args AS (SELECT * FROM arguments_clean WHERE arg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arg_id ORDER BY loaded_at DESC) = 1)"""
VECS = """vecs AS (SELECT arg_id, cluster_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS u FROM (
  SELECT arg_id, cluster_id, loaded_at, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM debater_dataset_with_clusters
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY arg_id ORDER BY loaded_at DESC) = 1)"""
POOL = ARGS + """, pool AS MATERIALIZED (SELECT policy, stance, arg_id, argument AS text, coalesce(is_distractor, false) AS is_distractor,
  row_number() OVER (PARTITION BY policy, stance ORDER BY arg_id) - 1 AS pool_pos FROM args WHERE stance IN (1, -1) AND policy IS NOT NULL)"""
PV = POOL + ", " + VECS + ", pv AS (SELECT pool.*, u FROM pool JOIN vecs USING (arg_id))"
EDGES = """edges AS (SELECT *, CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN s WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a1 END AS a,
  CASE WHEN s IS NOT NULL AND t IS NOT NULL THEN t WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a2 END AS b FROM (
  SELECT upper(nullif(trim(rel), '')) AS rel, nullif(lower(trim(source)), '') AS s, nullif(lower(trim(target)), '') AS t, nullif(lower(trim(arg1_id)), '') AS a1, nullif(lower(trim(arg2_id)), '') AS a2,
  policy, method, cosine, confidence, contra_fwd, contra_bwd, entail_fwd, entail_bwd, mined_at FROM relations_generated))"""
RATED = """votes AS (SELECT item_id, annotator_id, arg_max(grade, (judged_at, grade)) AS grade, min(arg_id) AS arg_id, min(policy) AS policy, min(stance) AS stance, min(pos) AS pos
  FROM graded_judgments WHERE grade BETWEEN 0 AND 3 GROUP BY ALL),
  rated AS (SELECT item_id, min(arg_id) AS arg_id, min(policy) AS policy, min(stance) AS stance, min(pos) AS pos, list(grade ORDER BY annotator_id) AS grades FROM votes GROUP BY item_id)"""


def stripped(x: str) -> str:
    """SQL for a text without white space at its ends."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
