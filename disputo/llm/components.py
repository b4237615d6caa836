"""Problem 2: one group identifier for records linked pair by pair, directly or through others.

Alternating large-star and small-star rewrites of the edge list, each a join and two aggregates, until the
edges no longer change; every node then points to the smallest identifier of its component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputo.runtime import cut

#: A node with more than 1/HOT_PARTS of all edges is joined by broadcast; as an edge has two ends, there are fewer than 2 * HOT_PARTS of them.
HOT_PARTS = 400


def endpoints(df: DataFrame, rel: str = "equivalent") -> DataFrame:
    """``a``, ``b``: the ends of the rows whose ``rel`` is ``rel``, ids trimmed and in lower case.

    ``source``/``target`` count if both are filled, else ``arg1_id``/``arg2_id`` if both are, else the row
    links nothing; NULL, empty and blank are the same.
    """

    def clean(name: str) -> Column:
        return F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))

    ids = df.where(clean("rel") == rel).select(*[F.when(clean(x) != "", clean(x)).alias(x) for x in ("source", "target", "arg1_id", "arg2_id")])
    first = F.col("source").isNotNull() & F.col("target").isNotNull()
    return ids.select(F.when(first, F.col("source")).otherwise(F.col("arg1_id")).alias("a"), F.when(first, F.col("target")).otherwise(F.col("arg2_id")).alias("b")).where(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )


def _star(edges: DataFrame, large: bool, size: int) -> DataFrame:
    """One rewrite of (``a``, ``b``) with a > b.

    Large-star: every node's larger neighbours are linked to the smallest of itself and its neighbours.
    Small-star: every node's smaller neighbours, and itself, are linked to the smallest of them.
    The minimum of a node is a combined aggregate and comes back by a join in which hot nodes (of the ``size``
    edges known before) are broadcast, so the neighbours of a hub are never gathered in one task.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))  # node a, neighbour b
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree")).withColumn("m", F.least("m", "a"))
        rows = both.where("b > a")
    else:
        both = edges
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
        rows = both
    hot_from = size / HOT_PARTS + 1000
    hot = least.where(F.col("degree") > hot_from).select("a", "m")
    rest = least.where(F.col("degree") <= hot_from).select("a", F.col("m").alias("n"))
    joined = rows.join(F.broadcast(hot), "a", "left")
    met = joined.where(F.col("m").isNotNull()).select("a", "b", "m").union(joined.where(F.col("m").isNull()).drop("m").join(rest, "a").select("a", "b", F.col("n").alias("m")))
    moved = met.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(``node``, ``group_id``) of every node that is linked to another one; group_id is the component's smallest node.

    ``pairs`` has columns ``a`` and ``b``; repeated, reversed and self pairs and NULL ends are allowed and
    change nothing.  Runs O(log n) rounds until a large-star and a small-star change nothing; an empty input
    gives no rows.  Raises RuntimeError rather than return unfinished groups.
    """
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        edges = cut(_star(cut(_star(edges, True, before[0])), False, before[0]))
        after = _signature(edges)
        if after == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("group_id")).union(roots.select("node", F.col("node").alias("group_id")))
        before = after
    raise RuntimeError(f"not converged in {max_rounds} rounds")


def equivalence_groups(relations: DataFrame, rel: str = "equivalent") -> DataFrame:
    """(``arg_id``, ``group_id``) for every argument in a group of at least two."""
    return components(endpoints(relations, rel)).select(F.col("node").alias("arg_id"), "group_id")
