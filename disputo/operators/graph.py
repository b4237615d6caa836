"""Graph operators on vertex and edge tables: symmetric adjacency, PageRank, one-hop pools, rank comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import positive_weight
from disputo.operators.corpus import positional_ids, quantiles
from disputo.runtime import cut, small
from disputo.schema import DEFAULTS, Settings


def symmetric(edges: DataFrame, nodes: DataFrame, weight: str | None = None, score: str | None = None) -> DataFrame:
    """(``src``, ``dst``, ``w``) in both directions; weights of repeated edges are summed.

    Edges (a, b) with an end that is no node (``nodes``: id), or with itself, are left out; a missing or non-positive weight is 1.
    """
    names = [c for c in (weight, score) if c]
    w = positive_weight(*names) if names else F.lit(1.0)
    known = edges.where("a <> b").select("a", "b", w.alias("w"))
    for end in ("a", "b"):
        known = known.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    one_way = known.groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = one_way.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(one_way.select("b", "a", "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(nodes: DataFrame, adjacency: DataFrame, settings: Settings = DEFAULTS, iterations: int | None = None, every: int = 10, by: str | None = None) -> DataFrame:
    """(``id``, ``rank``): PageRank with teleport; the mass of nodes without edges goes to the teleport, ranks sum to 1.

    ``nodes``: id, and ``seed`` (weight of the teleport, uniform if missing).  With ``by`` every group of that column is its own graph, all
    groups at once (``nodes`` and ``adjacency`` both have it): personalised ranks of all policies are one job, and none is gathered in a task.

    Mass that returns to the teleport only scales the ranks, so it is left out of the steps and put back by the norm at the end: the ranks solve
    x = b + A x.  ``adjacency`` is symmetric (see :func:`symmetric`), so A has real eigenvalues within the damping and Chebyshev's iteration solves this in a third of
    the steps of plain powers.  A step is one join with the links (every node also has one to itself, which carries its own state) and one combined
    aggregate.  ``every`` steps are one plan, in which the links are shuffled once; then the state is stored.  Ends when a step changes
    less than the tolerance (L1, of the worst group; looked at once a plan), or after ``iterations``.
    """
    keys = [*([by] if by else []), "id"]
    limit = iterations if iterations is not None else settings.iterations
    d = settings.damping
    if "seed" not in nodes.columns:
        nodes = nodes.withColumn("seed", F.lit(1.0))
    nodes = nodes.groupBy(*keys).agg(F.max("seed").alias("seed"))
    totals = nodes.groupBy(*keys[:-1]).agg(F.sum("seed").alias("all_seeds"))
    base = nodes.join(small(totals), by) if by else nodes.join(F.broadcast(totals))
    start = (1 - d) * F.col("seed") / F.col("all_seeds")
    state = cut(base.select(*keys, start.alias("b"), start.alias("x"), F.lit(0.0).alias("before")))
    out = adjacency.groupBy(*keys[:-1], "src").agg(F.sum("w").alias("out_w"))
    links = adjacency.join(out, [*keys[:-1], "src"]).select(*keys[:-1], F.col("src").alias("id"), "dst", (d * F.col("w") / F.col("out_w")).alias("share"))
    links = cut(links.union(state.select(*keys, F.col("id").alias("dst"), F.lit(None).cast("double"))))
    step, weight = 0, 1.0
    while step < limit:
        until = min(step + every, limit)
        for number in range(step, until):
            own, weight = F.col("share").isNull(), 1.0 if number == 0 else 1 / (1 - d * d / 2) if number == 1 else 1 / (1 - d * d * weight / 4)
            moved = F.when(own, weight * F.col("b") + (1 - weight) * F.col("before")).otherwise(weight * F.col("share") * F.col("x"))
            sent = links.join(state, keys).select(
                *keys[:-1], F.col("dst").alias("id"), F.when(own, F.col("b")).otherwise(0.0).alias("b"), moved.alias("x"), F.when(own, F.col("x")).otherwise(0.0).alias("before")
            )
            state = sent.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("b", "x", "before")])
        state, step = cut(state), until
        change = state.groupBy(*keys[:-1]).agg((F.sum(F.abs(F.col("x") - F.col("before"))) / F.sum("x")).alias("l1")).agg(F.max("l1")).first()[0]
        if change is None or change < settings.tolerance:
            break
    mass = state.groupBy(*keys[:-1]).agg(F.sum("x").alias("mass"))
    ranks = state.join(small(mass), by) if by else state.join(F.broadcast(mass))
    return ranks.select(*keys, (F.col("x") / F.col("mass")).alias("rank"))


def personalised(policies: DataFrame, adjacency: DataFrame, settings: Settings = DEFAULTS, iterations: int | None = None) -> DataFrame:
    """(``policy``, ``id``, ``rank``) of every argument of every policy: teleport to the policy's own arguments only.

    ``policies``: policy, id.  Edges between arguments of different policies play no part, as in within-policy relations.
    """
    inside = adjacency.join(policies.select(F.col("id").alias("src"), "policy"), "src").join(policies.select(F.col("id").alias("dst"), F.col("policy").alias("p2")), "dst").where("policy = p2")
    return pagerank(policies.select("policy", "id"), inside.select("policy", "src", "dst", "w"), settings, iterations, by="policy")


def one_hop(pool: DataFrame, edges: DataFrame, pool_size: int, hop_size: int | None = None) -> DataFrame:
    """Direct pools (the first ``pool_size`` of each policy and stance) and what contradicts them, stance kept.

    ``pool``: policy, stance, pool_pos, arg_id.  ``edges``: a, b, edge_pos.  A counter-argument of the same policy and the opposite
    stance that is not direct joins the pool of its own stance, in the order of (position of the direct seed, position of the edge), each once,
    up to ``hop_size`` (half the pool, at least 5).  Result: policy, stance, arg_id, is_hop, pos (0-based, direct first).
    """
    hop_size = hop_size if hop_size is not None else max(5, pool_size // 2)
    direct = pool.where(F.col("pool_pos") < pool_size)
    both = edges.select("a", "b", "edge_pos").union(edges.select("b", "a", "edge_pos"))
    own = pool.select(F.col("arg_id").alias("b"), F.col("policy").alias("p2"), F.col("stance").alias("s2"), F.col("pool_pos").alias("own_pos"))
    found = (
        both.join(direct.select(F.col("arg_id").alias("a"), "policy", "stance", F.col("pool_pos").alias("seed_pos")), "a")
        .join(own, "b").where("policy = p2 AND s2 = -stance")
        .where(F.col("own_pos") >= pool_size)
    )
    first = found.groupBy("policy", F.col("s2").alias("stance"), F.col("b").alias("arg_id")).agg(F.min(F.struct("seed_pos", "edge_pos")).alias("at"))
    order = W.partitionBy("policy", "stance").orderBy("at", "arg_id")
    hops = first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= hop_size)
    sizes = direct.groupBy("policy", "stance").agg(F.count(F.lit(1)).alias("n_direct"))
    hops = hops.join(sizes, ["policy", "stance"], "left").select("policy", "stance", "arg_id", F.lit(True).alias("is_hop"), (F.coalesce("n_direct", F.lit(0)) + F.col("rn") - 1).cast("int").alias("pos"))
    return direct.select("policy", "stance", "arg_id", F.lit(False).alias("is_hop"), F.col("pool_pos").cast("int").alias("pos")).union(hops)


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """One row: ``rho`` of two scores, as Pearson's correlation of their ranks; equal scores rank by key."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_k"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = positional_ids(positional_ids(rows, ["_x", "_k"], "_rx"), ["_y", "_k"], "_ry")
    return ranked.agg(F.corr("_rx", "_ry").alias("rho"))


def coverage(df: DataFrame, value: str) -> DataFrame:
    """One row on a score: rows, rows with it, share, smallest, median, largest, share of zeros among those with it."""
    v = F.col(value)
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("n_with"), F.avg(v.isNotNull().cast("double")).alias("share_with"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.avg((v == 0).cast("double")).alias("zero_share"),
    )
    joined = counts.join(F.broadcast(quantiles(df, [], value, ((0.5, "median"),))), F.lit(True), "left")
    return joined.select("n", "n_with", "share_with", "low", "median", "high", "zero_share")


def rank_column(df: DataFrame, names: tuple[str, ...] = ("pagerank_score", "pagerank", "rank")) -> str | None:
    """The first of ``names`` that is a column of ``df`` and holds any value; None if there is none."""
    there = [n for n in names if n in df.columns]
    filled = df.agg(*[F.max(F.col(n).isNotNull()).alias(n) for n in there]).first() if there else {}
    return next((n for n in there if filled[n]), None)
