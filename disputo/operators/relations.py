"""Mining of relations between arguments: blocked vector joins, adjudication, conflicts, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.functions.scalars import pair_ends
from disputo.runtime import small
from disputo.schema import DEFAULTS, Settings

#: Rows of one side that a task holds at a time; larger blocks are cut into chunks of this size.
CHUNK = 4096


def chunked_pairs(left: DataFrame, right: DataFrame, floor: float, chunk: int = CHUNK) -> DataFrame:
    """(``block``, ``a``, ``b``, ``a_tag``, ``b_tag``, ``cosine``) of rows of one block with cosine of at least ``floor``.

    Both sides have ``block``, ``id``, ``tag`` (long), ``u`` (unit vector).  Every block is cut into chunks by the hash of the id and every pair of
    chunks is one group, multiplied as matrices; so a block that holds a third of all rows becomes many
    groups of bounded size.  Sides are replicated only as often as their block has chunks on the other side.  Both are read twice, to be counted and
    to be placed, so the caller stores them.
    """

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))

    counts = small(parts(left, "lp").join(parts(right, "rp"), "block"))

    def placed(df: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own)).cast("int")
        both = df.join(counts, "block").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        l, r = ("_mine", "_other") if side == 0 else ("_other", "_mine")
        return both.select("block", F.col(l).alias("lc"), F.col(r).alias("rc"), F.lit(side).alias("side"), "id", "tag", "u")

    rows = placed(left, "lp", "rp", 0).union(placed(right, "rp", "lp", 1))
    kinds = dict(rows.dtypes)

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        u = table.column("u").combine_chunks()
        x = u.flatten().to_numpy(zero_copy_only=False).reshape(len(u), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        cosine = x[a] @ x[b].T if len(a) and len(b) else np.empty((len(a), len(b)))
        i, j = np.nonzero(cosine >= floor)
        ids, tags = table.column("id").combine_chunks(), table.column("tag").combine_chunks()
        first, second = pa.array(a[i]), pa.array(b[j])
        block = pa.array([key[0].as_py()] * len(i), type=table.schema.field("block").type)
        return pa.table({"block": block, "a": ids.take(first), "b": ids.take(second), "a_tag": tags.take(first), "b_tag": tags.take(second), "cosine": pa.array(cosine[i, j])})

    schema = f"block {kinds['block']}, a {kinds['id']}, b {kinds['id']}, a_tag long, b_tag long, cosine double"
    return rows.groupBy("block", "lc", "rc").applyInArrow(multiply, schema)


def _side(df: DataFrame, block: Column, tag: str) -> DataFrame:
    return df.select(block.alias("block"), F.col("arg_id").alias("id"), F.col(tag).cast("long").alias("tag"), "u")


def contradiction_candidates(arguments: DataFrame, floor: float = DEFAULTS.floor_contradicts) -> DataFrame:
    """PRO x CON pairs of one policy with cosine >= floor: ``policy``, ``source``, ``target``, ``cosine``.

    ``arguments``: arg_id, policy, stance, pool_pos, u.
    """
    pairs = chunked_pairs(_side(arguments.where("stance = 1"), F.col("policy"), "pool_pos"), _side(arguments.where("stance = -1"), F.col("policy"), "pool_pos"), floor)
    return pairs.select(F.col("block").alias("policy"), F.col("a").alias("source"), F.col("b").alias("target"), "cosine")


def equivalence_candidates(arguments: DataFrame, floor: float = DEFAULTS.floor_equivalent) -> DataFrame:
    """Pairs of one policy and stance with cosine >= floor, the one earlier in the pool first."""
    rows = _side(arguments.where(F.col("stance").isin(1, -1)), F.concat_ws("|", F.col("stance").cast("string"), "policy"), "pool_pos")
    pairs = chunked_pairs(rows, rows, floor).where("a_tag < b_tag")
    return pairs.select(F.expr("substring(block, instr(block, '|') + 1)").alias("policy"), F.col("a").alias("source"), F.col("b").alias("target"), "cosine")


def coherence_candidates(arguments: DataFrame, floor: float = DEFAULTS.floor_contradicts) -> DataFrame:
    """Pairs of different policies of one metapolicy, any stances, with cosine >= floor; the policy with the smaller ``policy_pos`` first."""
    rows = _side(arguments.where(F.col("metapolicy_id").isNotNull()), F.col("metapolicy_id"), "policy_pos")
    pairs = chunked_pairs(rows, rows, floor).where("a_tag < b_tag")
    return pairs.select(F.col("block").alias("metapolicy_id"), F.col("a").alias("source"), F.col("b").alias("target"), "cosine")


def flag_distractor_pairs(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """Pairs with ``a_distractor`` and ``b_distractor`` (missing flags are false) by arg_id."""
    def flag(end: str, name: str) -> DataFrame:
        return flags.select(F.col("arg_id").alias(end), F.coalesce("is_distractor", F.lit(False)).alias(name))

    both = pairs.join(flag("source", "a_distractor"), "source", "left").join(flag("target", "b_distractor"), "target", "left")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("a_distractor", "b_distractor")})


def without_distractor_pairs(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """Pairs of which at most one end is a distractor."""
    return flag_distractor_pairs(pairs, flags).where("NOT (a_distractor AND b_distractor)")


def pair_type(a: str = "a_distractor", b: str = "b_distractor") -> Column:
    return F.when(F.col(a) & F.col(b), "distractor-distractor").when(F.col(a) | F.col(b), "native-distractor").otherwise("native-native")


def clean_ends(edges: DataFrame) -> DataFrame:
    """``edges`` with ``a``, ``b``: source and target if both are there, else arg1_id and arg2_id if both are, else NULLs."""
    first = F.col("source").isNotNull() & F.col("target").isNotNull()
    second = F.col("arg1_id").isNotNull() & F.col("arg2_id").isNotNull()
    return edges.withColumns({"a": F.when(first, F.col("source")).when(second, F.col("arg1_id")), "b": F.when(first, F.col("target")).when(second, F.col("arg2_id"))})


def convention(edges: DataFrame) -> DataFrame:
    """One row: how many edges have each pair of end columns, both, neither, and the convention most of them follow."""
    first = F.col("source").isNotNull() & F.col("target").isNotNull()
    second = F.col("arg1_id").isNotNull() & F.col("arg2_id").isNotNull()
    counts = edges.agg(F.count_if(first).alias("n_source_target"), F.count_if(second).alias("n_arg1_arg2"), F.count_if(~first & ~second).alias("n_neither"))
    return counts.withColumn("majority", F.when(F.col("n_source_target") >= F.col("n_arg1_arg2"), "source/target").otherwise("arg1_id/arg2_id"))


def require_ends(edges: DataFrame) -> DataFrame:
    """``edges`` with ``a``, ``b``; the query fails on the first edge that has neither pair of ends."""
    ended = clean_ends(edges)
    return ended.withColumn("a", F.when(F.col("a").isNull(), F.raise_error(F.lit("an edge has neither source/target nor arg1_id/arg2_id"))).otherwise(F.col("a")))


def bidirectional(forward: Column | str, backward: Column | str) -> Column:
    """The weaker of both directions' probabilities; NULL if one is missing."""
    f, b = (F.col(x) if isinstance(x, str) else x for x in (forward, backward))
    return F.when(f.isNotNull() & b.isNotNull(), F.least(f, b))


def adjudicate(scored: DataFrame, score: str, tau: float, verdict: str | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Accepted rows with ``method`` and ``confidence``.

    Accepted if score >= tau; where ``verdict`` (boolean) is given and the score lies in the uncertain band
    [low, high), a verdict that is not NULL decides instead.  Rows without a score are not accepted.
    """
    base = F.coalesce(F.col(score) >= tau, F.lit(False))
    judged = F.lit(False)
    if verdict:
        judged = F.coalesce((F.col(score) >= settings.uncertain_low) & (F.col(score) < settings.uncertain_high) & F.col(verdict).isNotNull(), F.lit(False))
    accept = F.when(judged, F.col(verdict) if verdict else F.lit(False)).otherwise(base)
    kept = scored.withColumn("method", F.when(judged, "nli+llm").otherwise("nli")).where(accept)
    return kept.withColumn("confidence", F.round(score, 4))


def best_per_pair(edges: DataFrame, first: list[str], kind: str | None = None) -> DataFrame:
    """One edge per unordered pair (``pair_a`` < ``pair_b``): the highest confidence, then the order of ``first``; self links drop out."""
    a, b = pair_ends("source", "target")
    rows = edges.where("source <> target").withColumns({"pair_a": a, "pair_b": b})
    order = W.partitionBy(*([kind] if kind else []), "pair_a", "pair_b").orderBy(F.desc_nulls_last("confidence"), *first)
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def resolve(contradicts: DataFrame, equivalent: DataFrame) -> DataFrame:
    """One relation per pair: of two, the one with the higher confidence; equal confidence keeps CONTRADICTS.

    Inputs have pair_a, pair_b, confidence (one row per pair).
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("pair_a", "pair_b", F.col("confidence").alias(name))

    both = side(contradicts, "c").join(side(equivalent, "e"), ["pair_a", "pair_b"], "full")
    keeps = F.col("e").isNull() | (F.col("c").isNotNull() & (F.col("c") >= F.col("e")))
    return both.select("pair_a", "pair_b", F.when(keeps, "CONTRADICTS").otherwise("EQUIVALENT").alias("rel"), F.when(keeps, F.col("c")).otherwise(F.col("e")).alias("confidence"))


def saturation(scored: DataFrame, possible: DataFrame, floors: tuple[float, ...], taus: tuple[float, ...]) -> DataFrame:
    """Kept pairs for every (floor, tau) and their share of the possible cross pairs.

    ``scored``: cosine, score.  ``possible``: one row, n_possible.  All cells are counted in one pass over the pairs, then unpivoted.
    """
    cells = [(f, t) for f in floors for t in taus]
    counts = scored.agg(*[F.count_if((F.col("cosine") >= f) & (F.col("score") >= t)).alias(f"c{i}") for i, (f, t) in enumerate(cells)])
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("floor"), F.lit(t).alias("tau"), F.col(f"c{i}").alias("kept")) for i, (f, t) in enumerate(cells)]))
    rows = counts.select(listed.alias("x")).select("x.*").join(F.broadcast(possible))
    return rows.select("floor", "tau", "kept", (F.col("kept") / F.nullif("n_possible", F.lit(0))).alias("share"))


def step_quantiles(df: DataFrame, value: str, points: tuple[float, ...]) -> DataFrame:
    """Quantiles that are values of the data: the one at position min(n - 1, floor(p * n)) of the sorted values.

    Values are counted first and positions found by a running count over the distinct values of each range partition, so
    nothing is collected into one array.
    """
    from disputo.operators.corpus import positional_ids

    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("value"), F.monotonically_increasing_id().alias("_id"))
    placed = positional_ids(rows, ["value", "_id"], "pos")
    n = placed.agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n"))).alias("pos")) for p in points])).alias("w")).select("w.*")
    return placed.join(F.broadcast(wanted), "pos").select("p", "value")


def saturation_picks(df: DataFrame, value: str, key: str) -> DataFrame:
    """Of a dimension table the rows with the most, the median (n // 2 from the top) and the least: ``pick`` and the row."""
    ranked = df.withColumn("_rn", F.row_number().over(W.orderBy(F.desc(value), key))).withColumn("_n", F.expr("count(*) over ()"))
    pick = F.when(F.col("_rn") == 1, "most").when(F.col("_rn") == F.expr("_n div 2 + 1"), "median").when(F.col("_rn") == F.col("_n"), "least")
    return ranked.withColumn("pick", pick).where(F.col("pick").isNotNull()).drop("_rn", "_n")


def edge_guard(edges: DataFrame, expected: int, tolerance: float = 0.1) -> DataFrame:
    """One row: the number of contradictions (not the coherence ones), the allowed range, and whether it lies within."""
    kind = F.upper(F.trim("rel"))
    counted = edges.agg(F.count_if(kind.contains("CONTRADICT") & ~kind.contains("COHERENCE")).alias("n"))
    return counted.select("n", F.lit(expected * (1 - tolerance)).alias("low"), F.lit(expected * (1 + tolerance)).alias("high"), F.col("n").between(expected * (1 - tolerance), expected * (1 + tolerance)).alias("ok"))


def candidate_stats(pairs: DataFrame, arguments: DataFrame) -> DataFrame:
    """Per policy: possible PRO x CON pairs, candidates and their share."""
    sizes = arguments.groupBy("policy").agg((F.count_if(F.col("stance") == 1) * F.count_if(F.col("stance") == -1)).alias("n_possible"))
    counts = pairs.groupBy("policy").agg(F.count(F.lit(1)).alias("n_candidates"))
    return sizes.join(counts, "policy", "left").select("policy", "n_possible", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
