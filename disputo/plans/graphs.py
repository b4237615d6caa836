"""Graph queries: adjacency, PageRank, one-hop pools, rank comparison, and the retrieval that uses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.functions.vectors import cosine
from disputo.operators import corpus, graph, retrieval
from disputo.plans._views import EDGES, POOL, PV, Registry, arguments, edges, policy_table, pool, pool_vectors, rounded, vectors
from disputo.runtime import cut
from disputo.schema import Settings

query = Registry()
SETTINGS = Settings()
#: The largest pool and the list length of the settings.
POOL_SIZE, K = max(SETTINGS.pools), min(SETTINGS.ks)
HOPS = POOL_SIZE // 2
_ADJ = f"""{EDGES}, ce AS (SELECT a, b, 1.0::DOUBLE AS w FROM edges WHERE rel = 'CONTRADICTS' AND a IS NOT NULL AND a <> b AND a IN (SELECT arg_id FROM args WHERE stance IN (1, -1)) AND b IN (SELECT arg_id FROM args WHERE stance IN (1, -1))),
adj AS (SELECT src, dst, sum(w) AS w FROM (SELECT a AS src, b AS dst, w FROM ce UNION ALL SELECT b, a, w FROM ce) GROUP BY ALL), outw AS (SELECT src AS id, sum(w) AS ow FROM adj GROUP BY 1)"""


def _rank_sql(nodes: str, by: str = "") -> str:
    """Power iteration until nothing changes any more, as a recursive table; ``nodes`` gives (by, id, seed), ``r`` the ranks."""
    g, part = (f"{by}, ", f"(PARTITION BY {by})") if by else ("", "()")
    same = f"AND x.{by} = l.{by}" if by else ""
    return f"""nodes AS ({nodes}), base AS (SELECT {g}id, seed / sum(seed) OVER {part} AS t, ow FROM nodes LEFT JOIN outg USING ({g}id)),
it AS (SELECT 0 AS step, {g}id, t, ow, t AS rank, 1.0::DOUBLE AS change FROM base UNION ALL SELECT step + 1, {g}id, t, ow, next, max(abs(next - rank) / t) OVER () FROM (
  SELECT step, {', '.join(f'i.{c}' for c in [*([by] if by else []), 'id', 't', 'ow', 'rank'])}, 0.15 * t + 0.85 * (coalesce(arrived, 0) + sum(CASE WHEN ow IS NULL THEN rank ELSE 0 END) OVER {part.replace(by, 'i.' + by) if by else part} * t) AS next
  FROM it i LEFT JOIN (SELECT {'l.' + by + ', ' if by else ''}l.dst AS id, sum(x.rank / x.ow * l.w) AS arrived FROM links l JOIN it x ON x.id = l.src {same} GROUP BY ALL) f ON f.id = i.id {'AND f.' + by + ' = i.' + by if by else ''})
  WHERE step < 300 AND (SELECT max(change) FROM it) > 1e-13),
r AS (SELECT {g}id, ow, rank / sum(rank) OVER {part} AS rank FROM it WHERE step = (SELECT max(step) FROM it))"""


_RANKS = f"""{_ADJ}, links AS (SELECT src, dst, w FROM adj), outg AS (SELECT id, ow FROM outw), {_rank_sql("SELECT arg_id AS id, 1.0::DOUBLE AS seed FROM args WHERE stance IN (1, -1)")}"""


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    nodes = arguments(spark, d, "stance").where(F.col("stance").isin(1, -1)).select(F.col("arg_id").alias("id"))
    return graph.symmetric(edges(spark, d).where("rel = 'CONTRADICTS' AND a IS NOT NULL"), nodes)


def ranks(spark: SparkSession, d: str) -> DataFrame:
    """Converged global ranks."""
    nodes = arguments(spark, d, "stance").where(F.col("stance").isin(1, -1)).select(F.col("arg_id").alias("id"))
    return graph.pagerank(nodes, adjacency(spark, d))


@query(f"""WITH {POOL}, {_ADJ} SELECT src, count(*) AS degree, round(sum(w), 6) AS weight FROM adj GROUP BY 1""")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    """The symmetric contradiction graph: neighbours and summed weights."""
    return rounded(adjacency(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight")))


@query(f"""WITH RECURSIVE {POOL}, {_RANKS} SELECT id, round(rank, 8) AS rank FROM r""")
def graph_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """Global PageRank, run until it converges."""
    return ranks(spark, d).select("id", F.round("rank", 8).alias("rank"))


@query(f"""WITH RECURSIVE {POOL}, {_ADJ}, links AS (SELECT p.policy, src, dst, w FROM adj JOIN pool p ON p.arg_id = src JOIN pool q ON q.arg_id = dst AND p.policy = q.policy),
outg AS (SELECT policy, src AS id, sum(w) AS ow FROM links GROUP BY ALL), {_rank_sql("SELECT policy, arg_id AS id, 1.0::DOUBLE AS seed FROM pool", "policy")} SELECT policy, id, round(rank, 8) AS rank FROM r""")
def graph_personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """PageRank of every policy's own arguments, all policies in one job, run until it converges."""
    members = arguments(spark, d, "policy", "stance").where(F.col("stance").isin(1, -1) & F.col("policy").isNotNull())
    found = graph.personalised(members.select("policy", F.col("arg_id").alias("id")), adjacency(spark, d))
    return found.select("policy", "id", F.round("rank", 8).alias("rank"))


_HOP = f"""he AS (SELECT a, b, epoch_us(mined_at) AS edge_pos FROM edges WHERE rel = 'CONTRADICTS' AND a IS NOT NULL), both_ways AS (SELECT a, b, edge_pos FROM he UNION ALL SELECT b, a, edge_pos FROM he),
direct AS (SELECT * FROM pool WHERE pool_pos < {POOL_SIZE}), found AS (SELECT o.policy, o.stance, o.arg_id, min((s.pool_pos, e.edge_pos)) AS first_at FROM both_ways e JOIN direct s ON s.arg_id = e.a JOIN pool o ON o.arg_id = e.b
  WHERE o.policy = s.policy AND o.stance = -s.stance AND o.pool_pos >= {POOL_SIZE} GROUP BY ALL), hops AS (SELECT *, row_number() OVER (PARTITION BY policy, stance ORDER BY first_at, arg_id) AS rn FROM found),
sizes AS (SELECT policy, stance, count(*) AS n FROM direct GROUP BY ALL), expanded AS (SELECT policy, stance, arg_id, false AS is_hop, pool_pos::INTEGER AS pos FROM direct
  UNION ALL SELECT policy, stance, arg_id, true, (coalesce(n, 0) + rn - 1)::INTEGER FROM hops LEFT JOIN sizes USING (policy, stance) WHERE rn <= {HOPS})"""


def hop_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where("rel = 'CONTRADICTS' AND a IS NOT NULL").select("a", "b", F.unix_micros(F.col("mined_at").cast("timestamp")).alias("edge_pos"))


@query(f"WITH {POOL}, {EDGES}, {_HOP} SELECT * FROM expanded")
def graph_one_hop_pool(spark: SparkSession, d: str) -> DataFrame:
    """Direct pools of 200 and up to 100 counter-arguments found by one hop."""
    return graph.one_hop(pool(spark, d), hop_edges(spark, d), POOL_SIZE)


@query(f"""WITH RECURSIVE {POOL}, {_RANKS}, x AS (SELECT id, rank, ow FROM r WHERE ow IS NOT NULL), k AS (SELECT row_number() OVER (ORDER BY rank, id) AS a, row_number() OVER (ORDER BY ow, id) AS b FROM (SELECT id, round(rank, 8) AS rank, ow FROM x)) SELECT round(corr(a, b), 6) AS rho FROM k""")
def graph_rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rho of PageRank and degree."""
    degree = adjacency(spark, d).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree"))
    joined = ranks(spark, d).withColumn("rank", F.round("rank", 8)).join(degree, "id")
    return rounded(graph.spearman(joined, "rank", "degree", "id"))


@query(f"""WITH RECURSIVE {POOL}, {_RANKS}, x AS (SELECT round(r.rank, 8) AS s FROM args a LEFT JOIN r ON r.id = a.arg_id) SELECT count(*) AS n, count(s) AS n_with, round(count(s) / count(*)::DOUBLE, 6) AS share_with, min(s) AS low, round(quantile_cont(s, 0.5), 8) AS median,
  max(s) AS high, round(avg((s = 0)::INTEGER), 6) AS zero_share FROM x""")
def graph_property_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many arguments have a rank, and its range."""
    scored = arguments(spark, d).select(F.col("arg_id").alias("id")).join(ranks(spark, d), "id", "left").withColumn("rank", F.round("rank", 8))
    found = graph.coverage(cut(scored), "rank")
    return found.withColumns({"share_with": F.round("share_with", 6), "median": F.round("median", 8), "zero_share": F.round("zero_share", 6)})


@query(f"""WITH {POOL}, {EDGES}, e AS (SELECT CASE WHEN stance = 1 THEN 'SUPPORTS' ELSE 'ATTACKS' END AS rel FROM args JOIN (SELECT DISTINCT policy FROM policies) p USING (policy) WHERE stance IN (1, -1)
 UNION ALL SELECT rel FROM edges WHERE a IS NOT NULL AND rel IS NOT NULL UNION ALL SELECT 'IN_METAPOLICY' FROM (SELECT DISTINCT policy FROM policies WHERE metapolicy_id IS NOT NULL)) SELECT rel, count(*) AS n FROM e GROUP BY 1""")
def graph_relationship_counts(spark: SparkSession, d: str) -> DataFrame:
    """Relationships of the graph by kind: stances, mined relations, and policies in metapolicies."""
    policies = policy_table(spark, d)
    kinds = corpus.stance_edges(arguments(spark, d, "policy", "stance", "stance_confidence"), policies).select("rel")
    mined = edges(spark, d).where("a IS NOT NULL AND rel IS NOT NULL").select("rel")
    inside = policies.where("metapolicy_id IS NOT NULL").select(F.lit("IN_METAPOLICY").alias("rel"))
    return corpus.value_counts(kinds.union(mined).union(inside), "rel")


_CENTROID = """cen AS (SELECT policy, stance, list(m ORDER BY i) AS c FROM (SELECT policy, stance, i, avg(x) AS m FROM (SELECT policy, stance, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM pvp) GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT pvp.*, round(list_cosine_similarity(u, c), 9) AS score FROM pvp JOIN cen USING (policy, stance))"""
_CAPPED = f"{PV}, pvp AS (SELECT * FROM pv WHERE pool_pos < {POOL_SIZE})"


def centroid_pool(spark: SparkSession, d: str, size: int = POOL_SIZE) -> DataFrame:
    return retrieval.centroid_scores(retrieval.constrained_pool(pool(spark, d), vectors(spark, d), size))


@query(f"WITH {_CAPPED}, {_CENTROID} SELECT policy, stance, arg_id, row_number() OVER (PARTITION BY policy, stance ORDER BY score DESC, arg_id)::INTEGER AS rank, round(score, 6) AS score FROM sc QUALIFY rank <= {K}")
def retrieval_centroid_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The flagship list: five arguments per policy and stance closest to the centroid of a pool of 200."""
    return rounded(retrieval.top_k(centroid_pool(spark, d), K).withColumn("score", F.round("score", 9)).select("policy", "stance", "arg_id", "rank", "score"))


@query(f"""WITH {PV}, q AS (SELECT policy, arg_min(u, arg_id) AS q FROM pv GROUP BY 1), sc AS (SELECT pv.policy, stance, arg_id, round(coalesce(list_cosine_similarity(u, q), 0), 9) AS score FROM pv JOIN q USING (policy))
SELECT policy, stance, arg_id, row_number() OVER (PARTITION BY policy, stance ORDER BY score DESC, arg_id)::INTEGER AS rank, round(score, 6) AS score FROM sc QUALIFY rank <= 5""")
def retrieval_query_top_k(spark: SparkSession, d: str) -> DataFrame:
    """Five arguments per policy and stance closest to a query vector (here each policy's first argument)."""
    rows = pool_vectors(spark, d)
    queries = rows.groupBy("policy").agg(F.min_by("u", "arg_id").alias("q"))
    return rounded(retrieval.top_k(retrieval.query_scores(rows, queries), 5).withColumn("score", F.round("score", 9)).select("policy", "stance", "arg_id", "rank", "score"))


def _mmr_sql(source: str, k: int = K, group: str = "policy, stance") -> str:
    """``k`` greedy steps over ``source`` (group, arg_id, pool_pos, u, score)."""
    best = f"QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY round(0.5 * rel - 0.5 * near, 9) DESC, pool_pos) = 1"
    out = f"""n AS (SELECT *, count(*) OVER w AS n, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 9) ELSE 1.0 END AS rel FROM {source} WINDOW w AS (PARTITION BY {group})),
small AS (SELECT {group}, arg_id, row_number() OVER (PARTITION BY {group} ORDER BY pool_pos)::INTEGER AS rank FROM n WHERE n <= {k}), c1 AS (SELECT *, -1.0::DOUBLE AS near FROM n WHERE n > {k}), s1 AS (SELECT * FROM c1 QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY rel DESC, pool_pos) = 1)"""
    for i in range(2, k + 1):
        out += f""",
c{i} AS MATERIALIZED (SELECT c.* REPLACE (greatest(c.near, list_dot_product(c.u, s.u)) AS near) FROM c{i - 1} c JOIN s{i - 1} s USING ({group}) WHERE c.arg_id <> s.arg_id), s{i} AS MATERIALIZED (SELECT * FROM c{i} {best})"""
    return out + f" SELECT {group}, arg_id, rank FROM small" + "".join(f" UNION ALL SELECT {group}, arg_id, {i}::INTEGER FROM s{i}" for i in range(1, k + 1))


@query(f"WITH {_CAPPED}, {_CENTROID}, {_mmr_sql('sc')}")
def retrieval_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Maximal marginal relevance on closeness to the centroid, five of pools of 200."""
    return retrieval.mmr(centroid_pool(spark, d), K).select("policy", "stance", "arg_id", "rank")


@query(f"""WITH RECURSIVE {PV}, {EDGES}, {_HOP}, {_RANKS.replace(EDGES + ',', '').strip()}, hp AS (SELECT e.policy, e.stance, e.arg_id, e.pos AS pool_pos, v.u, coalesce(round(r.rank, 8), 0) AS score FROM expanded e JOIN vecs v USING (arg_id) LEFT JOIN r ON r.id = e.arg_id), {_mmr_sql('hp')}""")
def retrieval_hop_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Maximal marginal relevance on converged global PageRank over pools of 200, expanded by one contradiction hop; five per pool."""
    expanded = graph.one_hop(pool(spark, d), hop_edges(spark, d), POOL_SIZE).withColumnRenamed("pos", "pool_pos")
    scored = expanded.join(vectors(spark, d).select("arg_id", "u"), "arg_id").join(ranks(spark, d).select(F.col("id").alias("arg_id"), F.round("rank", 8).alias("score")), "arg_id", "left").fillna(0.0, ["score"])
    return retrieval.mmr(scored, K).select("policy", "stance", "arg_id", "rank")


@query(f"""WITH {POOL} SELECT policy, stance, arg_id, row_number() OVER (PARTITION BY policy, stance ORDER BY md5('42|' || policy || '|' || arg_id), arg_id)::INTEGER AS rank FROM pool WHERE pool_pos < 200 QUALIFY rank <= 5""")
def retrieval_seeded_random(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.seeded_random(pool(spark, d).where("pool_pos < 200"), 5).select("policy", "stance", "arg_id", "rank")


@query()
def retrieval_library_random(spark: SparkSession, d: str) -> DataFrame:
    """Random lists as the standard library's generator draws them (no SQL has that generator; tested against it)."""
    return retrieval.library_random(pool(spark, d).where("pool_pos < 200"), 5).select("policy", "stance", "arg_id", "rank")


@query()
def retrieval_shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Pools shuffled by their seed and cut into batches of 30 for annotation."""
    shuffled = retrieval.seeded_shuffle(pool(spark, d).where("pool_pos < 200"), "42", 30)
    return retrieval.batches(shuffled, ["policy", "stance"], "shuffled_pos").select("policy", "stance", "arg_id", "batch")


_GRID = f"""{PV}, grid AS (SELECT p AS pool, k FROM (SELECT unnest({list(SETTINGS.pools)}) AS p), (SELECT unnest({list(SETTINGS.ks)}) AS k) WHERE k <= p), pvp AS (SELECT pool, pv.* FROM pv, (SELECT DISTINCT pool FROM grid) WHERE pool_pos < pool),
cen AS (SELECT pool, policy, stance, list_transform(range(1, 65), lambda i: list_avg(list_transform(us, lambda v: v[i]))) AS c FROM (SELECT pool, policy, stance, list(u) AS us FROM pvp GROUP BY ALL)),
rk AS (SELECT pool, policy, stance, arg_id, u, row_number() OVER (PARTITION BY pool, policy, stance ORDER BY round(list_cosine_similarity(u, c), 9) DESC, arg_id) AS rank FROM pvp JOIN cen USING (pool, policy, stance)),
lists AS (SELECT pool::INTEGER AS pool, k::INTEGER AS k, policy, stance, rank::INTEGER AS rank, arg_id, u FROM rk JOIN grid USING (pool) WHERE rank <= k)"""


@query(f"WITH {_GRID} SELECT pool, k, policy, stance, rank, arg_id FROM lists")
def retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Centroid lists of all configurations in one job."""
    return retrieval.grid_top_k(pool(spark, d), vectors(spark, d), SETTINGS)


@query(f"""WITH {_GRID}, r AS (SELECT a.pool, a.k, a.policy, a.stance, avg(list_dot_product(a.u, b.u)) FILTER (a.arg_id < b.arg_id) AS m FROM lists a JOIN lists b USING (pool, k, policy, stance) GROUP BY ALL)
SELECT pool, k, count(*) AS n_lists, round(avg(coalesce(m, 0)), 6) AS redundancy FROM r GROUP BY ALL""")
def retrieval_grid_redundancy(spark: SparkSession, d: str) -> DataFrame:
    """Mean pairwise cosine of the lists of every configuration."""
    lists = retrieval.grid_top_k(pool(spark, d), vectors(spark, d), SETTINGS)
    each = retrieval.redundancy(lists, vectors(spark, d), ["pool", "k", "policy", "stance"])
    return rounded(each.groupBy("pool", "k").agg(F.count(F.lit(1)).alias("n_lists"), F.avg("redundancy").alias("redundancy")))


QUERIES, ORACLES = query.queries, query.oracles
