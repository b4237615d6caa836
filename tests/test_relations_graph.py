import numpy as np
import pytest
from pyspark.sql import functions as F

from disputo.operators import graph, relations
from disputo.schema import Settings


def test_chunks_do_not_change_pairs(spark):
    rng = np.random.default_rng(0)
    u = rng.normal(size=(60, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    rows = [(f"b{i % 2}", f"x{i}", i, [float(v) for v in u[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "block string, id string, tag long, u array<double>")
    want = {(f"x{i}", f"x{j}") for i in range(60) for j in range(60) if i % 2 == j % 2 and u[i] @ u[j] >= 0.3}
    for chunk in (7, 4096):
        assert {(r.a, r.b) for r in relations.chunked_pairs(df, df, 0.3, chunk).collect()} == want
    assert relations.chunked_pairs(df.limit(0), df, 0.3).count() == 0


def test_ends_and_guard(spark):
    df = spark.createDataFrame([("CONTRADICTS", "a", "b", None, None), ("x", "a", None, "c", "d"), ("COHERENCE_CONTRADICTS", "a", None, None, "d")], "rel string, source string, target string, arg1_id string, arg2_id string")
    assert [(r.a, r.b) for r in relations.clean_ends(df).collect()] == [("a", "b"), ("c", "d"), (None, None)]
    c = relations.convention(df).first()
    assert (c.n_source_target, c.n_arg1_arg2, c.n_neither) == (1, 1, 1)
    with pytest.raises(Exception, match="neither"):
        relations.require_ends(df).collect()
    assert relations.edge_guard(df, 1).first().ok and not relations.edge_guard(df, 9).first().ok


def test_adjudicate_and_resolve(spark):
    df = spark.createDataFrame([("a", "b", 0.9, None), ("a", "c", 0.8999, None), ("a", "d", 0.5, True), ("a", "e", 0.5, False), ("a", "f", None, True), ("a", "g", 0.7, True)], "source string, target string, score double, verdict boolean")
    got = {r.target: r.method for r in relations.adjudicate(df, "score", 0.9, "verdict").collect()}
    assert got == {"b": "nli", "d": "nli+llm"}
    c = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5)], "pair_a string, pair_b string, confidence double")
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.6), ("x", "y", 0.1)], "pair_a string, pair_b string, confidence double")
    assert {(r.pair_a, r.pair_b): r.rel for r in relations.resolve(c, e).collect()} == {("a", "b"): "CONTRADICTS", ("a", "c"): "EQUIVALENT", ("x", "y"): "EQUIVALENT"}


def test_step_quantiles(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("x")).union(spark.createDataFrame([(None,)], "x double"))
    assert {r.p: r.value for r in relations.step_quantiles(df, "x", (0.0, 0.5, 1.0)).collect()} == {0.0: 1.0, 0.5: 6.0, 1.0: 10.0}


def dense_ranks(n, edges, seeds, d=0.85):
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] += 1
        w[b, a] += 1
    t = np.array(seeds, float) / sum(seeds)
    x, out = t.copy(), w.sum(1)
    for _ in range(200):
        share = np.divide(x, out, out=np.zeros(n), where=out > 0)
        x = (1 - d) * t + d * (w.T @ share + x[out == 0].sum() * t)
        x /= x.sum()
    return x


def test_pagerank_against_numpy(spark):
    edges = [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (0, 1)]
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    adjacency = graph.symmetric(spark.createDataFrame([*edges, (6, 6), (0, 99)], "a long, b long"), nodes)
    want = dense_ranks(7, edges, [1] * 7)
    got = {r.id: r.rank for r in graph.pagerank(nodes, adjacency, Settings(iterations=60, tolerance=1e-9), every=10).collect()}
    assert np.allclose([got[i] for i in range(7)], want, atol=1e-4) and abs(sum(got.values()) - 1) < 1e-9


def test_personalised_is_one_graph_per_policy(spark):
    policies = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), ("q", 3), ("q", 4)], "policy string, id long")
    adjacency = graph.symmetric(spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 3)], "a long, b long"), policies.select("id"))
    got = {r.id: r.rank for r in graph.personalised(policies, adjacency, iterations=40).collect()}
    assert np.allclose([got[i] for i in range(3)], dense_ranks(3, [(0, 1), (1, 2)], [1] * 3), atol=1e-3)
    assert np.allclose([got[3], got[4]], [0.5, 0.5], atol=1e-6)


def test_one_hop(spark):
    pool = spark.createDataFrame([("p", 1, 0, "a"), ("p", 1, 1, "b"), ("p", -1, 0, "c"), ("p", -1, 1, "d"), ("q", -1, 1, "e")], "policy string, stance int, pool_pos int, arg_id string")
    edges = spark.createDataFrame([("a", "d", 1), ("d", "a", 2), ("a", "e", 0), ("b", "c", 0)], "a string, b string, edge_pos long")
    got = {(r.stance, r.arg_id, r.is_hop, r.pos) for r in graph.one_hop(pool, edges, 1).where("policy = 'p'").collect()}
    assert got == {(1, "a", False, 0), (-1, "c", False, 0), (-1, "d", True, 1), (1, "b", True, 1)}


def test_spearman(spark):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(20)], "k long, x double, y double")
    assert abs(graph.spearman(df, "x", "y", "k").first().rho + 1) < 1e-12
