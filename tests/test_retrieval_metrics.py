import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputo.operators import metrics, ml, retrieval


def test_mmr_against_plain_greedy():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k = 12, 5
        v = rng.normal(size=(n, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        rel = rng.random(n)
        scaled = np.round((rel - rel.min()) / (rel.max() - rel.min()), 9)
        taken = [int(scaled.argmax())]
        while len(taken) < k:
            best, at = -9, None
            for i in range(n):
                if i not in taken:
                    value = round(0.5 * scaled[i] - 0.5 * max(float(v[i] @ v[j]) for j in taken), 9)
                    if value > best:
                        best, at = value, i
            taken.append(at)
        assert retrieval.greedy(v, rel, k, 0.5) == taken
    assert retrieval.greedy(v[:3], rel[:3], 5, 0.5) == [0, 1, 2]
    assert retrieval.greedy(v, rel, 4, 1.0) == list(np.argsort(-rel)[:4])


def test_seeded_lists(spark):
    pool = spark.createDataFrame([("p", s, i, f"{s}_{i}") for s in (1, -1) for i in range(9)], "policy string, stance int, pool_pos int, arg_id string")
    g = random.Random("42|p")
    want = {(s, i, r + 1) for s in (1, -1) for r, i in enumerate(g.sample(range(9), 4))}
    assert {(r.stance, r.pool_pos, r["rank"]) for r in retrieval.library_random(pool, 4).collect()} == want
    order = list(range(9))
    random.Random("s|p|1").shuffle(order)
    got = sorted((r.shuffled_pos, r.pool_pos) for r in retrieval.seeded_shuffle(pool, "s").where("stance = 1").collect())
    assert [b for _, b in got] == order
    assert all(r.shuffled_pos == r.pool_pos for r in retrieval.seeded_shuffle(pool, "s", 9).collect())


def lists(spark, grades, graded):
    m = spark.createDataFrame([("p", i + 1, g, "exact", f"t{i}") for i, g in enumerate(grades)], "policy string, rank int, grade int, match string, match_text string")
    g = spark.createDataFrame([("p", f"g{i}", x) for i, x in enumerate(graded)], "policy string, text string, grade int")
    return metrics.ranking_metrics(m, g, ["policy"], 3).first()


def test_ranking_literals(spark):
    r = lists(spark, [3, 2, 0], [3, 2, 1])
    assert r.ndcg == pytest.approx(0.946768, abs=1e-6) and r.precision == pytest.approx(2 / 3)
    r = lists(spark, [3, 2], [0, 1])
    assert (r.precision, r.recall, r.mean_rel) == (1.0, None, pytest.approx(5 / 3))
    assert lists(spark, [3], [0]).ndcg == 0.0


def test_diversity_and_rates(spark):
    df = spark.createDataFrame([("p", 1, "a", [1.0, 0.0], 3), ("p", 1, "b", [0.0, 1.0], 0), ("q", 1, "c", [1.0, 0.0], 2)], "policy string, stance int, text string, u array<double>, grade int")
    assert {r.policy: round(r.ild, 9) for r in metrics.diversity(df, ["policy"], size=2).collect()} == {"p": 1.0, "q": 0.0}
    assert {r.policy: r.ild for r in metrics.diversity(df, ["policy"], True, 2).collect()} == {"p": 0.0, "q": 0.0}
    manifest = spark.createDataFrame([("p", 1, " a ")], "policy string, stance int, text string")
    assert {r.policy: r.distractor_rate for r in metrics.distractor_rate(df, manifest, ["policy"]).collect()} == {"p": 0.5, "q": 0.0}
    assert metrics.distractor_rate(df, None, ["policy"]).where("distractor_rate IS NOT NULL").count() == 0


def test_balance(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 1, True), ("a", -1, True), ("b", 1, False), ("b", -1, False), ("c", 1, True)], "policy string, stance int, covered boolean")
    got = {r.policy: (r.balance, r.distortion) for r in metrics.stance_balance(df, ["policy"]).collect()}
    assert got["a"][0] == pytest.approx(2 / 3) and got["b"] == (0.0, 0.0) and got["c"][0] is None


def test_matching(spark):
    l = spark.createDataFrame([("p", 1, "x", " t1 ", [1.0, 0.0]), ("p", 1, "y", "near", [0.8, 0.6]), ("p", 1, "z", "far", [0.0, 1.0]), ("p", 1, "w", "none", None)], "policy string, stance int, arg_id string, text string, u array<double>")
    g = spark.createDataFrame([("p", 1, "t1", 2, [1.0, 0.0]), ("p", 1, "t1 ", 3, [1.0, 0.0])], "policy string, stance int, text string, grade int, u array<double>")
    got = {r.arg_id: (r.grade, r.match) for r in metrics.match_grades(l, g).collect()}
    assert got == {"x": (3, "exact"), "y": (3, "semantic"), "z": (0, "none"), "w": (0, "none")}
    assert metrics.match_grades(l, g.limit(0)).where("match <> 'none'").count() == 0


def test_winners_and_faithfulness(spark):
    df = spark.createDataFrame([("s", "A", "A"), ("s", "A", "B"), ("s", None, "B")], "g string, x string, y string")
    r = metrics.win_rates(df.withColumn("w", metrics.pairwise_winner("x", "y")), ["g"], "w", "A").first()
    assert (r.n, r.wins, r.ties) == (2, 1, 1)
    claims = spark.createDataFrame([("a", True), ("a", None), ("a", False)], "k string, supported boolean")
    assert {r.k: r.faithfulness for r in metrics.faithfulness(claims, spark.createDataFrame([("a",), ("b",)], "k string"), ["k"]).collect()} == {"a": 0.5, "b": 0.0}


def test_linkage():
    u = np.array([[1, 0], [0.999, math.sqrt(1 - 0.999**2)], [0, 1], [0.01, 1]], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert list(ml.average_linkage(u, 0.15)) == [0, 0, 1, 1] and list(ml.average_linkage(u[:1], 0.15)) == [0]


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "i int, v array<double>")
    reduced, shares = ml.pca(df, "v", 5, 2)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert np.allclose(shares, s[:2] / s.sum())
    got = np.array([r.reduced for r in reduced.orderBy("i").collect()])
    assert np.allclose((got**2).sum(0), s[:2])
