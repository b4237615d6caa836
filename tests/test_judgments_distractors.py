import numpy as np
import pytest
from pyspark.sql import functions as F

from disputo.operators import corpus, distractors, judgments


def agree(spark, pairs):
    rows = judgments.agreement(spark.createDataFrame([("p", a, b) for a, b in pairs], "policy string, grade_primary int, grade_secondary int"), ["policy"]).collect()
    return rows[0] if rows else None


def test_agreement_literals(spark):
    assert agree(spark, [(0, 0), (1, 1), (2, 2), (3, 3)]).qwk == 1.0
    assert agree(spark, [(0, 3), (3, 0)]).qwk == -1.0
    assert agree(spark, [(2, 2), (0, 0), (3, 1), (1, 1)]).binary_kappa == pytest.approx(0.5)
    assert agree(spark, [(2, 2)]).alpha_ordinal is None
    assert agree(spark, [(2, 2), (2, 2)]).alpha_ordinal == 1.0
    assert agree(spark, [(None, 2), (1, None)]) is None


def test_consensus_rules(spark):
    df = spark.createDataFrame([(3, 1), (2, 3), (None, 2), (None, None)], "a int, b int")
    got = [tuple(r) for r in df.select(*[judgments.consensus("a", "b", x) for x in ("min", "max", "mean", "primary", "other")]).collect()]
    assert got == [(1, 3, 2, 3, 1), (2, 3, 3, 2, 2), (2,) * 5, (None,) * 5]


def test_bootstrap_is_numpy(spark):
    values = [0.1, 0.5, 0.9, None]
    df = spark.createDataFrame([("q", v) for v in values], "s string, v double")
    r = judgments.bootstrap(df, ["s"], "v").first()
    x = np.array(values[:3])
    low, high = np.percentile(x[np.random.default_rng(7).integers(0, 3, size=(2000, 3))].mean(axis=1), [2.5, 97.5])
    assert (r["mean"], r.low, r.high) == (0.5, round(float(low), 4), round(float(high), 4))


def test_flags_and_means(spark):
    df = spark.createDataFrame([(0.6,), (0.4,), (0.1,), (None,)], "k double")
    assert [r[0] for r in df.select(judgments.flag("k")).collect()] == ["HIGH", "MEDIUM", "LOW", "SINGLE_ANNOTATOR"]
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(judgments.mean_of_present("a", "b")).collect()] == [1.0, None, 1.5]


def test_terciles_and_positions(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(7)], "k string, n int")
    assert [r.n for r in corpus.value_counts(corpus.terciles(df, "n", "k"), "tercile").orderBy("tercile").collect()] == [2, 2, 3]
    got = corpus.positional_ids(spark.range(100).select((99 - F.col("id")).alias("x")), ["x"], parts=5).collect()
    assert sorted((r.x, r.position) for r in got) == [(i, i) for i in range(100)]
    assert corpus.positional_ids(spark.range(0), ["id"]).count() == 0


def test_latest_and_folding(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 1, "z")], "k string, at int, v string")
    assert [r.v for r in corpus.latest(df, "k", "at").collect()] == ["y"]
    policies = spark.createDataFrame([("p", 10, "ten"), ("q", None, None)], "policy string, metapolicy_id int, metapolicy_name string")
    assert {(r.policy, r.metapolicy_id) for r in corpus.fold_metapolicy(policies, 10, 7, "seven").collect()} == {("p", 7), ("q", None)}


def pools(spark):
    rows = [("p", 1, "a", "own", [1.0, 0.0], 0), ("p", 1, "b", "same", [0.9, 0.1], 1), ("q", 1, "c", "same", [1.0, 0.0], 0), ("q", 1, "d", "new", [0.8, 0.6], 1), ("q", 1, "e", "new ", [0.0, 1.0], 2), ("q", -1, "f", "con", None, 0)]
    return spark.createDataFrame(rows, "policy string, stance int, arg_id string, text string, u array<double>, pool_pos int")


def test_hardening(spark):
    pool = pools(spark)
    siblings = distractors.metapolicy_siblings(spark.createDataFrame([("p", 1), ("q", 1), ("r", None)], "policy string, metapolicy_id int"))
    assert {(r.policy, r.sibling) for r in siblings.collect()} == {("p", "q"), ("q", "p")}
    found = distractors.candidates(pool, siblings)
    assert {(r.policy, r.arg_id) for r in found.collect()} == {("p", "d"), ("q", "a")}
    centroids = distractors.policy_centroids(pool.where("u IS NOT NULL"), 2)
    chosen = distractors.copies(distractors.nearest(found, centroids, 1))
    assert {r.new_id for r in chosen.collect()} == {"d__distractor_into__p", "a__distractor_into__q"}
    native = {(r.policy, r.stance, r.arg_id, r.pool_pos) for r in pool.collect()}
    level0 = distractors.hardened(pool, chosen.limit(0))
    assert {(r.policy, r.stance, r.arg_id, r.pool_pos) for r in level0.collect()} == native
    level1 = distractors.hardened(pool, chosen, level=1)
    assert level1.count() == 8 and {(r.arg_id, r.pool_pos) for r in level1.where("stance = -1").collect()} == {("f", 0)}


def test_rank_floor(spark):
    df = spark.createDataFrame([("p", 1, False, 0.2), ("p", 1, False, 0.1), ("p", 1, True, None), ("p", -1, True, None)], "policy string, stance int, is_distractor boolean, pagerank_score double")
    assert sorted((r.pagerank_score or 0) for r in distractors.rank_floor(df).collect()) == [0, 0.1, 0.1, 0.2]


def test_merged_judgments(spark):
    frozen = spark.createDataFrame([("p", 1, "t", 1)], "policy string, stance int, text string, grade int")
    added = spark.createDataFrame([("p", 1, "t", 3), ("p", 1, "u", None), ("z", 1, "t", 3)], "policy string, stance int, text string, grade int")
    assert [tuple(r) for r in judgments.merge_judgments(frozen, added).collect()] == [("p", 1, "t", 3)]
