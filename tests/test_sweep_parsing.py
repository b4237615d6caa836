"""The sweep, answers of models, edges with several relations, quantiles and cluster measures, against plain loops."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from disputo import runtime
from disputo.functions import parsing
from disputo.operators import corpus, distractors, graph, metrics, ml, nested, retrieval, sweep
from disputo.schema import Settings
from disputo.sources import files


def test_diverse_lists_of_all_sizes(spark):
    rng = np.random.default_rng(1)
    u = rng.normal(size=(12, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scores = rng.uniform(size=12)
    rows = [(20, "p", 1, f"a{i:02}", i, [float(x) for x in u[i]], float(scores[i])) for i in range(12)] + [(20, "p", -1, "lone", 0, [1.0] + [0.0] * 7, 0.5)]
    df = spark.createDataFrame(rows, "pool int, policy string, stance int, arg_id string, pool_pos int, u array<double>, score double")
    settings = Settings(pools=(20,), ks=(3, 5, 12, 15))
    got = sweep.mmr_lists(df, settings, "S").collect()
    for k in settings.ks:
        want = [f"a{i:02}" for i in (range(12) if k >= 12 else retrieval.greedy(u, scores, k, settings.mmr_lambda))]
        assert [r.arg_id for r in sorted((r for r in got if r.k == k and r.stance == 1), key=lambda r: r["rank"])] == want
        assert [r.arg_id for r in got if r.k == k and r.stance == -1] == ["lone"]


def test_stored_sweep_is_pruned(spark, tmp_path):
    rows = [(20, 5, "System A", "p", 1, 1, "a", "t"), (50, 5, "System B", "p", 1, 1, "b", "t")]
    files.write_retrieval(spark.createDataFrame(rows, "pool int, k int, system string, policy string, stance int, rank int, arg_id string, text string"), f"{tmp_path}/s")
    assert [r.arg_id for r in files.read_retrieval(spark, f"{tmp_path}/s", pool=50).collect()] == ["b"]


def test_entailed_and_ratio(spark):
    lists = spark.createDataFrame([("S", "p", "a")], "system string, policy string, arg_id string")
    pool = spark.createDataFrame([("p", 1, "a"), ("p", 1, "b"), ("p", -1, "c"), ("p", -1, "d")], "policy string, stance int, arg_id string")
    scores = spark.createDataFrame([("a", "c", 0.45), ("x", "b", 0.9)], "premise string, hypothesis string, entail double")
    spoken = sweep.entailed_by(lists, pool, scores)
    assert {r.arg_id: r.entail for r in spoken.collect()} == {"a": 1.0, "b": None, "c": 0.45, "d": None}
    r = sweep.pro_ratio(spoken, ["system", "policy"]).first()
    assert (r.pro_ratio, r.distortion) == (0.5, 0.0) and metrics.coverage(spoken, ["policy"]).first().coverage == 0.25
    assert sweep.pro_ratio(spoken.withColumn("entail", F.lit(0.4)), ["policy"]).first().pro_ratio == 0.5


def test_grades_are_whole_numbers(spark):
    raws = ['{"grades": [{"id": 1, "grade": 30}, {"id": 2, "grade": 2}]}', '{"grades": [{"id": 1, "grade": 3}, {"id": 2, "gra', '[{"id": 1, "grade": 12}, {"id": 2, "grade": 1}', '{"grades": [{"id": "1", "grade": "2"}, {"id": 2, "grade": 0}', "nothing", None]
    df = spark.createDataFrame([(i, r, 2) for i, r in enumerate(raws)], "r int, raw string, n int")
    got = {(x.r, x.id): x.grade for x in parsing.parse_grades(df, "r", "raw", "n", coverage=0.5).collect()}
    assert got == {(0, 1): None, (0, 2): 2, (1, 1): 3, (1, 2): None, (2, 1): None, (2, 2): 1, (3, 1): 2, (3, 2): 0}


def test_list_endings_are_a_switch(spark):
    cut, whole, other = '{"k": 1, "l": [{"x": 2}', '{"k": 3}', '{"a": {"k": 1}'
    def read(text, **how):
        return spark.range(1).select(parsing.parse_json_object(F.lit(text), "k int", ("k",), **how)["k"].alias("k")).first().k
    assert read(cut) is None and read(cut, list_recovery=True) == 1 and read(whole) == 3 and read(other, list_recovery=True) is None


def test_edges_keep_their_relations_and_the_latest_delivery(spark):
    doc = {"edges": [{"rel": "A", "source": "x", "target": "y"}, {"rel": "B", "source": "x", "target": "y"}], "arguments": [{"id": "z", "text": "old"}]}
    late = {"arguments": [{"id": "z", "text": "new"}]}
    df = spark.createDataFrame([(1, json.dumps(doc), datetime(2024, 1, 1)), (1, json.dumps(late), datetime(2024, 1, 2))], "export_id long, doc string, loaded_at timestamp")
    records = nested.flat_records(df, at="loaded_at")
    assert sorted(r.rel for r in nested.flat_table(records, "edge").collect()) == ["A", "B"]
    assert nested.flat_table(records, "argument").first().text == "new"


def test_positions_within_groups(spark):
    rows = [("p" if i % 3 else None, (i * 7) % 50) for i in range(50)]
    got = corpus.positional_ids(spark.createDataFrame(rows, "g string, x int"), ["x"], "at", parts=6, by=["g"]).collect()
    for g in ("p", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [r["at"] for r in own] == list(range(len(own))) and own


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(spark, by):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 4 else None, float(x)) for i, x in enumerate(rng.normal(size=41))] + [("a", None), ("none", None)]
    got = corpus.describe(spark.createDataFrame(rows, "g string, x double"), by, "x").collect()
    for r in got:
        own = [x for g, x in rows if x is not None and (not by or g == r.g)]
        want = np.quantile(own, [0.25, 0.5, 0.75]) if own else [None] * 3
        assert (r.q25, r.median, r.q75) == pytest.approx(tuple(want)) if own else (r.n, r.median) == (0, None)
    assert graph.coverage(spark.createDataFrame([], "x double"), "x").first().n == 0


def test_cluster_measures(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (10, 3)), rng.normal(4, 1, (8, 3)), [[9, 9, 9]], [[50, 50, 50]]]
    labels = [0] * 10 + [1] * 8 + [2, -1]
    df = spark.createDataFrame([("m", [float(v) for v in r], c) for r, c in zip(x, labels)] + [("one", [1.0, 2.0, 3.0], 0)], "method string, v array<double>, cluster int")
    got = {r.method: r for r in ml.cluster_report(df, "method", "v", 3).collect()}
    y, l = x[:-1], np.array(labels[:-1])
    d2 = ((y[:, None] - y[None]) ** 2).sum(-1)
    sil = []
    for i in range(len(y)):
        own = [j for j in range(len(y)) if l[j] == l[i] and j != i]
        a = d2[i, own].mean() if own else None
        b = min(d2[i, l == c].mean() for c in set(l) - {l[i]})
        sil.append(0.0 if a is None else (b - a) / max(a, b))
    centres = np.array([y[l == c].mean(0) for c in range(3)])
    s = [np.linalg.norm(y[l == c] - centres[c], axis=1).mean() for c in range(3)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(centres[i] - centres[j]) for j in range(3) if j != i) for i in range(3)])
    inside = sum(((y[l == c] - centres[c]) ** 2).sum() for c in range(3))
    across = sum((l == c).sum() * ((centres[c] - y.mean(0)) ** 2).sum() for c in range(3))
    r = got["m"]
    assert (r.silhouette, r.davies_bouldin, r.calinski_harabasz, r.n_clusters, r.noise_share) == pytest.approx((np.mean(sil), db, across / 2 / (inside / 16), 3, 0.05))
    assert (got["one"].silhouette, got["one"].n_clusters) == (None, 1)


def test_metapolicies_and_ranks_found(spark):
    policies = spark.createDataFrame([("p", None)], "policy string, metapolicy_id int")
    arguments = spark.createDataFrame([("p", 2), ("p", 2), ("p", 1)], "policy string, metapolicy_id int")
    level, found = distractors.metapolicies(policies, arguments)
    assert level == "argument" and found.first().metapolicy_id == 2
    assert distractors.metapolicies(policies.withColumn("metapolicy_id", F.lit(4)), arguments)[0] == "policy"
    df = spark.createDataFrame([(None, 1.0)], "pagerank_score double, pagerank double")
    assert graph.rank_column(df) == "pagerank" and graph.rank_column(policies) is None


def test_summary_actions(spark):
    long = "word " * 60
    df = spark.createDataFrame([("x", long), (None, None), (None, "short"), (None, long)], "done string, essay string")
    assert [r.a for r in df.select(metrics.summary_action("done", "essay").alias("a")).collect()] == ["reuse", "skip", "drop", "keep"]


def test_hot_keys_are_spread(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    side = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("k <> '2999'")
    got = runtime.hot_join(rows, side, ["k"], "n", parts=10**9)
    assert got.count() == 2999 and got.where("k = 'hot' AND n = 2500 AND first = 0").count() == 2500


def test_sizes_decide_about_broadcasts(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(runtime.small(wide)) and not hinted(runtime.small(wide, size=5000)) and not hinted(runtime.small(wide, rows=9))


def test_only_needed_columns_are_read(spark, data):
    plan = entry.queries()["corpus_policy_stance_counts"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "stance_confidence" not in plan and "argument:string" not in plan
