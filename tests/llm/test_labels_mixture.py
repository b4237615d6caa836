"""Consensus and mixtures: planted truth, exact shares, odd tables."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from disputo.llm import consensus, mixing

SCHEMA = "item_id long, annotator_id string, grade int, judged_at timestamp"


def at(n):
    return datetime.datetime(2025, 1, 1) + datetime.timedelta(minutes=n)


def test_valid_judgments(spark):
    rows = [(1, "a", 2, at(1)), (1, "a", 3, at(2)), (1, "b", 9, at(1)), (1, "c", None, at(1)), (None, "a", 1, at(1)), (1, None, 1, at(1)), (1, "a", 3, at(2)), (2, "a", 1, None), (2, "a", 2, None)]
    got = {(r.item, r.annotator): r.grade for r in consensus.valid_judgments(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, "a"): 3, (2, "a"): 2}


def planted(spark, items=120):
    r = random.Random(2)
    truth = {i: r.randrange(4) for i in range(items)}
    rows = []
    for i, t in truth.items():
        for a in r.sample(range(10), 6):
            good = a < 6
            g = t if r.random() < (0.9 if good else 0.15) else r.randrange(4)
            rows.append((i, f"r{a}", g, at(i)))
    return truth, spark.createDataFrame(rows, SCHEMA).withColumns({"item": F.lit("x"), "weight": F.lit(1), "consensus": F.lit(0)})


def test_planted_truth(spark):
    truth, df = planted(spark)
    items, annotators = consensus.consensus(df)
    got = {r.item: r.consensus_grade for r in items.collect()}
    assert len(got) == len(truth) and sum(got[i] == t for i, t in truth.items()) >= 0.95 * len(truth)
    assert {r.annotator for r in annotators.collect() if r.trusted} == {f"r{i}" for i in range(6)}


def test_odd_judgments(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items, annotators = consensus.consensus(empty)
    assert items.count() == 0 and annotators.count() == 0
    one = spark.createDataFrame([(1, "a", 2, at(0)), (2, "b", 0, at(0)), (2, "c", 3, at(0)), (3, "d", 7, at(0))], SCHEMA)
    got = {r.item: r.consensus_grade for r in consensus.consensus(one)[0].collect()}
    assert got[1] == 2 and got[2] in (0, 3) and 3 not in got


def test_chi_squared(spark):
    r = spark.range(1).select(consensus.chi_squared(0.025, F.lit(10.0)).alias("a"), consensus.chi_squared(0.5, F.lit(100.0)).alias("b")).first()
    assert r.a == pytest.approx(3.247, abs=0.03) and r.b == pytest.approx(99.334, abs=0.05)


def test_agreement_of_two_raters(spark):
    votes = spark.createDataFrame([(i, a, g) for i, (x, y) in enumerate([(0, 0), (1, 1), (2, 2), (3, 3)]) for a, g in (("a", x), ("b", y))] + [(9, "a", 1)], "item long, annotator string, grade int")
    groups = spark.createDataFrame([(i, "g") for i in range(10)], "item long, grp string")
    r = consensus.agreement(votes, groups).first()
    assert (r.n_items, r.kappa, r.alpha_ordinal) == (4, 1.0, 1.0)
    assert consensus.agreement(votes.limit(0), groups).count() == 0


@pytest.fixture()
def counted(monkeypatch):
    monkeypatch.setattr(mixing, "token_counts", lambda df, text, tokenizer=None: df.withColumn("tokens", F.size(F.split(F.coalesce(text, F.lit("")), "x")).cast("long") - 1))


def corpus(spark, sizes):
    rows = [(f"{s}{i}", s, "x" * (1 + i % 7)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], ("n1", None, "xx"), (None, "a", "x"), ("e", "a", ""), ("o", "a", None)], "doc_id string, source string, text string").withColumns({"tokens": F.lit(9), "hash": F.lit(1), "rest": F.lit(1)})


def test_mixture_reaches_its_shares(spark, counted):
    df = corpus(spark, {"a": 3000, "b": 800, "c": 200, "d": 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    kept, report = mixing.mixture(df, targets)
    r = {x.source: x for x in report.collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert r[s].actual_share == pytest.approx(share / 0.95, abs=0.01)
        assert r[s].budget_tokens - 8 <= r[s].mixed_tokens <= r[s].budget_tokens + 1e-6
    assert r["gone"].mixed_tokens == 0 and r["d"].mixed_tokens == 0 and r[None].n_docs == 1
    rows = kept.collect()
    assert len({x.doc_id for x in rows}) == len(rows) and max(x.repeats for x in rows if x.source == "c") <= 3
    assert sum(x.tokens * x.repeats for x in rows if x.source == "a") == r["a"].mixed_tokens


def test_budgets_are_nested(spark, counted):
    df = corpus(spark, {"a": 500})
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    small, large = ({x.doc_id for x in mixing.mixture(df, targets, total_tokens=n)[0].collect()} for n in (300, 900))
    assert small < large


def test_odd_mixtures(spark, counted):
    df = corpus(spark, {"a": 5})
    targets = spark.createDataFrame([("a", None, None), (None, 0.5, 1), ("b", -1.0, -3)], "source string, target_share double, max_repeats int")
    kept, report = mixing.mixture(df, targets)
    assert {x.source for x in kept.collect()} <= {None} and report.count() == 3
    kept, report = mixing.mixture(df.limit(0), targets.limit(0))
    assert kept.count() == 0 and report.count() == 0


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")
def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a b " * 50_000,), ("<|endoftext|>",)], "t string")
    n = [r.tokens for r in mixing.token_counts(df, "t").collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] >= 100_000 and n[4] > 1


def test_swinging_labels_settle(spark):
    import pytest

    from disputo.llm import consensus

    start = spark.createDataFrame([(1, 2), (2, 0)], "item long, consensus int")
    swing = lambda labels: labels.withColumn("consensus", F.when(F.col("item") == 1, 3 - F.col("consensus")).otherwise(F.col("consensus")))
    assert {r.item: r.consensus for r in consensus._settled(start, swing, 10).collect()} == {1: 1, 2: 0}
    with pytest.raises(RuntimeError, match="settle"):
        consensus._settled(start, lambda labels: labels.withColumn("consensus", F.col("consensus") + 1), 4)


def test_repeated_keys_are_one_document(spark):
    from disputo.llm import mixing

    docs = spark.createDataFrame([(1, "a", "some words here"), (1, "a", "some words here and more"), (2, "b", "others")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    kept, report = mixing.mixture(docs, targets, total_tokens=1000.0)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2] and {r.source: r.n_docs for r in report.collect()} == {"a": 1, "b": 1}
