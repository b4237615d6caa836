"""Queries over all raters and all graded items, against plain loops over the same table."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from disputo.operators import judgments


@pytest.fixture(scope="module")
def votes(data):
    rows = pd.read_parquet(f"{data}/graded_judgments.parquet")
    rows = rows[rows.grade.between(0, 3)].sort_values(["judged_at", "grade"]).groupby(["item_id", "annotator_id"]).last().reset_index()
    out = defaultdict(list)
    for r in rows.sort_values(["item_id", "annotator_id"]).itertuples():
        out[int(r.item_id)].append(int(r.grade))
    assert any(len(g) > 2 for g in out.values()) and any(i % 11 == 0 and len(g) > 1 for i, g in out.items()) and any(i % 3 == 0 for i in out)
    return out


def test_every_rater_counts(spark, data, votes):
    got = {r.item_id: (r.g_min, r.g_max, r.g_mean, r.g_primary) for r in entry.queries()["judged_consensus"](spark, data).collect()}
    assert got == {i: (min(g), max(g), int(np.floor(np.mean(g) + 0.5)), g[0]) for i, g in votes.items()}
    pairs = sum(r.n_pairs for r in entry.queries()["judged_agreement"](spark, data).collect())
    assert pairs == sum(len(g) * (len(g) - 1) // 2 for g in votes.values())


def test_every_graded_item_is_truth(spark, data):
    rows = entry.queries()["eval_matches"](spark, data).collect()
    assert rows and {r.match for r in rows} == {"exact"}


def test_every_judgment_is_parsed(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # where annotators have more than one batch
    rows = pd.read_parquet(f"{data}/graded_judgments.parquet").sort_values(["annotator_id", "item_id", "judged_at", "loaded_at"])
    rows["place"] = rows.groupby("annotator_id").cumcount()
    want = {}
    for (a, b), part in rows.groupby(["annotator_id", rows.place // 30]):
        grades = [int(g) if 0 <= g <= 3 else None for g in part.grade.fillna(-1)]
        if sum(g is not None for g in grades) >= 0.9 * len(grades):
            want |= {(a, b, i + 1): g for i, g in enumerate(grades)}
    got = {(r.annotator_id, r.batch, r.id): r.grade for r in entry.queries()["judged_parsed_answers"](spark, data).collect()}
    assert got == want and max(b for _, b, _ in want) > 0


def test_agreement_of_all_against_loops(spark):
    items = [[0, 1, 1], [2, 3], [3, 3, 3, 2], [1], [0, 0], [2, 0, 3]]
    r = judgments.agreement_of_all(spark.createDataFrame([("p", g) for g in items], "policy string, grades array<int>"), ["policy"]).first()
    o, w = np.zeros((4, 4)), np.zeros((4, 4))
    for g in items:
        for i in range(len(g)):
            for j in range(len(g)):
                if i != j:
                    o[g[i], g[j]] += 0.5
                    w[g[i], g[j]] += 1 / (len(g) - 1)
    d = np.subtract.outer(range(4), range(4)) ** 2
    t = w.sum(axis=0)
    q = np.array([[0 if a == b else (t[min(a, b) : max(a, b) + 1].sum() - (t[a] + t[b]) / 2) ** 2 for b in range(4)] for a in range(4)])
    assert r.n_pairs == o.sum() and r.qwk == pytest.approx(1 - (o * d).sum() / (np.outer(o.sum(1), o.sum(0)) * d).sum() * o.sum())
    assert r.alpha_ordinal == pytest.approx(1 - (w * q).sum() / (np.outer(t, t) * q).sum() * (t.sum() - 1))
    two = [(0, 1), (2, 3), (3, 3), (1, 1), (0, 2)]
    a = judgments.agreement(spark.createDataFrame([("p", *x) for x in two], "policy string, grade_primary int, grade_secondary int"), ["policy"]).first()
    b = judgments.agreement_of_all(spark.createDataFrame([("p", list(x)) for x in two], "policy string, grades array<int>"), ["policy"]).first()
    assert a.alpha_ordinal == pytest.approx(b.alpha_ordinal) and a.n_pairs == b.n_pairs
