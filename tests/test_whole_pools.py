"""Lists and levels over pools of the full size."""

import numpy as np

import __spark_entry__ as entry
from disputo.plans import _views
from disputo.schema import DEFAULTS


def test_whole_pool_is_searched(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # where a pool has more than 50
    rows = [r for r in _views.pool_vectors(spark, data).where("pool_pos < 200").collect()]
    want, late = {}, 0
    for key in {(r.policy, r.stance) for r in rows}:
        own = [r for r in rows if (r.policy, r.stance) == key]
        u = np.array([r.u for r in own])
        c = u.mean(axis=0)
        order = sorted(range(len(own)), key=lambda i: (-round(float(u[i] @ c / np.linalg.norm(c)), 9), own[i].arg_id))[:5]
        late += sum(own[i].pool_pos >= 50 for i in order)
        want |= {(*key, n + 1): own[i].arg_id for n, i in enumerate(order)}
    got = {(r.policy, r.stance, r["rank"]): r.arg_id for r in entry.queries()["retrieval_centroid_top_k"](spark, data).collect()}
    assert got == want and late > 0
    assert max(r["rank"] for r in entry.queries()["retrieval_diverse"](spark, data).collect()) == 5


def test_all_levels(spark, data):
    assert {r.level for r in entry.queries()["hard_levels"](spark, data).select("level").distinct().collect()} == set(DEFAULTS.levels)
