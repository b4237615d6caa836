"""Components, clusters and neighbours, against brute force and on odd tables."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from disputo.llm import clusters, components, similar
from disputo.llm.vectors import usable_vectors


def unions(pairs):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def test_components_against_union_find(spark):
    r = random.Random(1)
    pairs = [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("hub", f"s{i}") for i in range(40)]
    df = spark.createDataFrame([*pairs, ("x", "x"), (None, "y"), *pairs[:5], *[(b, a) for a, b in pairs[:5]]], "a string, b string")
    assert {r.node: r.group_id for r in components.components(df).collect()} == unions([p for p in pairs if p[0] != p[1]])
    assert components.components(df.limit(0)).count() == 0


def test_hot_nodes_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_PARTS", 10**9)
    df = spark.range(3000).select(F.lit("hub").alias("a"), F.concat(F.lit("s"), "id").alias("b"))
    got = components.components(df)
    assert got.select("group_id").distinct().count() == 1 and got.count() == 3001


def test_ends(spark):
    rows = [(" Equivalent", "A ", "b", None, None), ("EQUIVALENT", "a", None, "C", "d"), ("equivalent", " ", "x", None, "y"), ("CONTRADICTS", "p", "q", None, None), (None, "p", "q", None, None)]
    df = spark.createDataFrame(rows, "rel string, source string, target string, arg1_id string, arg2_id string").withColumn("a", F.lit(1))
    assert {(r.arg_id, r.group_id) for r in components.equivalence_groups(df).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}


def cloud(groups, size=16, seed=0, noise=0.06):
    rng = np.random.default_rng(seed)
    out, label = [], []
    for g, n in enumerate(groups):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            v = centre + rng.normal(size=size) * noise / np.sqrt(size) * 4
            out.append(v * rng.uniform(0.2, 5))
            label.append(g)
    return np.array(out, dtype=np.float32), label


def frame(spark, x):
    rows = [(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)]
    odd = [("null", None), ("zero", [0.0] * x.shape[1]), ("nan", [float("nan")] * x.shape[1]), ("inf", [float("inf")] * x.shape[1]), ("short", [1.0]), ("hole", [None] + [1.0] * (x.shape[1] - 1)), (None, rows[0][1]), rows[0]]
    return spark.createDataFrame([*rows, *odd], "id string, v array<float>").withColumns({"s": F.lit(1), "n": F.lit(2), "cell": F.lit(3), "asks": F.lit("x")})


def test_usable(spark):
    x, _ = cloud([3])
    assert sorted(r.id for r in usable_vectors(frame(spark, x), "id", "v", 16).collect()) == ["v000", "v001", "v002"]


def test_clusters_against_brute_force(spark):
    x, _ = cloud([40, 12, 5, 3, 2, 2, 1, 1, 1], seed=4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = unions([(f"v{i:03}", f"v{j:03}") for i in range(len(x)) for j in range(len(x)) if c[i, j] >= 0.8])
    assert min(c[i, j] for i in range(len(x)) for j in range(len(x)) if want[f"v{i:03}"] == want[f"v{j:03}"]) >= 0.8
    members, _ = clusters.similarity_clusters(frame(spark, x), "id", "v", 16)
    rows = members.collect()
    assert {r.id: r.cluster_key for r in rows} == want
    typical = clusters.most_typical(members, 2).where("cluster_key = 'v000'").orderBy("rank").collect()
    mean = u[:40].mean(axis=0)
    assert [r.id for r in typical] == [f"v{i:03}" for i in np.argsort(-(u[:40] @ mean))[:2]] and typical[0].n_members == 40


def tight_pair(inner, cross, size=16):
    """Two pairs with cosine ``inner`` within and ``cross`` between."""
    g = np.full((4, 4), cross)
    g[:2, :2] = g[2:, 2:] = inner
    np.fill_diagonal(g, 1.0)
    x = np.zeros((4, size))
    x[:, :4] = np.linalg.cholesky(g)
    return x.astype(np.float32)


@pytest.mark.parametrize("rounds", [0, 3])
def test_rows_decide_not_sums(spark, monkeypatch, rounds):
    monkeypatch.setattr(clusters, "ROUNDS", rounds, raising=False)
    members = clusters.similarity_clusters(frame(spark, tight_pair(0.81, 0.79)), "id", "v", 16)[0].collect()
    assert {r.id: (r.cluster_key, r.n_members) for r in members} == {"v000": ("v000", 2), "v001": ("v000", 2), "v002": ("v002", 2), "v003": ("v002", 2)}


def test_exact_pass_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROUNDS", 0, raising=False)
    monkeypatch.setattr(clusters, "BLOCK", 7, raising=False)
    x, label = cloud([9, 6, 3, 2, 2, 1, 1, 1], seed=4)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = unions([(f"v{i:03}", f"v{j:03}") for i in range(len(x)) for j in range(len(x)) if u[i] @ u[j] >= 0.8])
    got = {r.id: r.cluster_key for r in clusters.similarity_clusters(frame(spark, x), "id", "v", 16)[0].collect()}
    assert got == want


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "id string, v array<float>")
    assert clusters.similarity_clusters(empty, "id", "v", 16)[0].count() == 0
    assert similar.most_similar(empty, "id", "v", 16, least=0.8).count() == 0
    lone = spark.createDataFrame([("a", [1.0] * 16)], "id string, v array<float>")
    assert similar.most_similar(lone, "id", "v", 16).count() == 0 and clusters.similarity_clusters(lone, "id", "v", 16)[0].count() == 1


def truth(u, k, least):
    c = u @ u.T
    np.fill_diagonal(c, -2)
    order = np.lexsort((np.tile(np.arange(len(u)), (len(u), 1)), -np.round(c, 12)), axis=1)[:, :k]
    return {(f"v{i:03}", f"v{j:03}") for i in range(len(u)) for j in order[i] if c[i, j] >= least}


@pytest.mark.parametrize("block", [8192, 16])
def test_neighbours_recall(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    x, _ = cloud([30, 20, 8, 4, 2, 1, 1], size=64, seed=2, noise=0.05)
    x[3] = x[2]  # identical vectors
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = {(r.q, r.o) for r in similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8).collect()}
    want = truth(u, 5, 0.8)
    assert len(got & want) >= 0.95 * len(want) and ("v002", "v003") in got
    assert {r.a < r.b for r in similar.neighbour_pairs(similar.most_similar(frame(spark, x), "id", "v", 64, 2, least=0.8)).collect()} == {True}


@pytest.mark.parametrize("block", [16384, 40])
def test_neighbours_are_complete_beyond_one_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BUCKET", 0.02, raising=False)  # where there are buckets: as many axes as for a far larger table
    monkeypatch.setattr(similar, "BLOCK", block)
    x, _ = cloud([40, 30, 20, 8, 4, 2, 1, 1], size=64, seed=3, noise=0.115)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = truth(u, 5, 0.8)
    assert len(want) > 100 and {(r.q, r.o) for r in similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8).collect()} == want


def test_queries_get_all_their_partners(spark):
    x, _ = cloud([6, 3, 1, 1, 1, 1, 1], size=64, seed=6)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    queries = spark.createDataFrame([("v000",), ("v012",), ("missing",)], "id string")
    got = {(r.q, r.o) for r in similar.most_similar(frame(spark, x), "id", "v", 64, 5, queries=queries).collect()}
    assert got == {p for p in truth(u, 5, -1) if p[0] in ("v000", "v012")}


def test_many_equal_vectors(spark):
    n = 50_000
    near, far = [1.0, 0.1] + [0.0] * 62, [0.0] * 63 + [1.0]
    same = spark.range(n).select(F.format_string("e%05d", "id").alias("id"), F.array(F.lit(1.0), *[F.lit(0.0)] * 63).cast("array<float>").alias("v"))
    df = same.union(spark.createDataFrame([("x", near), ("y", far)], "id string, v array<float>"))
    got = similar.most_similar(df, "id", "v", 64, 5, least=0.8)
    assert got.count() == 5 * (n + 1)
    rows = {r.q: r.l for r in got.where("q IN ('e00002', 'e49999', 'x')").groupBy("q").agg(F.sort_array(F.collect_list("o")).alias("l")).collect()}
    first = [f"e{i:05}" for i in range(6)]
    assert rows == {"e00002": [x for x in first if x != "e00002"], "e49999": first[:5], "x": first[:5]}


def test_search_alone_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(similar, "HALF", 8)  # far more rows than a window holds
    x, _ = cloud([60, 40, 30, 20, 9, 8, 7, 6, 5, 4, 3, 2] + [1] * 200, size=64, seed=7, noise=0.06)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = truth(u, 5, 0.8)
    got = {(r.q, r.o) for r in similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8, exact=False).collect()}
    assert got <= {(f"v{i:03}", f"v{j:03}") for i, j in zip(*np.nonzero(u @ u.T >= 0.8))} and len(got & want) >= 0.98 * len(want)
    both = similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8).collect()
    assert {(r.q, r.o) for r in both} == want and sum(r.searched for r in both) >= 0.98 * len(want)


def test_disk_does_not_grow_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 64)  # 25 blocks and more
    x, _ = cloud([40] * 30 + [1] * 400, size=64, seed=8, noise=0.06)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f: f.stat().st_size for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
    before = shuffled()
    best = similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8)
    assert best.count() == len(truth(x / np.linalg.norm(x.astype(float), axis=1, keepdims=True), 5, 0.8))
    assert sum(n for f, n in shuffled().items() if f not in before) < 4 * x.nbytes  # of the steps before the last nothing stays


def test_search_that_falls_short_says_so(spark, monkeypatch):
    monkeypatch.setattr(similar, "RECALL", 1.01)  # more than can be found
    x, _ = cloud([5, 3], size=64, seed=7)
    with pytest.raises(RuntimeError, match="exact"):
        similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8, exact=False).count()
    assert similar.most_similar(frame(spark, x), "id", "v", 64, 5, least=0.8).count() == 5 * 4 + 3 * 2


def test_densest_cell(spark):
    rows = [("a", [1.0, 0.05, 0.0]), ("b", [1.0, 0.06, 0.0]), ("c", [2.0, 0.5, 0.0]), ("d", [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    members = clusters.similarity_clusters(df, "id", "v", 3)[0]
    got = clusters.densest_members(df, members, "id", "v", 3, features=2).where("cluster_key = 'a'").orderBy("rank").collect()
    assert [(r.id, r.n_members, r.n_cell) for r in got] == [("a", 3, 2), ("b", 3, 2)]
