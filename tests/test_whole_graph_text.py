"""Converged ranks, full cleaning and all verdicts, against numpy and unicodedata."""

import unicodedata

import numpy as np

import __spark_entry__ as entry
from disputo.plans import graphs


def test_ranks_converge(spark, monkeypatch):
    n = 12  # a path: what one end sends reaches the other after more than five steps
    nodes = spark.createDataFrame([(f"n{i:02}", 1) for i in range(n)], "arg_id string, stance int")
    links = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(n - 1)]
    both = spark.createDataFrame([*links, *[(b, a, w) for a, b, w in links]], "src string, dst string, w double")
    monkeypatch.setattr(graphs, "arguments", lambda *_: nodes)
    monkeypatch.setattr(graphs, "adjacency", lambda *_: both)
    got = {r.id: r["rank"] for r in entry.queries()["graph_pagerank"](spark, "").collect()}
    m = np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1)
    want = np.linalg.solve(np.eye(n) - 0.85 * (m / m.sum(axis=1, keepdims=True)).T, np.full(n, 0.15 / n))
    assert np.allclose([got[f"n{i:02}"] for i in range(n)], want, atol=2e-9)


def test_cleaning_and_verdicts(spark, tmp_path):
    texts = ["Ｆull ﬁt café", "Explanation\nB, because", "A.", "none here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cleaned = {r.doc_id: r.text for r in entry.queries()["text_cleaned"](spark, str(tmp_path)).collect()}
    assert cleaned == {i: " ".join(unicodedata.normalize("NFKD", t or "").split()) for i, t in enumerate(texts)}
    verdicts = {r.doc_id: r.verdict for r in entry.queries()["text_verdicts"](spark, str(tmp_path)).collect()}
    assert verdicts == {1: "B", 2: "A"}
