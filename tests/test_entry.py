import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = ["corpus_counts", "corpus_taxonomy_counts", "strata_terciles", "text_keywords", "relations_contradiction_candidates", "relations_resolved", "graph_pagerank", "retrieval_diverse", "judged_agreement", "eval_ranking", "hard_distractors", "summary_balance"]


def test_entry_and_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(entry.SMOKE):
        assert entry.entry(spark).count() > 0


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, data)
    sql = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [sql.columns.index(c) for c in order]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
