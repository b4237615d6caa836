import datetime
import json

import pytest
from pyspark.sql import functions as F

from disputo.sources import files
from disputo.streaming import append


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x",\nthen y', 1), ("b", None, 2)], "k string, t string, n int")
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert files.read_csv(spark, str(tmp_path / "c"), "k string, t string, n int").orderBy("k").collect() == df.collect()


def test_checkpoints(spark, tmp_path):
    assert files.load_checkpoint(spark, str(tmp_path / "none"), "k string").count() == 0
    (tmp_path / "c.json").write_text('{"k": "a"}\n{broken\n')
    assert [r.k for r in files.load_checkpoint(spark, str(tmp_path / "c.json"), "k string").collect()] == ["a"]
    units = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r.k for r in files.pending(units, units.where("k = 'a'"), ["k"]).collect()] == ["b"]


def test_graph_export(spark, tmp_path):
    export = {"arguments": {"a": {"text": "t", "stance": 1}}, "policies": {"P": {"pros": ["b", "a"], "cons": []}}, "edges": {"CONTRADICTS": [{"source": "a", "target": "b", "contra_fwd": 0.9}]}}
    (tmp_path / "g.json").write_text(json.dumps(export, indent=2))
    g = files.load_graph(spark, str(tmp_path / "g.json"))
    assert [(r.policy, r.stance, r.pool_pos, r.arg_id) for r in g.pools.orderBy("pool_pos").collect()] == [("P", 1, 0, "b"), ("P", 1, 1, "a")]
    e = g.edges.first()
    assert (e.source, e.target, e.rel, e.contra_fwd) == ("a", "b", "CONTRADICTS", 0.9)
    with pytest.raises(FileNotFoundError):
        files.load_graph(spark, str(tmp_path / "missing.json"))


def test_stores(spark, tmp_path):
    lists = spark.createDataFrame([(20, 5, "A", "p"), (50, 5, "B", "p")], "pool int, k int, system string, policy string")
    files.write_retrieval(lists, str(tmp_path / "r"))
    assert files.read_retrieval(spark, str(tmp_path / "r"), pool=20).count() == 1
    assert files.load_manifest(spark, str(tmp_path / "m")) is None
    path = str(tmp_path / "t")
    files.replace_atomically(lists, path)
    files.replace_atomically(lists.where("pool = 20"), path)
    assert spark.read.parquet(path).count() == 1 and spark.read.parquet(path + ".bak").count() == 2
    store = spark.createDataFrame([("A", "ndcg", 1), ("B", "ndcg", 1), ("A", "ild", None)], "system string, metric string, schema_version int")
    assert files.reset(store, ["B"], ["ild"]).count() == 3 and files.reset(store, ["B"], ["ild"], apply=True).count() == 1
    assert [x.count() for x in files.current_version(store, 1)] == [2, 1]
    wide = files.union_rows([lists.select("pool"), lists.select("system")])
    assert wide.columns == ["pool", "system"] and wide.count() == 4


def test_upsert_and_checks(spark):
    now = spark.createDataFrame([("a", 1), ("b", 1)], "k string, at int")
    got = files.upsert(now, spark.createDataFrame([("a", 2), ("a", 2)], "k string, at int"), ["k"], [F.desc("at")])
    assert {(r.k, r.at) for r in got.collect()} == {("a", 2), ("b", 1)}
    assert files.violations(now.union(now), ["k"]).count() == 2 and files.violations(now, ["k"]).count() == 0
    v = spark.createDataFrame([([1.0, 0.0],), ([2.0, 0.0],), ([1.0],), (None,)], "v array<double>")
    assert tuple(files.vector_check(v, "v", 2).first()) == (4, 2, 1)


def test_stream_keeps_latest(spark, tmp_path):
    day = lambda n: datetime.datetime(2025, 1, n)
    schema = "k string, at timestamp, v int"
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a", day(1), 1), ("b", day(1), 1)], schema).write.parquet(source)
    for number in range(2):
        append.keep_latest(append.arrivals(spark, source, schema), out, state, "k", "at").awaitTermination()
        if not number:
            spark.createDataFrame([("a", day(3), 2), ("a", day(2), 9)], schema).write.mode("append").parquet(source)
    assert {(r.k, r.v) for r in append.current(spark, out, "k", "at").collect()} == {("a", 2), ("b", 1)}


def test_stream_windows(spark, tmp_path):
    schema = "k string, at timestamp"
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", datetime.datetime(2025, 1, 1, h)) for h in (1, 1, 5)], schema).write.parquet(source)
    stream = append.arrivals(spark, source, schema)
    q = append.arrivals_per_window(stream, "at", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [3]
    q = append.first_deliveries(stream, "k", "at").writeStream.format("memory").queryName("f").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("f").count() == 1
