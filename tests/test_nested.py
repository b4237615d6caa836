import json

from disputo.operators import nested


def rows(spark, docs, **extra):
    df = spark.createDataFrame([(i, d) for i, d in docs], "export_id long, doc string")
    found = nested.flat_records(df.selectExpr("*", "'x' AS tag", "'y' AS payload"))
    return {(r.export_id, r.tag, r.parent_key, r.child_key) for r in found.collect()}


def test_shapes(spark):
    plain = {"arguments": {"a1": {"text": "t", "judgments": {"r1": 2}}, "a2": {"stance": 1}}, "policies": {"P": {"pros": ["a1"], "cons": "a9"}}, "edges": {"X": [{"source": "a1", "target": "a2"}]}}
    listed = {"export": {"arguments": [{"id": "a1", "text": "t", "relations": [{"rel": "E", "target": "a2"}], "judgments": [{"annotator": "r1", "grade": None}]}], "policies": [{"name": "P", "pros": [{"arg_id": "a3", "text": "u"}], "cons": None, "edges": [{"arg1_id": "a1", "arg2_id": "a3"}]}]}}
    wrapped = {"version": 2, "payload": json.dumps(plain)}
    found = rows(spark, [(1, json.dumps(plain)), (2, json.dumps(listed)), (3, json.dumps(wrapped)), (4, json.dumps([plain])), (4, json.dumps([plain]))])
    one = {("argument", "", "a1"), ("judgment", "a1", "r1"), ("policy", "", "P"), ("pro", "P", "a1"), ("con", "P", "a9"), ("edge", "a1", "a2")}
    for export in (1, 3, 4):
        assert {x[1:] for x in found if x[0] == export} == one
    assert {x[1:] for x in found if x[0] == 2} == {("argument", "", "a1"), ("argument", "", "a3"), ("judgment", "a1", "r1"), ("policy", "", "P"), ("pro", "P", "a3"), ("edge", "a1", "a2"), ("edge", "a1", "a3")}


def test_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "null"), (6, "7"), (7, '{"arguments": 3, "policies": null, "edges": [null, 1, {}]}'), (None, "{}"), (8, json.dumps({"arguments": {"a": {"text": "x" * 200_000}}}))]
    assert rows(spark, docs) == {(8, "argument", "", "a")}


def test_empty_table_and_flat_table(spark, tmp_path):
    empty = spark.createDataFrame([], "export_id long, doc string")
    assert nested.flat_records(empty).count() == 0
    df = spark.createDataFrame([(1, '{"arguments": {"a": {"text": "t", "stance": -1, "pagerank_score": 0.5}}, "policies": ["P"]}')], "export_id long, doc string")
    nested.write_tables(df, str(tmp_path / "t"))
    table = nested.flat_table(spark.read.parquet(str(tmp_path / "t")), "argument").first()
    assert (table.child_key, table.text, table.stance, table.pagerank_score) == ("a", "t", -1, 0.5)
