"""Queries over the nested graph exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.operators import nested
from disputo.runtime import checkpoint_dir, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    emitted = nested.emit_records(table(spark, d, "graph_exports"))
    return emitted.select("export_id", F.col("tag").alias("child_kind"), "parent_key", "child_key").distinct()


def p1_flat_arguments(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of arguments with the number of judgments of each."""
    records = nested.flat_records(table(spark, d, "graph_exports"))
    judged = records.where("tag = 'judgment'").groupBy("export_id", F.col("parent_key").alias("child_key")).agg(F.count(F.lit(1)).alias("n_judgments"))
    arguments = nested.flat_table(records, "argument").join(judged, ["export_id", "child_key"], "left")
    return arguments.select("export_id", F.col("child_key").alias("arg_id"), "policy", "stance", "is_distractor", F.coalesce("n_judgments", F.lit(0)).alias("n_judgments"))


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of edges: several relations of the same ends are several rows."""
    edges = nested.flat_table(nested.flat_records(table(spark, d, "graph_exports"), at="loaded_at"), "edge")
    return edges.select("export_id", F.col("parent_key").alias("source"), F.col("child_key").alias("target"), "rel", "contra_fwd", "contra_bwd")


def p1_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """All records written once, partitioned by tag, each table read back with its schema: rows, exports and rows with a filled payload of every table."""
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    nested.write_tables(table(spark, d, "graph_exports"), path, at="loaded_at")
    records, out = spark.read.parquet(path), None
    for tag in nested.TAGS:
        flat = nested.flat_table(records, tag)
        filled = F.coalesce(*[F.col(c).isNotNull() for c in flat.columns[3:4]], F.lit(False))
        one = flat.agg(F.lit(tag).alias("tag"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("export_id").alias("n_exports"), F.count_if(filled).alias("n_filled"))
        out = one if out is None else out.union(one)
    return out


QUERIES = {f.__name__: f for f in (p1_found, p1_flat_arguments, p1_edges, p1_table_counts)}
ORACLES: dict[str, str] = {}
