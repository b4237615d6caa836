"""Readers and writers: CSV, JSON documents, vectors, graph exports, retrieval and metric stores, checkpoints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from disputo.functions.scalars import fmt, strip
from disputo.functions.vectors import norm
from disputo.operators import nested


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header; quotes inside quoted fields are doubled, texts may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A CSV without index, space at the ends of texts kept; with ``order`` range-sorted, so files read in name order are sorted."""
    ordered = df.orderBy(*order) if order else df
    ordered.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON documents, one per file, of any layout."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines checkpoint; an empty table where it is missing, corrupt lines left out."""
    kind = T.StructType.fromDDL(schema).add("_corrupt", T.StringType())
    try:
        rows = spark.read.schema(kind).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def vector_check(df: DataFrame, vector: str, size: int, tolerance: float = 1e-3) -> DataFrame:
    """One row: ``n``, ``n_wrong_size``, ``n_not_unit`` - the self-check of stored vectors (NULL vectors have the wrong size)."""
    wrong = F.coalesce(F.size(vector) != size, F.lit(True))
    odd = F.coalesce(F.abs(norm(vector) - 1) > tolerance, F.lit(True))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong_size"), F.count_if(~wrong & odd).alias("n_not_unit"))


class ArgumentGraph:
    """The flat tables of one or more graph exports: ``arguments``, ``pools``, ``edges``, ``policies``."""

    def __init__(self, records: DataFrame):
        self.arguments = nested.flat_table(records, "argument").drop("parent_key").withColumnRenamed("child_key", "arg_id")
        self.policies = nested.flat_table(records, "policy").drop("parent_key").withColumnRenamed("child_key", "policy")
        pools = [nested.flat_table(records, tag).withColumn("stance", F.lit(stance)) for tag, stance in (("pro", 1), ("con", -1))]
        self.pools = pools[0].union(pools[1]).select("export_id", F.col("parent_key").alias("policy"), "stance", F.col("pos").alias("pool_pos"), F.col("child_key").alias("arg_id"))
        self.edges = nested.flat_table(records, "edge").withColumnsRenamed({"parent_key": "source", "child_key": "target"})


def load_graph(spark: SparkSession, path: str) -> ArgumentGraph:
    """Graph exports, one JSON document per file; raises FileNotFoundError where there is none."""
    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        raise FileNotFoundError(path) from error
    docs = docs.select(F.xxhash64(F.col("_metadata.file_path")).alias("export_id"), F.col("value").alias("doc"))
    return ArgumentGraph(nested.flat_records(docs))


def load_corpus(pools: DataFrame, arguments: DataFrame) -> DataFrame:
    """Pool rows joined to their arguments (arg_id, text, embedding), only those with text and embedding."""
    usable = arguments.where((strip("text") != "") & F.col("embedding").isNotNull()).select("arg_id", "text", "embedding")
    return pools.join(usable, "arg_id")


def full_corpus(arguments: DataFrame) -> DataFrame:
    """(text, embedding, policy) of all usable arguments; a missing policy is ''."""
    rows = arguments.where((strip("text") != "") & F.col("embedding").isNotNull())
    return rows.select("text", "embedding", F.coalesce("policy", F.lit("")).alias("policy"))


def upsert(current: DataFrame, new: DataFrame, key: list[str], latest: list[Column]) -> DataFrame:
    """Rows of both, one per key: the first by ``latest``; the merge of an idempotent graph load."""
    order = W.partitionBy(*key).orderBy(*latest)
    both = current.unionByName(new, allowMissingColumns=True)
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are not unique, with their number of rows; NULL keys count as one key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def write_retrieval(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("pool", "k", "system").parquet(path)


def read_retrieval(spark: SparkSession, path: str, pool: int | None = None, k: int | None = None, system: str | None = None) -> DataFrame:
    """Stored lists; the configuration is pruned by partition."""
    df = spark.read.parquet(path)
    for name, value in (("pool", pool), ("k", k), ("system", system)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def load_manifest(spark: SparkSession, path: str, schema: str = "policy string, stance int, text string") -> DataFrame | None:
    """The distractor manifest with trimmed texts, each once; None where there is none (metrics are then NULL, not 0)."""
    try:
        rows = spark.read.schema(schema).json(path)
    except AnalysisException:
        return None
    return rows.withColumn("text", strip("text")).distinct()


def union_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; columns in the order they first appear, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def wide_metrics(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """A long metric table (metric, value) as one column per metric; ``names`` are given, so no pass over the data finds them."""
    return metrics.groupBy(*by).pivot("metric", names).agg(F.first("value"))


def report(df: DataFrame, numbers: list[str], digits: int = 3) -> DataFrame:
    """A printable table: numbers with ``digits`` decimals, '-' for NULL."""
    return df.withColumns({c: fmt(c, digits) for c in numbers})


def replace_atomically(df: DataFrame, path: str, backup: bool = True) -> None:
    """Write beside ``path``, then put the result in its place by renames; the former content becomes ``<path>.bak``."""
    spark = df.sparkSession
    jvm = spark._jvm
    target, fresh, former = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp", f"{path}.bak"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    if fs.exists(target):
        fs.delete(former, True)
        if not fs.rename(target, former):
            raise OSError(f"cannot set aside {path}")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot put {path} in place")
    if not backup:
        fs.delete(former, True)


def reset_plan(store: DataFrame, systems: list[str], metrics: list[str]) -> DataFrame:
    """What a reset would do to a metric store: ``action`` (keep, delete, strip) and rows, by system."""
    action = F.when(F.col("system").isin(systems), "delete").when(F.col("metric").isin(metrics), "strip").otherwise("keep")
    return store.groupBy("system", action.alias("action")).agg(F.count(F.lit(1)).alias("n_rows"))


def reset(store: DataFrame, systems: list[str], metrics: list[str], apply: bool = False) -> DataFrame:
    """The store without the systems and metrics, if ``apply``; by default the plan only."""
    return store.where(~F.col("system").isin(systems) & ~F.col("metric").isin(metrics)) if apply else reset_plan(store, systems, metrics)


def current_version(store: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """(rows of this schema version, rows to be archived); rows without a version are archived."""
    current = F.coalesce(F.col("schema_version") == version, F.lit(False))
    return store.where(current), store.where(~current)


def pending(units: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Units of work that are not finished: the resume step."""
    return units.join(done.select(*key).distinct(), key, "left_anti")


def merge_edges(edges: DataFrame, mined: DataFrame) -> DataFrame:
    """A new version of the edges: the mined relations replace those of the same name."""
    return edges.join(mined.select("rel").distinct(), "rel", "left_anti").unionByName(mined, allowMissingColumns=True)


def label_sample(scored: DataFrame, by: str, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per relation for labelling by hand, drawn by a seeded hash of the key, with an empty ``label``."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    ranked = scored.withColumn("_drawn", drawn).withColumn("_rn", F.row_number().over(W.partitionBy(by).orderBy("_drawn", *key)))
    return ranked.where(F.col("_rn") <= n).drop("_drawn", "_rn").withColumn("label", F.lit(""))
