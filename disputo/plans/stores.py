"""Round trips through the readers, writers and stores, on scratch folders beside the checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.plans._views import ARGS, POOL, Registry, arguments, pool, policy_table
from disputo.runtime import checkpoint_dir, table
from disputo.sources import files

query = Registry()


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


@query(f"WITH {ARGS} SELECT arg_id, argument, policy, stance FROM args")
def store_csv(spark: SparkSession, d: str) -> DataFrame:
    """All arguments written as CSV with header and read again: quotes, commas and line breaks in the texts come back."""
    path = scratch(spark)
    files.write_csv(arguments(spark, d, "argument", "policy", "stance").select("arg_id", "argument", "policy", "stance"), path)
    return files.read_csv(spark, path, "arg_id string, argument string, policy string, stance int")


@query("""SELECT doc_id, lang, source, policy FROM documents""")
def store_json(spark: SparkSession, d: str) -> DataFrame:
    """Document records written as JSON and read again with a given schema; NULL fields come back as NULL."""
    path = scratch(spark)
    files.write_json(table(spark, d, "documents").select("doc_id", "lang", "source", "policy"), path)
    return spark.read.schema("doc_id long, lang string, source string, policy string").json(path)


@query("""SELECT count(*) AS n, count(*) FILTER (coalesce(len(embedding) <> 64, true)) AS n_wrong_size, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), 2) AS total FROM debater_dataset_with_clusters""")
def store_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All vectors written and read again, with their self-check and the sum of all numbers."""
    path = scratch(spark)
    files.write_vectors(table(spark, d, "debater_dataset_with_clusters").select("arg_id", "embedding"), path)
    back = spark.read.parquet(path)
    finite = (F.size("embedding") == 64) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sums = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return files.vector_check(back, "embedding", 64).select("n", "n_wrong_size").join(back.agg(F.round(F.sum(F.when(finite, sums)), 2).alias("total")))


@query(f"""WITH {POOL} SELECT policy, least(count(*), 20) AS n FROM pool WHERE stance = 1 GROUP BY 1""")
def store_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of two configurations in a partitioned store, of which one is read back by its configuration alone."""
    path = scratch(spark)
    rows = pool(spark, d, text=True).where("stance = 1")
    lists = rows.withColumns({"rank": (F.col("pool_pos") + 1).cast("int"), "system": F.lit("System A"), "k": F.lit(5)}).withColumn("pool", F.explode(F.array(F.lit(20), F.lit(50)))).where("pool_pos < pool")
    files.write_retrieval(lists.select("pool", "k", "system", "policy", "stance", "rank", "arg_id", "text"), path)
    return files.read_retrieval(spark, path, pool=20, k=5, system="System A").groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH done AS (SELECT DISTINCT policy FROM documents WHERE source = 'uc2_summary' AND policy IS NOT NULL) SELECT DISTINCT policy FROM policies WHERE policy IS NOT NULL AND policy NOT IN (SELECT policy FROM done)""")
def store_pending(spark: SparkSession, d: str) -> DataFrame:
    """Resume: policies without a summary, by a JSON-lines checkpoint of those that have one, written and read again."""
    path = scratch(spark)
    files.write_json(table(spark, d, "documents").where("source = 'uc2_summary' AND policy IS NOT NULL").select("policy", "doc_id"), path)
    done = files.load_checkpoint(spark, path, "policy string, doc_id long")
    return files.pending(policy_table(spark, d).select("policy"), done, ["policy"])


@query("""WITH m AS (SELECT policy, source AS system, count(*) AS n FROM documents WHERE policy IS NOT NULL AND source IS NOT NULL GROUP BY ALL)
SELECT system, CASE WHEN system = 'leaflet' THEN 'delete' ELSE 'keep' END AS action, count(*) AS n_rows FROM m GROUP BY ALL""")
def store_reset_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a reset of one system would do to a metric store (documents per policy and source stand in it); nothing is changed."""
    counts = table(spark, d, "documents").where("policy IS NOT NULL AND source IS NOT NULL").groupBy("policy", F.col("source").alias("system")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    store = counts.withColumn("metric", F.lit("n_documents"))
    return files.reset(store, ["leaflet"], [])


@query("""SELECT policy, max(loaded_at) AS loaded_at, count(*) AS n FROM documents WHERE policy IS NOT NULL GROUP BY 1""")
def store_replaced(spark: SparkSession, d: str) -> DataFrame:
    """A table replaced in place by renames: first an older version, then the current one, which is read."""
    path = scratch(spark)
    counts = table(spark, d, "documents").where("policy IS NOT NULL").groupBy("policy").agg(F.max("loaded_at").alias("loaded_at"), F.count(F.lit(1)).alias("n"))
    files.replace_atomically(counts.withColumn("n", F.lit(0).cast("long")), path)
    files.replace_atomically(counts, path)
    return spark.read.parquet(path)


QUERIES, ORACLES = query.queries, query.oracles
