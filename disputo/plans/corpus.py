"""Corpus queries: cleaning, counts, taxonomy, strata, keywords, deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputo.functions import scalars
from disputo.operators import corpus
from disputo.functions.scalars import exact_mean
from disputo.plans._views import ARGS, Registry, arguments, policy_table, rounded, vectors
from disputo.runtime import table
from disputo.sources import files

query = Registry()
# Frequent words that say nothing about a topic.
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "its", "their", "there", "which", "while", "when", "where", "than", "more", "only", "both", "them", "they", "have", "has", "had", "was", "were", "are", "but", "not", "who", "how", "why", "should", "would", "could", "can", "will", "over", "after", "before", "between", "because", "say", "says", "said")


@query("""SELECT split_name, count(*) AS n FROM arguments_clean GROUP BY 1""")
def corpus_split_counts(spark: SparkSession, d: str) -> DataFrame:
    """The splits read one by one, put under each other again and counted."""
    rows = table(spark, d, "arguments_clean")
    named = {s: rows.where(F.col("split_name") == s).drop("split_name") for s in ("train", "validation", "test")}
    rest = rows.where(~F.coalesce(F.col("split_name").isin(*named), F.lit(False)))
    return corpus.value_counts(corpus.union_splits(named).unionByName(rest), "split_name")


@query(f"""WITH {ARGS}, clean AS (SELECT arg_id, regexp_replace(argument, '^\\s+|\\s+$', '', 'g') AS text, policy, stance FROM args)
SELECT arg_id, text, length(text)::INTEGER AS n_chars, policy, CASE stance WHEN 1 THEN 'PRO' WHEN -1 THEN 'CON' WHEN 0 THEN 'NEUTRAL' END AS stance_label FROM clean WHERE length(text) >= 35""")
def corpus_clean(spark: SparkSession, d: str) -> DataFrame:
    """Renamed, trimmed, filtered by length, labelled."""
    rows = arguments(spark, d, "argument", "policy", "stance").withColumnsRenamed({"argument": "text"})
    return corpus.clean_arguments(rows, "text").select("arg_id", "text", F.length("text").alias("n_chars"), "policy", "stance_label")


@query(f"""WITH {ARGS} SELECT arg_id, 'arg_' || (row_number() OVER (ORDER BY arg_id) - 1) AS new_id, row_number() OVER (ORDER BY arg_id) - 1 AS position FROM args WHERE length(trim(argument)) >= 100""")
def corpus_positional_ids(spark: SparkSession, d: str) -> DataFrame:
    """New ids by position after filtering."""
    rows = arguments(spark, d, "argument").where(F.length(F.trim("argument")) >= 100).select("arg_id")
    return corpus.positional_ids(rows, ["arg_id"]).withColumn("new_id", F.concat(F.lit("arg_"), F.col("position").cast("string")))


@query(f"""WITH {ARGS} SELECT count(*) FILTER (stance = 0) AS n_neutral, count(*) FILTER (stance = 1) AS n_pro, count(*) FILTER (stance = -1) AS n_con, count(*) FILTER (stance IS NULL) AS n_missing,
  count(*) FILTER (stance_confidence < 0.7) AS n_unsure, count(*) FILTER (argument <> '') AS n_texts, count(DISTINCT policy) AS n_policies, count(DISTINCT argument) AS n_distinct_texts FROM args""")
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = arguments(spark, d, "stance", "stance_confidence", "argument", "policy")
    stance = F.col("stance")
    return rows.agg(
        F.count_if(stance == 0).alias("n_neutral"), F.count_if(stance == 1).alias("n_pro"), F.count_if(stance == -1).alias("n_con"), F.count_if(stance.isNull()).alias("n_missing"),
        F.count_if(F.col("stance_confidence") < 0.7).alias("n_unsure"), F.count_if(F.col("argument") != "").alias("n_texts"), F.countDistinct("policy").alias("n_policies"), F.countDistinct("argument").alias("n_distinct_texts"),
    )


@query(f"""WITH {ARGS} SELECT policy, stance, count(*) AS n FROM args GROUP BY ALL""")
def corpus_policy_stance_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.value_counts(arguments(spark, d, "policy", "stance"), "policy", "stance")


@query(f"""WITH {ARGS}, c AS (SELECT policy, count(*) AS n_args FROM args GROUP BY 1) SELECT count(n_args) AS n, round(avg(n_args), 6) AS mean, round(stddev_samp(n_args), 6) AS std, min(n_args) AS low,
  round(quantile_cont(n_args, 0.25), 6) AS q25, round(quantile_cont(n_args, 0.5), 6) AS median, round(quantile_cont(n_args, 0.75), 6) AS q75, max(n_args) AS high FROM c""")
def corpus_policy_size_describe(spark: SparkSession, d: str) -> DataFrame:
    sizes = arguments(spark, d, "policy").groupBy("policy").agg(F.count(F.lit(1)).alias("n_args"))
    return rounded(corpus.describe(sizes, [], "n_args"))


@query("""SELECT policy, count(stance_confidence) AS n, round(avg(stance_confidence), 6) AS mean, round(stddev_samp(stance_confidence), 6) AS std, round(min(stance_confidence), 6) AS low, round(quantile_cont(stance_confidence, 0.25), 6) AS q25,
  round(quantile_cont(stance_confidence, 0.5), 6) AS median, round(quantile_cont(stance_confidence, 0.75), 6) AS q75, round(max(stance_confidence), 6) AS high FROM arguments_clean GROUP BY policy""")
def corpus_confidence_describe(spark: SparkSession, d: str) -> DataFrame:
    return rounded(corpus.describe(table(spark, d, "arguments_clean"), ["policy"], "stance_confidence"))


@query("""SELECT stance, count(DISTINCT stance_label) AS n_values, string_agg(DISTINCT stance_label, '|' ORDER BY stance_label) AS labels FROM arguments_clean GROUP BY 1 HAVING count(DISTINCT stance_label) > 1""")
def corpus_ambiguous_labels(spark: SparkSession, d: str) -> DataFrame:
    """Stances that carry more than one spelling of their label."""
    found = corpus.ambiguous(table(spark, d, "arguments_clean"), "stance", "stance_label")
    return found.select("stance", "n_values", F.array_join("values", "|").alias("labels"))


@query("""SELECT count(*) AS n_rows, count(*) - count(DISTINCT (argument, policy)) AS n_duplicates FROM arguments_clean""")
def corpus_duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.duplicate_rows(table(spark, d, "arguments_clean"), ["argument", "policy"])


@query("""SELECT topic, string_agg(metapolicy_name, ' ' ORDER BY metapolicy_name) AS names, count(*) AS n FROM taxonomy GROUP BY 1""")
def corpus_topic_names(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a group put together in order."""
    return table(spark, d, "taxonomy").groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("metapolicy_name")), " ").alias("names"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {ARGS}, dim AS (SELECT policy, any_value(metapolicy_id) AS metapolicy_id FROM policies GROUP BY 1) SELECT dim.metapolicy_id, t.metapolicy_name, t.topic, count(*) AS n FROM args LEFT JOIN dim USING (policy) LEFT JOIN taxonomy t ON t.metapolicy_id = dim.metapolicy_id GROUP BY ALL""")
def corpus_taxonomy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Arguments per metapolicy and topic; unmapped ones have NULLs."""
    joined = corpus.with_taxonomy(arguments(spark, d, "policy").select("arg_id", "policy"), policy_table(spark, d), table(spark, d, "taxonomy"))
    return corpus.value_counts(joined, "metapolicy_id", "metapolicy_name", "topic")


@query(f"""WITH {ARGS} SELECT arg_id, policy FROM args a WHERE policy IS NULL OR NOT EXISTS (SELECT 1 FROM policies p WHERE p.policy = a.policy AND p.metapolicy_id IS NOT NULL)""")
def corpus_unmapped(spark: SparkSession, d: str) -> DataFrame:
    joined = corpus.with_taxonomy(arguments(spark, d, "policy").select("arg_id", "policy"), policy_table(spark, d), table(spark, d, "taxonomy"))
    return joined.where("metapolicy_id IS NULL").select("arg_id", "policy")


@query("""SELECT doc_id, policy FROM documents d WHERE policy IS NULL OR NOT EXISTS (SELECT 1 FROM policies p WHERE p.policy = d.policy AND p.metapolicy_id IS NOT NULL)""")
def corpus_unmapped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents that belong to no metapolicy, as their policy is missing or unknown."""
    joined = corpus.with_taxonomy(table(spark, d, "documents").select("doc_id", "policy"), policy_table(spark, d), table(spark, d, "taxonomy"))
    return joined.where("metapolicy_id IS NULL").select("doc_id", "policy")


@query("""SELECT CASE WHEN metapolicy_id = 9 THEN 7 ELSE metapolicy_id END AS metapolicy_id, CASE WHEN metapolicy_id = 9 THEN 'Folded' ELSE metapolicy_name END AS metapolicy_name, count(*) AS n_policies FROM policies GROUP BY ALL""")
def corpus_folded_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """One metapolicy folded into another, then counted."""
    folded = corpus.fold_metapolicy(table(spark, d, "policies"), 9, 7, "Folded")
    return folded.groupBy("metapolicy_id", "metapolicy_name").agg(F.count(F.lit(1)).alias("n_policies"))


@query("""WITH n AS (SELECT cluster_id, min(topic_name) AS name FROM debater_dataset_with_clusters WHERE cluster_id >= 0 GROUP BY 1)
SELECT CASE WHEN x.cluster_id = -1 THEN 'Noise' ELSE n.name END AS topic, count(*) AS n FROM debater_dataset_with_clusters x LEFT JOIN n USING (cluster_id) GROUP BY 1""")
def corpus_cluster_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topic of every clustered row; -1 is noise, unknown clusters are NULL."""
    rows = table(spark, d, "debater_dataset_with_clusters")
    names = rows.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("topic_name").alias("name"))
    joined = rows.select("cluster_id").join(names, "cluster_id", "left")
    return corpus.value_counts(joined.select(F.when(F.col("cluster_id") == -1, "Noise").otherwise(F.col("name")).alias("topic")), "topic")


@query(f"""WITH {ARGS} SELECT CASE WHEN stance = 1 THEN 'SUPPORTS' ELSE 'ATTACKS' END AS rel, a.policy AS target, count(*) AS n, round((sum(stance_confidence::DECIMAL(30,15)) / count(stance_confidence))::DOUBLE, 6) AS confidence
  FROM args a JOIN (SELECT DISTINCT policy FROM policies) p USING (policy) WHERE stance IN (1, -1) GROUP BY ALL""")
def graph_stance_edges(spark: SparkSession, d: str) -> DataFrame:
    found = corpus.stance_edges(arguments(spark, d, "policy", "stance", "stance_confidence"), policy_table(spark, d))
    return rounded(found.groupBy("rel", "target").agg(F.count(F.lit(1)).alias("n"), exact_mean("confidence").alias("confidence")))


@query(f"""WITH {ARGS}, e AS (SELECT arg_id, policy FROM args JOIN (SELECT DISTINCT policy FROM policies) p USING (policy) WHERE stance IN (1, -1))
SELECT 'argument' AS label, arg_id AS node FROM args WHERE arg_id NOT IN (SELECT arg_id FROM e) UNION ALL SELECT 'policy', policy FROM policies WHERE policy NOT IN (SELECT policy FROM e)""")
def graph_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Arguments and policies without an edge between them."""
    rows, policies = arguments(spark, d, "policy", "stance", "stance_confidence"), policy_table(spark, d)
    found = corpus.stance_edges(rows, policies)
    lone_arguments = corpus.orphans(rows.select("arg_id"), "arg_id", found, "source").select(F.lit("argument").alias("label"), F.col("arg_id").alias("node"))
    return lone_arguments.union(corpus.orphans(policies.select("policy"), "policy", found, "target").select(F.lit("policy"), "policy"))


@query(f"""WITH {ARGS} SELECT 'Argument' AS label, count(*) AS n FROM args UNION ALL SELECT 'Policy', count(DISTINCT policy) FROM policies UNION ALL SELECT 'MetaPolicy', count(DISTINCT metapolicy_id) FROM taxonomy
  UNION ALL SELECT 'Topic', count(DISTINCT topic) FROM taxonomy""")
def graph_node_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = {"Argument": arguments(spark, d).select("arg_id"), "Policy": policy_table(spark, d).select("policy"), "MetaPolicy": table(spark, d, "taxonomy").select("metapolicy_id").distinct(), "Topic": table(spark, d, "taxonomy").select("topic").distinct()}
    return files.union_rows([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n") for label, df in counts.items()])


@query("""SELECT arg_id, loaded_at FROM arguments_clean WHERE arg_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arg_id ORDER BY loaded_at DESC) = 1""")
def deliveries_upserted(spark: SparkSession, d: str) -> DataFrame:
    """An idempotent load: all deliveries merged into an empty table, the latest per key staying."""
    rows = table(spark, d, "arguments_clean").where("arg_id IS NOT NULL")
    return files.upsert(rows.where(F.lit(False)), rows, ["arg_id"], [F.desc("loaded_at")]).select("arg_id", "loaded_at")


@query("""SELECT arg_id, count(*) AS n_rows FROM arguments_clean GROUP BY 1 HAVING count(*) > 1""")
def deliveries_violations(spark: SparkSession, d: str) -> DataFrame:
    return files.violations(table(spark, d, "arguments_clean"), ["arg_id"])


@query("""SELECT count(*) AS n, count(*) FILTER (coalesce(len(embedding) <> 64, true)) AS n_wrong_size,
  count(*) FILTER (len(embedding) = 64 AND coalesce(abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.001 OR len(list_filter(embedding, lambda x: x IS NULL)) > 0, true)) AS n_not_unit FROM debater_dataset_with_clusters""")
def vectors_check(spark: SparkSession, d: str) -> DataFrame:
    return files.vector_check(table(spark, d, "debater_dataset_with_clusters"), "embedding", 64)


@query("""WITH r AS (SELECT policy, n_arguments, row_number() OVER (ORDER BY n_arguments, policy) AS rn, count(*) OVER () // 3 AS third FROM policies), t AS (SELECT *, CASE WHEN rn <= third THEN 0 WHEN rn <= 2 * third THEN 1 ELSE 2 END AS tercile FROM r)
SELECT tercile::INTEGER AS tercile, count(*) AS n, min(n_arguments) || '–' || max(n_arguments) || ' args' AS label FROM t GROUP BY 1""")
def strata_terciles(spark: SparkSession, d: str) -> DataFrame:
    """Policies in three bins by size, the remainder in the last."""
    binned = corpus.terciles(policy_table(spark, d), "n_arguments", "policy")
    return binned.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), scalars.range_label(F.min("n_arguments"), F.max("n_arguments")).alias("label"))


@query("""WITH r AS (SELECT policy, n_arguments, row_number() OVER (ORDER BY n_arguments, policy) AS rn, count(*) OVER () // 3 AS third FROM policies), t AS (SELECT *, CASE WHEN rn <= third THEN 0 WHEN rn <= 2 * third THEN 1 ELSE 2 END AS tercile FROM r)
SELECT tercile::INTEGER AS tercile, policy FROM t QUALIFY row_number() OVER (PARTITION BY tercile ORDER BY md5('42|' || policy), policy) <= 10""")
def strata_sample(spark: SparkSession, d: str) -> DataFrame:
    binned = corpus.terciles(policy_table(spark, d), "n_arguments", "policy")
    return corpus.stratified_sample(binned, "tercile", "policy", 10).select("tercile", "policy")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"""WITH {ARGS}, c AS (SELECT arg_id, max(cluster_id) AS cluster_id FROM debater_dataset_with_clusters WHERE cluster_id IS NOT NULL GROUP BY 1),
t AS (SELECT cluster_id, unnest(regexp_extract_all(lower(argument), '[a-z][a-z]+')) AS term FROM args JOIN c USING (arg_id)), tf AS (SELECT cluster_id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL),
n AS (SELECT count(DISTINCT cluster_id) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT cluster_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term), n),
s AS (SELECT cluster_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id)), 9) AS score FROM w)
SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term)::INTEGER AS rank, term, round(score, 6) AS score FROM s QUALIFY rank <= 3""")
def text_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest terms of every cluster."""
    clusters = table(spark, d, "debater_dataset_with_clusters").where("cluster_id IS NOT NULL").groupBy("arg_id").agg(F.max("cluster_id").alias("cluster_id"))
    texts = arguments(spark, d, "argument").join(clusters, "arg_id")
    return rounded(corpus.tf_idf(texts, "cluster_id", "argument", STOP_WORDS))


@query()
def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Documents in NFKD without URLs, tags, references and surplus space (SQL has no NFKD; tested against unicodedata)."""
    return table(spark, d, "documents").select("doc_id", scalars.clean_text("text").alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '', 'g'), '<.*?>', '', 'g'), '\\[\\d+\\]', '', 'g'), '[\\s\\x{00A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents""")
def text_cleaned_composed(spark: SparkSession, d: str) -> DataFrame:
    """The same cleaning with characters left as they are, which SQL can follow."""
    return table(spark, d, "documents").select("doc_id", scalars.clean_text("text", decompose=False).alias("text"))


@query("""SELECT policy, trim(regexp_replace(lower(policy), '[^a-z0-9]+', '_', 'g'), '_') AS slug, replace(lower(policy), ' ', '_') AS safe_name FROM policies""")
def text_slugs(spark: SparkSession, d: str) -> DataFrame:
    return policy_table(spark, d).select("policy", scalars.slug("policy").alias("slug"), scalars.safe_name("policy").alias("safe_name"))


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[\\s\\x{00A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2007}\\x{2009}\\x{202F}\\x{3000}]+', ' ', 'g')), ' ')) END AS n FROM documents)
SELECT doc_id, n::INTEGER AS n_words, CASE WHEN n > 0 THEN round(greatest(1, len(regexp_extract_all(text, '[.!?]+'))) / n::DOUBLE * 100, 6) END AS conciseness, n >= 50 AS is_paragraph FROM t""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    """Words, conciseness and acceptance as a paragraph of every document."""
    docs = table(spark, d, "documents")
    return rounded(docs.select("doc_id", scalars.token_count("text").alias("n_words"), scalars.conciseness("text").alias("conciseness"), F.coalesce(scalars.acceptable_paragraph("text"), F.lit(False)).alias("is_paragraph")))


@query("""SELECT lower(trim(lang)) AS lang, source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL""")
def text_document_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.lower(F.trim("lang")).alias("lang"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


QUERIES, ORACLES = query.queries, query.oracles
