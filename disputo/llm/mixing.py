"""Problem 9: a mixture of sources with target shares of all tokens.

Tokens are summed by source and hash bucket; the largest bucket threshold within a source's budget is
found from the histogram; only the boundary bucket is refined, twice; documents are then kept by comparing
their hash with the threshold.  Nothing is sorted, and the selections of growing budgets are nested.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from disputo.runtime import cut, small

#: Where the public tokenizer's file is, unless the caller names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bits of the hash looked at in each of the three levels.
BITS = 12
LEVELS = 3


def token_counts(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``tokens``, the number of tokens of the whole text; NULL and empty texts have 0.

    The tokenizer's file is read where the job starts and goes to the executors with it, so they need no copy of their own.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(SparkFiles.get(name))
        model.encode_special_tokens = True
        for texts in batches:
            encoded = model.encode_batch_fast(texts.fillna("").tolist(), add_special_tokens=False)
            yield pd.Series([len(x) for x in encoded], dtype="int64")

    return df.withColumn("tokens", count(F.col(text)))


def _level(rows: DataFrame, level: int) -> DataFrame:
    """Each source's largest threshold of this level within ``rest``: ``source``, ``cut_<level>``, and the ``rest`` left for the boundary bucket."""
    bucket = F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
    sums = rows.withColumn("bucket", bucket).groupBy("source", "rest", "bucket").agg(F.sum("tokens").alias("tokens"))
    running = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")))
    boundary = running.where("upto > rest").groupBy("source", "rest").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("b"))
    return boundary.select("source", F.col("b.bucket").alias(f"cut_{level}"), (F.col("rest") - F.col("b.before")).alias("rest"))


def mixture(df: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of the mixture of ``df`` with the shares of ``targets`` (source, target_share, max_repeats).

    documents: ``key``, ``source``, ``tokens``, ``repeats`` (1 or more).  report, one row per source on either side: ``source``, ``n_docs``,
    ``available_tokens``, ``target_share``, ``budget_tokens``, ``max_repeats``, ``mixed_tokens``, ``actual_share``.

    Shares are normalised over the sources that have tokens.  ``total_tokens`` is the size of the mixture; by default the
    largest at which every source can give its share within its repeats.  A source short of its budget gives all it may
    and the report shows the share really reached.  Whole passes come first; the rest of a budget is taken by hash, short of it by less than one
    document.  Sources without a target (NULL included) or without text are not mixed and are reported with 0; NULL and negative
    targets and repeats count as 0.  A key in several rows is one document, the longest of them.
    """
    docs = df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).where(F.col("key").isNotNull())
    # tokens are counted where texts are read, so that no text is shuffled to find keys that stand in several rows
    sizes = token_counts(docs, "text", tokenizer).select("key", "source", "tokens")
    once = sizes.groupBy("key").agg(F.max(F.struct("tokens", "source")).alias("d")).select("key", "d.source", "d.tokens")
    counted = cut(once.withColumn("hash", F.xxhash64(F.lit(9), "key")))
    available = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("available_tokens"))
    wanted = targets.groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    plan = available.join(wanted, available["source"].eqNullSafe(wanted["source"]), "full").select(
        F.coalesce(available["source"], wanted["source"]).alias("source"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_docs", "available_tokens", "max_repeats")],
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
    )
    usable = (F.col("available_tokens") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0)
    plan = plan.withColumn("share", F.when(usable, F.col("target_share")).otherwise(0.0))
    whole = plan.agg(F.sum("share").alias("all_shares"), F.min(F.when(usable, F.col("available_tokens") * F.col("max_repeats") / F.col("share"))).alias("most"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("most") * F.col("all_shares")
    plan = plan.join(F.broadcast(whole)).withColumn("budget_tokens", F.coalesce(F.when(usable, F.col("share") / F.col("all_shares") * total), F.lit(0.0)))
    passes = F.least(F.floor((F.col("budget_tokens") + 1e-6) / F.greatest("available_tokens", F.lit(1))), F.col("max_repeats").cast("long"))
    plan = cut(
        plan.withColumn("passes", F.when(usable, passes).otherwise(F.lit(0).cast("long")))
        .withColumn("rest", F.when(usable & (F.col("passes") < F.col("max_repeats")), F.col("budget_tokens") - F.col("passes") * F.col("available_tokens")).otherwise(0.0))
        .drop("all_shares", "most", "share")
    )
    rows = counted.join(small(plan.where("rest > 0").select("source", "rest")), "source")
    cuts = None
    for level in range(LEVELS):
        found = cut(_level(rows, level))
        cuts = found if cuts is None else found.join(cuts.drop("rest"), "source")
        inside = F.shiftrightunsigned("hash", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1)) == F.col(f"cut_{level}")
        rows = rows.drop("rest").join(small(found, stored=True), "source").where(inside).drop(f"cut_{level}")
    threshold = sum((F.shiftleft(F.col(f"cut_{k}"), BITS * (LEVELS - 1 - k)) for k in range(LEVELS)), F.lit(0))
    limits = cuts.select(F.col("source").alias("s"), threshold.alias("threshold"))
    limits = plan.where("max_repeats > 0 AND available_tokens > 0").join(limits, F.col("source") == F.col("s"), "left").select("source", "passes", F.when(F.col("rest") > 0, F.col("threshold")).otherwise(F.lit(0)).alias("threshold"))
    kept = counted.join(small(limits), "source").withColumn("repeats", F.col("passes") + (F.shiftrightunsigned("hash", 64 - BITS * LEVELS) < F.col("threshold")).cast("long"))
    kept = kept.where("repeats > 0").select("key", "source", "tokens", "repeats")
    taken = kept.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    size = taken.agg(F.sum("mixed_tokens").alias("mixed_total"))
    report = plan.join(taken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").join(F.broadcast(size)).select(
        "source", "n_docs", "available_tokens", "target_share", "budget_tokens", "max_repeats", F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / F.col("mixed_total"), F.lit(0.0)).alias("actual_share"),
    )
    return kept.withColumnRenamed("key", key), report
