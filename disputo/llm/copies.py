"""Problem 5: records that are the same but for case, spacing, punctuation or the order of labelled fields.

Every record becomes a multiset of (field name, field value) pairs.  Each pair is hashed, the hashes are
added up (a commutative multiset hash, so the order of fields does not matter and nothing is sorted), and
records are grouped by the 128-bit sum.  A second aggregate then verifies field by field that all records of a
group hold the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputo.functions.scalars import SUMMARY_FIELDS
from disputo.llm.forms import consistent_form
from disputo.runtime import cut, hot_join, remove, store

LABELS = SUMMARY_FIELDS


def label_pattern(labels: tuple[str, ...] = LABELS) -> str:
    """A Java pattern for the labels in lower case, whatever stands for the underscore."""
    return r"(?<![\p{L}\p{N}])(" + "|".join(x.lower().replace("_", r"[^\p{L}\p{N}]{0,3}") for x in labels) + r")(?![\p{L}\p{N}])"


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def labelled_fields(lowered: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The fields of a text (lower case, consistent form): an array of (name, value), letters and digits only.

    A text in which each label stands exactly once has a field per label, and one named '' for what stands
    before the first label.  Any other text is one field named ''.
    """
    pattern = F.lit(label_pattern(labels))
    names = F.regexp_extract_all(lowered, pattern, F.lit(1))
    plain = F.transform(names, _letters)
    values = F.split(lowered, label_pattern(labels))
    named = F.zip_with(
        F.concat(F.array(F.lit("")), plain), values, lambda name, value: F.struct(name.alias("name"), _letters(value).alias("value"))
    )
    whole = F.array(F.struct(F.lit("").alias("name"), _letters(lowered).alias("value")))
    once = (F.size(names) == len(labels)) & (F.size(F.array_distinct(plain)) == len(labels))
    return F.when(once, named).otherwise(whole)


def fingerprint(fields: Column, seed: int) -> Column:
    """Sum (modulo 2^64, computed in two halves) of the hashes of all (name, value) pairs."""
    hashes = F.transform(fields, lambda f: F.xxhash64(F.lit(seed), f["name"], f["value"]))
    # sums of 32-bit halves cannot overflow a long below 2^31 fields
    low = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + h.bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.aggregate(hashes, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, 32))
    return F.xxhash64(low, high)


def fingerprints(df: DataFrame, key: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per record with letters or digits: ``key``, ``fp_1``, ``fp_2`` (128-bit fingerprint) and ``fields``.

    Records without a key, NULL texts and texts without letters or digits are left out.  A key that
    stands in several rows with one content is one record.  Other columns are not read.
    """
    formed = df.select(F.col(key).alias("key"), F.lower(consistent_form(F.col(text))).alias("lowered")).where(
        F.col("key").isNotNull() & F.col("lowered").rlike(r"[\p{L}\p{N}]")
    )
    return formed.withColumn("fields", labelled_fields(F.col("lowered"), labels)).select(
        "key", fingerprint(F.col("fields"), 11).alias("fp_1"), fingerprint(F.col("fields"), 23).alias("fp_2"), "fields"
    )


def copy_groups(df: DataFrame, key: str, text: str, labels: tuple[str, ...] = LABELS, verify: bool = True) -> DataFrame:
    """One row per record: ``key``, ``group_key`` (smallest key among its copies), ``n_copies``.

    Records are copies if their letters and digits, in the consistent form and lower case, are the same in the
    same order, labelled fields standing in any order.  A record without copies is its own group of 1.
    Copies are never expanded into pairs and never collected: grouping is one hash aggregate over
    (fingerprint, key), so a group that holds a third of all rows is combined on the map side.  With
    ``verify`` the groups of two and more are checked: each record's fields are compared with those
    of the group's first record, and records that differ (a hash collision) leave it and form groups of their own.
    NULL, empty and letterless texts are left out; an empty table gives no rows.
    """
    prints = fingerprints(df, key, text, labels)
    records = cut(prints.select("key", "fp_1", "fp_2").distinct())
    groups = cut(records.groupBy("fp_1", "fp_2").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n_copies")))
    members = hot_join(records, groups, ["fp_1", "fp_2"], "n_copies")
    if verify:
        several = members.where("n_copies > 1").select(F.col("key").alias(key)).distinct()
        # the fields of records with copies are made once and read twice
        fields, path = store(fingerprints(df.select(key, text).join(several, key, "left_semi"), key, text, labels))
        # empty unless two contents share 128 bits: they leave the group and form groups by a third fingerprint
        moved = cut(_differing(fields, groups))
        remove(df.sparkSession, path)
        if not moved.isEmpty():
            left = moved.groupBy("fp_1", "fp_2").agg(F.count(F.lit(1)).alias("gone"))
            own = moved.groupBy("fp_1", "fp_2", "fp_3").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("n_copies"))
            stay = members.join(moved, ["key", "fp_1", "fp_2"], "left_anti").join(left, ["fp_1", "fp_2"], "left")
            stay = stay.select("key", "group_key", (F.col("n_copies") - F.coalesce("gone", F.lit(0))).alias("n_copies"))
            members = stay.union(moved.join(own, ["fp_1", "fp_2", "fp_3"]).select("key", "group_key", "n_copies"))
    return members.select("key", "group_key", "n_copies")


def _differing(prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Members whose fields are not those of their group's first record; empty unless two contents share 128 bits.

    The first records (one per group of two or more) carry their fields to the members; the comparison is by
    containment in both directions, so fields are not sorted.
    """
    firsts = groups.where("n_copies > 1").select("fp_1", "fp_2", F.col("group_key").alias("key"), "n_copies")
    first_fields = prints.join(firsts, ["fp_1", "fp_2", "key"]).groupBy("fp_1", "fp_2").agg(F.max("n_copies").alias("n_copies"), F.any_value("fields").alias("first"))
    same = (F.size("fields") == F.size("first")) & (F.size(F.array_except("fields", "first")) == 0) & (F.size(F.array_except("first", "fields")) == 0)
    third = fingerprint(F.col("fields"), 37).alias("fp_3")
    return hot_join(prints, cut(first_fields), ["fp_1", "fp_2"], "n_copies").where(~same).select("key", "fp_1", "fp_2", third).distinct()


def collapse(df: DataFrame, key: str, text: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row per distinct content: ``group_key`` and ``n_copies``."""
    return copy_groups(df, key, text, labels).where(F.col("key") == F.col("group_key")).select("group_key", "n_copies")
