"""Session-level helpers shared by every operator."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest number of rows and of bytes a side may have before a broadcast hint is withheld.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` where the session names one.

    A folder of our own is set only where the session has none and everything runs in one process (tests, a laptop);
    on a cluster executors could not see it, so that raises ValueError.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


_SETTINGS = {"lock": threading.Lock(), "held": {}}


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Give a setting of the session another value meanwhile; the last thread that leaves puts the session's own back."""
    with _SETTINGS["lock"]:
        users, former = _SETTINGS["held"].get(name, (0, None))
        if not users:
            former = spark.conf.get(name)
            spark.conf.set(name, value)
        _SETTINGS["held"][name] = users + 1, former
    try:
        yield
    finally:
        with _SETTINGS["lock"]:
            users, former = _SETTINGS["held"][name]
            _SETTINGS["held"][name] = users - 1, former
            if users == 1:
                spark.conf.set(name, former)


def short_plans(spark: SparkSession):
    """Keep the texts of plans short meanwhile: the driver retains one per execution, and iterations have many."""
    return _setting(spark, "spark.sql.maxPlanStringLength", "4096")


def freed_shuffles(spark: SparkSession):
    """Delete the shuffle files of what is run meanwhile as soon as it has run, not when the driver happens to collect its garbage.

    For operators that go on from tables they have written, so that their steps do not add up on disk.
    """
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    Used between iterations and where a result is read more than once: a lost executor then costs
    only the tasks it ran, and the lineage does not grow with the number of iterations.
    """
    checkpoint_dir(df.sparkSession)
    with short_plans(df.sparkSession):
        return df.checkpoint(eager=True)


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as a compressed table in the checkpoint folder; (the table, its path for :func:`remove`).

    For wide intermediate results that are read several times: smaller than a checkpoint, and columns can be pruned.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with short_plans(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`store`, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _width(field: T.StructField) -> Column:
    """Bytes of one value of a column, about."""
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) * 16 + 16
    return F.lit(64 if isinstance(field.dataType, T.StructType) else 8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES, stored: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and about ``size`` bytes, else without one.

    ``df`` runs once: it is written to the checkpoint folder and measured there (``stored``: it is a checkpoint or a plain table already),
    so that a side that has grown falls back to a shuffled join instead of filling the executors.
    """
    kept = df if stored else cut(df)
    width = sum((_width(f).cast("long") for f in kept.schema), F.lit(0).cast("long"))
    n, total = kept.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(kept) if n <= rows and (total or 0) <= size else kept


def hot_join(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, parts: int = 400) -> DataFrame:
    """``rows`` joined to ``side``, which has one row per key, is stored, and has the key's number of rows in ``weight``.

    Keys with more than 1/``parts`` of all rows, and so fewer than ``parts``, are broadcast; all others are joined by shuffle, in which the rows
    of those hot keys are spread over all tasks.  ``rows`` is computed once.  Only columns of ``side`` that ``rows`` lacks are added.
    """
    values = [c for c in side.columns if c not in rows.columns]
    total = side.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    bar = total / parts + 1000
    hot = side.where(F.col(weight) > bar).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in values])
    marked = rows.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn("_spread", F.when(F.col("_hot"), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(*keys)))
    rest = side.where(F.col(weight) <= bar).select(F.xxhash64(*keys).alias("_spread"), *keys, *values, F.lit(True).alias("_met"))
    joined = marked.join(rest, ["_spread", *keys], "left").where("_hot OR _met")
    return joined.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def blank(column: Column | str) -> Column:
    """NULL where a string is NULL, empty or only white space; else the trimmed string."""
    column = F.col(column) if isinstance(column, str) else column
    trimmed = F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")
    return F.when(trimmed != "", trimmed)
