"""Streams of late and repeated deliveries into a table that holds the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from disputo.operators.corpus import latest


def arrivals(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def first_deliveries(stream: DataFrame, key: str, at: str, delay: str = "30 days") -> DataFrame:
    """The stream without second deliveries of a key within ``delay``; older state is dropped by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def arrivals_per_window(stream: DataFrame, at: str, by: str, window: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Rows per window of event time and group, open for rows up to ``delay`` late."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str, at: str) -> StreamingQuery:
    """Append micro-batches to ``path`` as one version per batch; a batch that is run again overwrites its own version.

    Read the table with :func:`current`.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str, at: str) -> DataFrame:
    """The latest row per key over all batches."""
    return latest(spark.read.parquet(path).drop("batch"), key, at)
