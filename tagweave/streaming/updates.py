"""Structured Streaming around the batch jobs: an addition, not something that searches need."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import USAGE_LOG


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Usage log files (seq, tag) as a stream."""
    return spark.readStream.schema(USAGE_LOG).parquet(folder)


def running_scores(log: DataFrame) -> DataFrame:
    """(tag, score) kept up to date; state is one count for each tag."""
    return log.groupBy("tag").agg(F.count("*").alias("score"))


def windowed_usage(log: DataFrame, ts: str = "ts", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, tag, score) per window of event time; windows close when the watermark has passed them."""
    return log.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), "tag").agg(F.count("*").alias("score")).select(F.col("w.start").alias("start"), "tag", "score")


def on_change(spark: SparkSession, folder: str, schema: str, job: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch job for each set of new files, once for all that is there."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
