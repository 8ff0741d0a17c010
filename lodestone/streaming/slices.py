"""Streams: the same slices and counts over events that arrive late, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    stream = spark.readStream.schema(schema)
    return (stream.option("maxFilesPerTrigger", files) if files else stream).parquet(path)


def counts(events: DataFrame, step: str = "1 day", late: str = "1 hour", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(start, by, n, total): events of each time slice; on a stream, slices close ``late`` after their end."""
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_ts", step).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, n) of a stream or table of (doc, tokens)."""
    return docs.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
