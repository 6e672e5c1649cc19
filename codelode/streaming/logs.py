"""Streaming extension: build logs that arrive as files. The batch engine has no streams of its own; these reuse its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.sources import build_log


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(stream, line_no, raw) of text files as they land; the stream is the file's stem."""
    lines = spark.readStream.format("text").load(folder)
    stem = F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1)
    return lines.select(stem.alias("stream"), F.lit(0).alias("line_no"), F.col("value").alias("raw"), F.col("_metadata.file_modification_time").alias("at"))


def finding_counts(lines: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(window, class, n) of log findings by arrival; rows later than the watermark don't count."""
    kind = lines.withColumn("class", build_log.classify(F.col("raw"))).where("class is not null")
    return kind.withWatermark("at", late).groupBy(F.window("at", every), "class").agg(F.count("*").alias("n"))


def new_fingerprints(findings: DataFrame, late: str = "1 day") -> DataFrame:
    """Findings (fingerprint, at, ...) the first time they are seen within the watermark."""
    return findings.withWatermark("at", late).dropDuplicatesWithinWatermark(["fingerprint"])


def append_history(history: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends history entries as Parquet, exactly once, and stops when all that is there has been read."""
    return history.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start(target)
