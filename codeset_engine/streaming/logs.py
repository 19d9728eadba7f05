"""Streams over log records: redaction, audit events, duration windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import schemas
from ..functions.audit import SLOW_SECONDS
from ..functions.phi import redact_log_line
from ..session import checkpoint_root

# Monitoring interval.
WINDOW = "60 seconds"


def redact_stream(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stateless redaction of log records; the same expression serves batch and stream."""
    return lines.withColumn(column, redact_log_line(F.col(column)))


def read_audit_stream(spark: SparkSession, path: str) -> DataFrame:
    """Audit events appended to ``path`` as JSON lines."""
    return spark.readStream.schema(schemas.AUDIT_EVENT).json(path)


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.AUDIT_EVENT).json(path)


def append_audit_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; null fields are written so that every line is complete.

    Times keep their microseconds.
    """
    (events.select(*schemas.AUDIT_EVENT.names).write.mode("append")
     .option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))


def duration_windows(calls: DataFrame, late_by: str | None = "10 minutes",
                     threshold: float = SLOW_SECONDS, window: str = WINDOW) -> DataFrame:
    """Count, mean, maximum and slow calls per operation and window.

    ``calls``: ``timestamp, operation, duration``. On a stream the watermark bounds the state
    to the windows that can still change.
    """
    if calls.isStreaming and late_by:
        calls = calls.withWatermark("timestamp", late_by)
    slow = F.count_if(F.col("duration") > threshold)
    return (calls.groupBy(F.window("timestamp", window).alias("w"), "operation")
            .agg(F.count(F.lit(1)).alias("n_calls"), F.avg("duration").alias("avg_duration"),
                 F.max("duration").alias("max_duration"), slow.alias("n_slow"))
            .select(F.col("w.start").alias("window_start"), "operation", "n_calls",
                    "avg_duration", "max_duration", "n_slow"))


def dedupe_chunk_stream(chunks: DataFrame, late_by: str = "1 hour") -> DataFrame:
    """First arrival per text of ``chunk`` (by SHA-256) within the watermark of ``timestamp``."""
    return (chunks.withColumn("chunk_sha256", F.sha2("chunk", 256))
            .withWatermark("timestamp", late_by)
            .dropDuplicatesWithinWatermark(["chunk_sha256"]).drop("chunk_sha256"))


def to_files(stream: DataFrame, path: str, name: str, file_format: str = "parquet",
             **trigger) -> DataStreamWriter:
    """Exactly-once file sink; offsets live in the shared checkpoint folder under ``name``."""
    root = checkpoint_root(stream.sparkSession)
    return (stream.writeStream.format(file_format).outputMode("append")
            .option("checkpointLocation", f"{root}/streams/{name}")
            .trigger(**(trigger or {"availableNow": True})).queryName(name).option("path", path))
