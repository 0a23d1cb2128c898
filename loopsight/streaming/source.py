"""Streams of session records: rotated chunks of JSON lines in a landing folder.

Spark's file source takes each file once, so a growing file must be handed over in finished chunks (or through
Kafka); the checkpoint then stands for the offsets read so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACTIONS = "session_id string, agent_scope string, seq long, uuid string, ts long, tool string, arg_key string, result_class string, file_path string, edit_tokens array<string>"


def action_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Actions from JSON chunks, deduplicated by uuid within the watermark, with event_time beside ts."""
    reader = spark.readStream.schema(ACTIONS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return deduplicated(reader.json(folder).withColumn("event_time", F.timestamp_millis("ts")))


def deduplicated(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Records replayed by an at-least-once source are dropped by uuid."""
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["uuid"])
