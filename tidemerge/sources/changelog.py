"""Change logs derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_events(events: DataFrame, per_file: int = 1000, *also: str) -> DataFrame:
    """seq, key, value, is_deleted, file_id, timestamp: an event is a put to its user's key, an error a delete. A null props is an empty one; ``also`` names further columns to keep."""
    deleted = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"),
        F.when(deleted, F.lit("")).otherwise(F.concat("event_type", F.lit(":"), F.coalesce("props", F.lit("")))).alias("value"), deleted.alias("is_deleted"),
        F.floor(F.col("event_id") / per_file).cast("bigint").alias("file_id"), (F.col("event_id") * 1000).alias("timestamp"), *also,
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """seq, key, value, is_deleted: a turn is a put to its conversation's key."""
    return conversations.select(F.col("turn").alias("seq"), F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("key"), F.concat("role", F.lit(":"), F.coalesce("text", F.lit(""))).alias("value"), F.lit(False).alias("is_deleted"))
