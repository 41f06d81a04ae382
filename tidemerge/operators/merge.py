"""The one merge: the newest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, order: str, *also: str, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The row of the largest ``order`` for each key: key, value, is_deleted, ``order`` and further columns named.

    An aggregate, so rows are merged before they are shuffled, and a key with a third of all rows is no hot key. Orders must be
    unique for each key; of equal ones any row may win.
    """
    payload = [c for c in ("value", "is_deleted", *also) if c not in by]
    merged = rows.groupBy(*by).agg(F.max_by(F.struct(*payload), F.col(order)).alias("entry"), F.max(order).alias(order))
    return merged.select(*by, *(f"entry.{c}" for c in payload), order)


def ties(rows: DataFrame, order: str, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Keys and orders that occur more than once; ``latest`` needs none."""
    return rows.groupBy(*by, order).count().where("count > 1")


def without_tombstones(state: DataFrame) -> DataFrame:
    """Live rows. Only ever above a merge: before it, an older value would come back."""
    return state.where(~F.col("is_deleted"))


def normalised(state: DataFrame) -> DataFrame:
    """Tombstones with an empty value."""
    return state.withColumn("value", F.when(F.col("is_deleted"), F.lit("")).otherwise(F.col("value")))


def compact(runs: DataFrame, *, purge_tombstones: bool = True, inputs: Column | None = None, all_inputs: bool | None = None) -> DataFrame:
    """One sorted run from some: for each key the row of the largest ``file_id``; key, value, is_deleted.

    inputs: which runs to take, a condition on ``file_id``; all by default. Purging drops keys whose newest row is a tombstone.
    It is refused for a part of the runs unless ``all_inputs`` says that no older run is left out: an older value left outside
    would come back.
    """
    if purge_tombstones and inputs is not None and not all_inputs:
        raise ValueError("tombstones can't be purged from a part of the runs: older values left out would come back")
    merged = normalised(latest(runs if inputs is None else runs.where(inputs), "file_id"))
    if purge_tombstones:
        merged = without_tombstones(merged)
    return merged.select("key", "value", "is_deleted")


def count_keys(log: DataFrame, *by: str) -> DataFrame:
    """Distinct keys, tombstones among them."""
    return log.groupBy(*by).agg(F.countDistinct("key").alias("n_keys"))


def versions(runs: DataFrame) -> DataFrame:
    """How many runs hold a key, and the oldest and newest of them."""
    return runs.groupBy("key").agg(F.count("*").alias("n_versions"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


def superseded(runs: DataFrame) -> DataFrame:
    """Rows that a newer run hides: what a compaction drains."""
    newest = runs.groupBy("key").agg(F.max("file_id").alias("newest"))
    return runs.join(newest, "key").where(F.col("file_id") < F.col("newest")).select("file_id", "key", "value", "is_deleted", "newest")
