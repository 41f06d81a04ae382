"""What a sorted run knows about itself: footer, sparse index, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INDEX_INTERVAL


def footers(runs: DataFrame) -> DataFrame:
    """file_id, entry_count, first_key, last_key, tombstones of each run."""
    return runs.groupBy("file_id").agg(
        F.count("*").alias("entry_count"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.sum(F.col("is_deleted").cast("bigint")).alias("tombstones")
    )


#: Key ranges that a run is numbered in, and rows looked at to choose their edges.
RANGES, SAMPLE_ROWS = 64, 4096


def edges(runs: DataFrame, ranges: int = RANGES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Ascending keys that cut the rows into about equal ranges, from the rows of the smallest hashes."""
    sample = runs.select("key").orderBy(F.xxhash64("file_id", "key")).limit(sample_rows).collect()
    keys = sorted((r.key for r in sample if r.key is not None), key=str.encode)
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}, key=str.encode) if keys else []


def range_of(key: Column, cuts: list[str], first: int = 0) -> Column:
    """The number of the range that a key lies in, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(key < cuts[mid], range_of(key, cuts[:mid], first)).otherwise(range_of(key, cuts[mid + 1 :], first + mid + 1))


def sparse_index(runs: DataFrame, interval: int = INDEX_INTERVAL, ranges: int = RANGES) -> DataFrame:
    """file_id, key, off: every so-manieth entry of each run from the first on, and its byte offset.

    A record takes nine bytes (two lengths of four, one flag) besides key and value. A run of any size is numbered in ranges of
    its keys, each from the rows and bytes of the ranges before it, so that no run is sorted in one task.
    """
    size = F.lit(9) + F.octet_length("key") + F.octet_length("value")
    sized = runs.select("file_id", "key", size.cast("bigint").alias("size"), range_of(F.col("key"), edges(runs, ranges)).alias("range"))
    before = Window.partitionBy("file_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("file_id", "range").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    starts = totals.select("file_id", "range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "size")))
    ordered = Window.partitionBy("file_id", "range").orderBy("key")
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("place", F.row_number().over(ordered) - 1).withColumn("end", F.sum("size").over(upto)).join(starts, ["file_id", "range"])
    return placed.where((F.col("n_before") + F.col("place")) % interval == 0).select("file_id", "key", (F.col("size_before") + F.col("end") - F.col("size")).alias("off"))


def manifest(runs: DataFrame) -> DataFrame:
    """ordinal, path, file_id: one row for each run, oldest first."""
    ids = runs.select("file_id").distinct()
    return ids.select((F.row_number().over(Window.orderBy("file_id")) - 1).alias("ordinal"), F.format_string("data_%d", F.col("file_id")).alias("path"), "file_id")
