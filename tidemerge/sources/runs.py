"""Sorted immutable runs as Parquet, with a Bloom filter on the key, and the manifest that lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import latest, normalised


def cut(log: DataFrame) -> DataFrame:
    """file_id, key, value, is_deleted: the newest row of each key within each generation of a log."""
    return normalised(latest(log, "seq", by=("file_id", "key"))).select("file_id", "key", "value", "is_deleted")


def write(runs: DataFrame, path: str, keys_per_run: int = 1000, files_per_run: int = 1) -> None:
    """Append runs, one folder each, sorted by key. The Bloom filters are sized by the keys that a run holds, not by a default.

    A large run can be cut into several files by key range, each sorted, so that no run goes through one task.
    """
    if files_per_run > 1:
        dealt = runs.repartitionByRange(files_per_run, "file_id", "key")
    else:
        dealt = runs.repartition("file_id")
    sorted_runs = dealt.sortWithinPartitions("file_id", "key")
    options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(1, keys_per_run))}
    sorted_runs.write.mode("append").options(**options).partitionBy("file_id").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All runs under ``path``; filters on key and file_id reach the files."""
    return spark.read.parquet(path).select(F.col("file_id").cast("bigint"), "key", "value", "is_deleted")
