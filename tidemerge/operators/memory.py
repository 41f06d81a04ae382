"""Memory estimates of the write buffer, and flushes at a threshold."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENTRY_OVERHEAD, WRITE_BUFFER_BYTES
from .merge import latest


def entry_bytes(key: Column, value: Column) -> Column:
    return F.lit(ENTRY_OVERHEAD) + F.octet_length(key) + F.octet_length(value)


def buffer_usage(log: DataFrame, *by: str) -> DataFrame:
    """Estimated bytes of the write buffer after a log (for each ``by``): a sum over the current entries, for overwrites and deletes telescope."""
    state = latest(log, "seq", by=(*by, "key"))
    return state.groupBy(*by).agg(F.sum(entry_bytes(F.col("key"), F.when(F.col("is_deleted"), F.lit("")).otherwise(F.col("value")))).cast("bigint").alias("bytes"), F.count("*").alias("entries"))


def threshold_flush(log: DataFrame, *, shard: str = "shard", buffer_bytes: int = WRITE_BUFFER_BYTES) -> DataFrame:
    """Runs cut where the write buffer reaches ``buffer_bytes``: shard, generation, flush_seq, key, value, is_deleted.

    Where a run ends depends on all writes before it, so each shard is folded in order, as a stream that holds one write buffer.
    What is left at the end has flush_seq null: it isn't flushed. log: shard, seq, key, value, is_deleted.
    """
    schema = "shard bigint, generation int, flush_seq bigint, key string, value string, is_deleted boolean"
    names = ["shard", "generation", "flush_seq", "key", "value", "is_deleted"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, generation, size, table = None, 0, 0, {}

        def flushed(seq: int | None) -> pa.RecordBatch:
            rows = [(own, generation, seq, key, *table[key]) for key in sorted(table)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for now, seq, key, value, deleted in zip(*(batch.column(c).to_pylist() for c in ("shard", "seq", "key", "value", "is_deleted")), strict=True):
                if now != own:
                    if table:
                        yield flushed(None)
                    own, generation, size, table = now, 0, 0, {}
                value = "" if deleted else value
                before = table.get(key)
                size += len(value.encode()) - len(before[0].encode()) if before else ENTRY_OVERHEAD + len(key.encode()) + len(value.encode())
                table[key] = (value, deleted)
                if size >= buffer_bytes:
                    yield flushed(seq)
                    generation, size, table = generation + 1, 0, {}
        if table:
            yield flushed(None)

    ordered = log.select(F.col(shard).cast("bigint").alias("shard"), "seq", "key", "value", "is_deleted").repartition("shard").sortWithinPartitions("shard", "seq")
    return ordered.mapInArrow(fold, schema)
