"""The write buffer as a streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import latest


def streaming_state(changes: DataFrame) -> DataFrame:
    """The newest row of each key of a streaming log. Tombstones stay in the state: without them an older run would show again.

    ``seq`` decides, not the time of arrival, so late and reordered input gives the same state; there is no watermark.
    """
    return latest(changes, "seq")


def _write_run(rows: DataFrame, batch_id: int, path: str) -> None:
    """A sorted run under the number of its micro-batch; a repeated batch overwrites its own."""
    run = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("file_id", F.lit(batch_id))
    run.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)


def to_runs(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of a streaming log as one sorted run under ``path``."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        _write_run(latest(batch, "seq").select("key", "value", "is_deleted"), batch_id, path)

    return changes.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_to_runs(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The streaming state as runs of key, value, is_deleted, seq under ``path``: each micro-batch writes only the keys it changed.

    A key's row in its newest run is its state, so that nothing is written twice.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        _write_run(batch.select("key", "value", "is_deleted", "seq"), batch_id, path)

    return streaming_state(changes).writeStream.outputMode("update").foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
