"""Shared helpers of the training-data operators: column selection, checkpoints, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def slim(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the names given as keywords; others, clashing or not, are left behind."""
    return docs.select(*(named(source).alias(name) for name, source in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(docs: DataFrame) -> DataFrame:
    """``docs``, its rows dealt evenly over the cores if its scan has fewer tasks than there are cores.

    A small table is often one row group, and so one task for all that follows. Results don't depend on it; larger tables, which
    are scanned in many tasks, and results of a shuffle stay as they are.
    """
    plan, cores = docs._jdf.queryExecution().executedPlan(), docs.sparkSession.sparkContext.defaultParallelism
    if plan.nodeName().startswith("AdaptiveSparkPlan") or plan.execute().getNumPartitions() >= cores:
        return docs
    return docs.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemerge-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dropped(*done: DataFrame) -> None:
    """Delete the files of ``saved`` tables that nothing reads any more."""
    for df in done:
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark delete the shuffle files of jobs that are done."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def arrow_of(schema: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(schema))


def record_batch(target: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)


_slot: dict[tuple, object] = {}


def fresh_worker() -> None:
    """Give back what an earlier task, of whatever operator, has left in this worker process."""
    import ctypes
    import gc

    _slot.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that what is built for one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def kept_in_worker(key: tuple, build):
    """What ``build()`` makes, kept by the worker process for later tasks. A process keeps one such thing, of whatever operator."""
    if key not in _slot:
        fresh_worker()
        _slot[key] = build()
    return _slot[key]


#: Rows of keys (some 100 bytes each) up to which a counted table is sent to every executor; larger ones are joined by shuffle.
SENT_ROWS = 400_000


def sent_if_small(keys: DataFrame, rows: int) -> DataFrame:
    """``keys``, marked to be broadcast if its ``rows`` are few; else left to a shuffled join."""
    return F.broadcast(keys) if rows <= SENT_ROWS else keys


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned."""
    return F.crc32(text.cast("binary"))


def held_out_fold(doc_id: Column) -> Column:
    """True for the fold that models may not learn from: crc32 of the id's decimal text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(unsigned_crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))
