"""Point and batch lookups with three outcomes, ordered scans, lower bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ABSENT, DELETED, FOUND
from .merge import latest, normalised


def status_of(key: Column, is_deleted: Column) -> Column:
    return F.when(key.isNull(), ABSENT).when(is_deleted, DELETED).otherwise(FOUND)


def get(runs: DataFrame, key: str, order: str = "file_id") -> DataFrame:
    """One row for ``key``: key, status, value (empty unless found). The key's filter reaches the scan below the merge."""
    wanted = runs.sparkSession.range(1).select(F.lit(key).alias("key"))
    return get_many(runs.where(F.col("key") == key), wanted, order)


def get_many(runs: DataFrame, wanted: DataFrame, order: str = "file_id") -> DataFrame:
    """A row for each row of ``wanted`` (key): key, status, value. Runs are merged only for the keys asked for."""
    asked = wanted.select("key").distinct()
    state = latest(runs.join(asked, "key", "left_semi"), order)
    found = state.select(F.col("key").alias("known"), "value", "is_deleted")
    joined = wanted.select("key").join(found, F.col("key") == F.col("known"), "left")
    status = status_of(F.col("known"), F.col("is_deleted"))
    return joined.select("key", status.alias("status"), F.when(status == FOUND, F.col("value")).otherwise("").alias("value"))


def scan(runs: DataFrame, low: str | None = None, high: str | None = None, *, tombstones: bool = True, order: str = "file_id") -> DataFrame:
    """Rows of the merged state with low <= key < high in byte order of keys: key, value, is_deleted."""
    if low is not None:
        runs = runs.where(F.col("key") >= low)
    if high is not None:
        runs = runs.where(F.col("key") < high)
    state = normalised(latest(runs, order)).select("key", "value", "is_deleted")
    return (state if tombstones else state.where(~F.col("is_deleted"))).orderBy("key")


def seek(runs: DataFrame, target: str, rows: int = 1, order: str = "file_id", *, versions: int | None = None) -> DataFrame:
    """The first ``rows`` keys from ``target`` on, tombstones among them.

    versions: how many rows a key can have, which is the number of runs. The first ``rows * versions`` rows then hold enough keys,
    so only rows up to the last of these are merged; each task keeps no more than that. Without it all rows from ``target`` on are.
    """
    if versions is not None:
        tail = runs.where(F.col("key") >= target)
        last = tail.select("key").orderBy("key").limit(rows * max(1, versions)).agg(F.max("key"))
        runs = tail.where(F.col("key") <= last.scalar())
    return scan(runs, low=target, order=order).limit(rows)


def answered_by(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The run that answers each key, and how many runs would be probed newest first until then: key, file_id, probes.

    Keys in no run have file_id null and as many probes as there are runs.
    """
    asked = wanted.select("key").distinct()
    hit = runs.join(asked, "key", "left_semi").groupBy("key").agg(F.max("file_id").alias("file_id"))
    ids = runs.select("file_id").distinct()  # a row for each run: the manifest's size
    place = ids.select("file_id", F.row_number().over(Window.orderBy(F.desc("file_id"))).alias("n"))
    missed = ids.agg(F.count("*").cast("int").alias("n")).select(F.lit(None).cast("bigint").alias("file_id"), "n")
    probes = place.unionByName(missed).select(F.col("file_id").alias("run"), "n")
    joined = asked.join(hit, "key", "left").join(F.broadcast(probes), F.col("file_id").eqNullSafe(F.col("run")))
    return joined.select("key", "file_id", F.col("n").alias("probes"))


#: Sequence numbers that ``asof_get`` takes as one block.
BLOCK = 1 << 16


def asof_get(script: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lookups in an ordered script: each GET sees the last PUT or DELETE of its key before it.

    script: seq, verb (PUT, DELETE or GET), key, value. Gives seq, key, status, value for the GET rows. A key's rows are taken in
    blocks of sequence numbers, each headed by what the blocks before it left, so that a key with a third of all rows is
    spread over many tasks.
    """
    write = F.col("verb") != "GET"
    entry = F.when(write, F.struct(F.col("value"), (F.col("verb") == "DELETE").alias("is_deleted")))
    commands = script.select("seq", "key", F.expr(f"seq div {block}").alias("block"), (~write).alias("asked"), entry.alias("entry"))
    left = commands.groupBy("key", "block").agg(F.max_by("entry", F.when(~F.col("asked"), F.col("seq"))).alias("entry"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = left.select(F.lit(None).cast(script.schema["seq"].dataType).alias("seq"), "key", "block", F.lit(False).alias("asked"), F.last("entry", ignorenulls=True).over(earlier).alias("entry"))
    before = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # heads, without seq, come first
    last = F.last("entry", ignorenulls=True).over(before)
    seen = commands.unionByName(heads.where("entry IS NOT NULL")).withColumn("last", last).where("asked")
    status = F.when(F.col("last").isNull(), ABSENT).when(F.col("last.is_deleted"), DELETED).otherwise(FOUND)
    return seen.select("seq", "key", status.alias("status"), F.when(status == FOUND, F.col("last.value")).otherwise("").alias("value"))
