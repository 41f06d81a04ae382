"""A store in a folder: a log of unflushed changes, sorted runs and their manifest; reads merge them."""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup, memory
from ..operators.merge import compact, latest, normalised, ties
from ..schema import CHANGE, MANIFEST, RUN, WRITE_BUFFER_BYTES
from ..sources import wal
from ..sources.shared import Files


class Entry(NamedTuple):
    """A run: its folder, and the number by which it is newer or older than others."""

    path: str
    file_id: int


class Store:
    """Batches of changes go to the log; ``flush`` turns the log into a run; ``get`` reads log and runs, the newest first.

    Opening recovers: the manifest's runs, and the log up to its first damaged line. Replaying changes that a run already holds
    changes nothing. A folder listed in the manifest but missing is an error unless ``ignore_missing``.

    Each manifest is a file of its own, MANIFEST-n, written beside and renamed once whole, so that a store always has the old list
    of runs or the new one. Folders of runs that no manifest lists (of a write that broke off) are left alone, and their
    numbers are never given out again. A batch is logged in as many files as its sort has parts, and they too are written beside and
    renamed at once.

    The write buffer is looked at once a batch: a batch of any size becomes one run at most (``memory.threshold_flush`` cuts a
    log as a store would that looks after each change). With ``logged`` false nothing is logged, and what isn't flushed is
    lost with the object.
    """

    def __init__(self, spark: SparkSession, folder: str, *, write_buffer_bytes: int = WRITE_BUFFER_BYTES, ignore_missing: bool = False, logged: bool = True):
        self.spark, self.folder, self.write_buffer_bytes, self.logged = spark, folder.rstrip("/"), write_buffer_bytes, logged
        self.files, self.frozen = Files(spark), False
        names = self.files.names(self.folder)
        self.version, listed = self._manifest(names)
        missing = [e.path for e in listed if e.path not in names]
        if missing and not ignore_missing:
            raise FileNotFoundError(f"runs in the manifest are missing: {missing}")
        self.entries = [e for e in listed if e.path not in missing]
        taken = [int(m[1]) for m in map(re.compile(r"data_(\d+)").fullmatch, names) if m]
        self.next_id = 1 + max([-1, *taken, *(e.file_id for e in listed)])
        if taken and self.version < 0 and "wal" not in names:
            raise FileNotFoundError(f"{self.folder} has runs but neither a manifest nor a log")
        self.memtable, last = self._replayed() if logged and self.files.names(f"{self.folder}/wal") else (spark.createDataFrame([], CHANGE), -1)
        self.next_seq = 1 + last

    def _manifest(self, names: list[str]) -> tuple[int, list[Entry]]:
        """Number and runs, oldest first, of the newest manifest; one that isn't whole is an error."""
        numbers = [int(m[1]) for m in map(re.compile(r"MANIFEST-(\d+)").fullmatch, names) if m]
        if not numbers:
            return -1, []
        try:
            rows = json.loads(self.files.read(f"{self.folder}/MANIFEST-{max(numbers)}"))
            return max(numbers), [Entry(r["path"], r["file_id"]) for r in rows]
        except (ValueError, KeyError, TypeError) as e:
            raise ValueError(f"{self.folder}/MANIFEST-{max(numbers)} is damaged") from e

    def _commit(self, entries: list[Entry]) -> None:
        """The new list of runs takes the old one's place in one rename."""
        text = json.dumps([{"ordinal": k, **e._asdict()} for k, e in enumerate(entries)])
        self.files.publish(f"{self.folder}/MANIFEST-{self.version + 1}", text)
        self.version, self.entries = self.version + 1, list(entries)
        self.files.delete(f"{self.folder}/MANIFEST-{self.version - 1}")

    def _replayed(self, batch: int | None = None) -> tuple[DataFrame, int]:
        """Changes of the logs in order of their first sequence number (or of one of them), each cut at its own first damaged line,
        and the last number that a line has, damaged or not (-1: there is no line).

        Where logs are damaged is looked up at once: the changes are then read in splits, and no log has to go through one task.
        """
        path = f"{self.folder}/wal/{'*' if batch is None else batch}/part-*"
        records = wal.parsed(wal.read_batches(self.spark, path), "first")
        ends = records.groupBy("first").agg(F.min(F.when(F.col("bad"), F.col("pos"))).alias("torn"), F.max("pos").alias("last"))
        damaged = F.collect_list(F.when(F.col("torn").isNotNull(), F.struct("first", "torn")))
        row = ends.agg(F.max(F.col("first") + F.col("last")).alias("last"), damaged.alias("damaged")).first()
        if row.damaged:
            torn = self.spark.createDataFrame(row.damaged, "first bigint, torn bigint")
            records = records.join(F.broadcast(torn), "first", "left").where(F.col("torn").isNull() | (F.col("pos") < F.col("torn")))
        changes = wal.changes_of(records, "first")
        return changes.select((F.col("first") + F.col("seq")).alias("seq"), "key", "value", "is_deleted"), -1 if row.last is None else row.last

    def write(self, changes: DataFrame) -> None:
        """Append a batch (seq in the batch, key, value, is_deleted) to the log, then flush if the write buffer is full."""
        if self.frozen:
            raise RuntimeError("the write buffer is frozen")
        first = self.next_seq
        if self.logged:
            beside = f"{self.folder}/log-{uuid.uuid4().hex}.part"
            wal.write(changes.withColumn("timestamp", F.unix_micros(F.current_timestamp()) * 1000), beside, one_file=False)
            self.files.move(beside, f"{self.folder}/wal/{first}")
            batch, last = self._replayed(first)
        else:
            batch = wal.changes_of(wal.decode(wal.encode(changes.withColumn("timestamp", F.lit(0))).select(F.col("seq").alias("pos"), "line"))).withColumn("seq", F.col("seq") + first)
            last = batch.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        self.memtable = self.memtable.unionByName(batch)
        self.next_seq = max(first, 1 + last)
        if self.memory_usage() >= self.write_buffer_bytes:
            self.flush()

    def put(self, key: str, value: str) -> None:
        self.write(self.spark.createDataFrame([(0, key, value, False)], CHANGE))

    def delete(self, key: str) -> None:
        """A tombstone, whether or not the key is known."""
        self.write(self.spark.createDataFrame([(0, key, "", True)], CHANGE))

    def freeze(self) -> None:
        """From now on writes fail and reads work, until the buffer is flushed or cleared."""
        self.frozen = True

    def clear(self) -> None:
        """An empty write buffer that takes writes; the log stays as it is."""
        self.memtable, self.frozen = self.spark.createDataFrame([], CHANGE), False

    def is_empty(self) -> bool:
        """Whether the write buffer holds nothing, not even a tombstone."""
        return self.memtable.isEmpty()

    def memory_usage(self) -> int:
        row = memory.buffer_usage(self.memtable).first()
        return row.bytes or 0

    def runs(self, entries: list[Entry] | None = None) -> DataFrame:
        entries = self.entries if entries is None else entries
        if not entries:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.parquet(*(f"{self.folder}/{e.path}" for e in entries)).select("file_id", "key", "value", "is_deleted")

    def versions(self) -> DataFrame:
        """All runs and, as the newest, the write buffer."""
        buffer = latest(self.memtable, "seq").select(F.lit(self.next_id).cast("bigint").alias("file_id"), "key", "value", "is_deleted")
        return self.runs().unionByName(buffer)

    def get(self, key: str) -> tuple[str, str]:
        """(status, value)."""
        row = lookup.get(self.versions(), key).first()
        return row.status, row.value

    def get_many(self, wanted: DataFrame) -> DataFrame:
        return lookup.get_many(self.versions(), wanted)

    def scan(self, low: str | None = None, high: str | None = None) -> DataFrame:
        return lookup.scan(self.versions(), low, high)

    def seek(self, target: str, rows: int = 1) -> DataFrame:
        """The first keys from ``target`` on; a key has a row a run at most, and one in the write buffer."""
        return lookup.seek(self.versions(), target, rows, versions=len(self.entries) + 1)

    def flush(self) -> None:
        """The write buffer as a new run: file first, then manifest, then the log goes. Tombstones are kept. Nothing to do if empty."""
        state = normalised(latest(self.memtable, "seq"))
        keys = state.count()
        if not keys:
            return
        self._commit([*self.entries, self._written(state, self.next_id, keys)])
        self.files.delete(f"{self.folder}/wal")
        self.clear()

    def _written(self, state: DataFrame, file_id: int, keys: int) -> Entry:
        """A run in a folder of its own, not yet listed. Its Bloom filters are sized by its keys."""
        entry = Entry(f"data_{self.next_id}", file_id)
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(1, min(keys, 5_000_000)))}
        rows = state.select(F.lit(file_id).cast("bigint").alias("file_id"), "key", "value", "is_deleted")
        files = -(-keys // 5_000_000)
        self.next_id += 1
        rows.repartitionByRange(max(1, files), "key").sortWithinPartitions("key").write.mode("error").options(**options).parquet(f"{self.folder}/{entry.path}")
        return entry

    def compact(self, purge_tombstones: bool = True, file_ids: list[int] | None = None) -> None:
        """Some runs, neighbours in age (by default all), into one that stands where they stood.

        Tombstones can only be purged if the oldest run is among them: else older values would come back. A (key, file_id) that
        occurs twice is an error. Without runs nothing is done; runs of tombstones alone leave none when purged.
        """
        chosen = [e for e in self.entries if file_ids is None or e.file_id in file_ids]
        if not chosen:
            return
        at = self.entries.index(chosen[0])
        if chosen != self.entries[at : at + len(chosen)]:
            raise ValueError("runs to be compacted must be neighbours: one between them would lose its place")
        if purge_tombstones and at:
            raise ValueError("tombstones can't be purged from newer runs alone: older values would come back")
        rows = self.runs(chosen)
        if not ties(rows, "file_id").isEmpty():
            raise ValueError("a run holds a key twice")
        merged = compact(rows, purge_tombstones=purge_tombstones)
        keys = merged.count()
        new = [self._written(merged, chosen[-1].file_id, keys)] if keys else []
        self._commit([*self.entries[:at], *new, *self.entries[at + len(chosen) :]])
        for entry in chosen:
            self.files.delete(f"{self.folder}/{entry.path}")

    def run_count(self) -> int:
        return len(self.entries)

    def run_list(self, newest_first: bool = True) -> DataFrame:
        """ordinal, path, file_id of the runs."""
        rows = [(k, *e) for k, e in enumerate(self.entries)]
        return self.spark.createDataFrame(rows[::-1] if newest_first else rows, MANIFEST)
