"""The registered queries over the driver's tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bloom, lookup, memory, run_metadata
from ..operators.merge import compact, count_keys, latest, superseded, versions, without_tombstones
from ..sources import changelog, runs, wal
from ..sources.shared import Files, scratch
from ..streaming.memtable import state_to_runs
from . import script
from .engine import Store

Query = Callable[[SparkSession, str], DataFrame]
BITS, HASHES = bloom.parameters()
#: Keys of a run: a generation's at most. Filters of all runs are sized by a count.
PER_RUN = 1000
SHARDS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(events(spark, sf_dir))


def runs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cut(log_of(spark, sf_dir))


def wanted(spark: SparkSession) -> DataFrame:
    """Keys found, deleted and absent, and edge cases."""
    return spark.createDataFrame([(k,) for k in ("user_1", "user_2", "user_10", "user_77", "user_149", "nobody", "", "user_")], "key string")


def put_delete_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(spark, sf_dir).drop("timestamp")


def flush_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(spark, sf_dir)


def compact_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(runs_of(spark, sf_dir)).select("key", "value")


def compact_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(runs_of(spark, sf_dir), purge_tombstones=False)


def compact_partial_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest runs, of which none older is left out."""
    return compact(runs_of(spark, sf_dir), inputs=F.col("file_id") < 5, all_inputs=True)


def count_incl_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_keys(log_of(spark, sf_dir), "file_id")


def versions_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(runs_of(spark, sf_dir))


def superseded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superseded(runs_of(spark, sf_dir))


def manifest_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata.manifest(runs_of(spark, sf_dir))


def run_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata.footers(runs_of(spark, sf_dir))


def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata.sparse_index(runs_of(spark, sf_dir))


def memtable_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.buffer_usage(log_of(spark, sf_dir), "file_id")


def memtable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The write buffer of the last generation in key order, tombstones among them."""
    return lookup.scan(last_generation(log_of(spark, sf_dir)), order="seq")


def get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get_many(runs_of(spark, sf_dir), wanted(spark))


def get_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.get(runs_of(spark, sf_dir), "user_10")


def answered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.answered_by(runs_of(spark, sf_dir), wanted(spark))


def seek_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = runs_of(spark, sf_dir)
    return lookup.seek(cut, "user_12x", 20, versions=cut.select("file_id").distinct().count())


def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.scan(runs_of(spark, sf_dir), "user_1", "user_3", tombstones=False).select("key", "value")


def tombstone_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose newest row is a tombstone while older runs hold values, and how many."""
    newest = F.max_by("is_deleted", "file_id").alias("dead"), F.max("file_id").alias("deleted_in")
    merged = runs_of(spark, sf_dir).groupBy("key").agg(*newest, F.count_if(~F.col("is_deleted")).alias("masked"))
    return merged.where("dead and masked > 0").select("key", "deleted_in", "masked")


def wal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.encode(log_of(spark, sf_dir))


def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again, one log for each generation."""
    log = log_of(spark, sf_dir)
    lines = wal.encode(log).select(F.floor(F.col("seq") / 1000).cast("bigint").alias("file_id"), F.col("seq").alias("pos"), "line")
    return wal.changes_of(wal.decode(lines, "file_id"), "file_id")


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a thousand events each, of which one line is broken off wherever an event is of a user divisible by 50."""
    log = log_of(spark, sf_dir)
    broken = F.substring_index(F.col("key"), "_", -1).cast("bigint") % 50 == 0
    lines = wal.encode(log.withColumn("kept", ~broken), "timestamp").join(log.select("seq", "file_id", broken.alias("broken")), "seq")
    cut = F.when(F.col("broken"), F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    return wal.changes_of(wal.decode(lines.select("file_id", F.col("seq").alias("pos"), cut.alias("line")), "file_id"), "file_id")


def last_generation(log: DataFrame) -> DataFrame:
    last = log.agg(F.max("file_id").alias("last"))  # one row
    return log.join(F.broadcast(last), F.col("file_id") == F.col("last")).drop("last")


def wal_file_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last generation written as a log file, with a torn line after it and one more, and read back."""
    folder, files = scratch(spark, "log"), Files(spark)
    wal.write(last_generation(log_of(spark, sf_dir)), folder)
    part = next(name for name in files.names(folder) if name.startswith("part-"))
    text = files.read(f"{folder}/{part}")
    files.publish(f"{folder}/log", text + '{"operation":"PUT","key":"torn","value":"inc' + "\n" + text.split("\n", 1)[0] + "\n")
    return wal.recover(spark, f"{folder}/log")


def run_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs written as sorted files, and of these the keys of a range read back."""
    folder = scratch(spark, "runs")
    runs.write(runs_of(spark, sf_dir), folder, keys_per_run=PER_RUN)
    return runs.read(spark, folder).where((F.col("key") >= "user_1") & (F.col("key") < "user_3"))


def three_runs(spark: SparkSession, sf_dir: str) -> Store:
    """A store of three flushed runs, events dealt in turn."""
    db = Store(spark, scratch(spark, "store"), write_buffer_bytes=1 << 62)
    log = log_of(spark, sf_dir)
    for third in range(3):
        db.write(log.where(F.col("seq") % 3 == third).select("seq", "key", "value", "is_deleted"))
        db.flush()
    return db


def manifest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store opened again reads from its manifest, newest run first."""
    return Store(spark, three_runs(spark, sf_dir).folder).run_list()


def store_reopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flushed runs and a log, opened again: the state of all."""
    db = Store(spark, scratch(spark, "store"), write_buffer_bytes=1 << 62)
    log = log_of(spark, sf_dir)
    for part in (F.col("file_id") < 3, F.col("file_id").between(3, 5), F.col("file_id") > 5):
        if db.next_seq:
            db.flush()
        db.write(log.where(part).select("seq", "key", "value", "is_deleted"))
    return Store(spark, db.folder, write_buffer_bytes=1 << 62).scan()


def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two newer runs compacted with their tombstones, then all without, and opened again."""
    db = three_runs(spark, sf_dir)
    db.compact(purge_tombstones=False, file_ids=[1, 2])
    db.compact()
    return Store(spark, db.folder).scan().select("key", "value")


def bloom_stored_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups in those runs only whose stored filter lets a key through: key, runs that may hold it, runs that do."""
    cut, folder = runs_of(spark, sf_dir), scratch(spark, "filters")
    bits, hashes = bloom.parameters(PER_RUN)
    bloom.packed(bloom.build(cut, bits, hashes, "file_id"), "file_id").write.parquet(folder)
    maybe = bloom.probe_stored(wanted(spark), spark.read.parquet(folder), bits, hashes, "file_id").where("may_contain")
    held = cut.select("file_id", "key", F.lit(1).alias("held"))
    return maybe.join(held, ["file_id", "key"], "left").groupBy("key").agg(F.count("*").alias("passed"), F.count("held").alias("held"))


def recovered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening a store: runs of all generations but the last, and the last one's log read back from its lines."""
    log = log_of(spark, sf_dir)
    last = log.agg(F.max("file_id").alias("last"))
    split = log.join(F.broadcast(last))
    lines = wal.encode(split.where("file_id = last")).select(F.col("seq").alias("pos"), "line")
    tail = latest(wal.changes_of(wal.decode(lines)), "seq").select(F.lit(1 << 40).alias("file_id"), "key", "value", "is_deleted")
    flushed = runs.cut(split.where("file_id < last"))
    return latest(flushed.unionByName(tail), "file_id").select("key", "value", "is_deleted")


def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.build(runs_of(spark, sf_dir), BITS, HASHES, "file_id")


def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of 10,000 never added that a filter of 1,000 can't rule out."""
    added = spark.range(1000).select(F.concat(F.lit("inserted_key_"), F.col("id").cast("string")).alias("key"))
    probes = spark.range(10000).select(F.concat(F.lit("uninserted_key_"), F.col("id").cast("string")).alias("key"))
    return bloom.probe(probes, bloom.build(added, BITS, HASHES), BITS, HASHES).where("may_contain").select("key")


def bloom_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.unpacked(bloom.packed(bloom.build(runs_of(spark, sf_dir), BITS, HASHES, "file_id"), "file_id"), "file_id")


def bloom_pruned_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that pass the filter of all keys, sized by their number, first."""
    cut, asked = runs_of(spark, sf_dir), wanted(spark)
    bits, hashes = bloom.parameters(cut.agg(F.approx_count_distinct("key")).first()[0])
    maybe = bloom.probe(asked, bloom.build(cut, bits, hashes), bits, hashes).where("may_contain").select("key")
    found = lookup.get_many(cut, maybe)
    return found.where("status <> 'ABSENT'")


def repl_asof_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views are lookups in a script of all events."""
    log = changelog.from_events(events(spark, sf_dir), 1000, "event_type")
    verb = F.when(F.col("event_type") == "view", "GET").when(F.col("is_deleted"), "DELETE").otherwise("PUT")
    return lookup.asof_get(log.select("seq", verb.alias("verb"), "key", "value"))


def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script of all events: verbs in odd cases and blanks, missing arguments, unknown verbs, blank lines, and QUIT at event 9000."""
    log = changelog.from_events(events(spark, sf_dir), 1000, "event_type")
    key, kind = F.col("key"), F.col("event_type")
    line = (
        F.when(F.col("seq") == 9000, "qUit").when(F.col("seq") % 97 == 0, " \t ").when(F.col("seq") % 89 == 0, F.concat(F.lit("frob "), key)).when(F.col("seq") % 83 == 0, F.concat(F.lit("PUT "), key)).when(F.col("seq") % 79 == 0, "get")
        .when(kind == "view", F.concat(F.lit("  get  "), key, F.lit(" more"))).when(kind == "error", F.concat(F.when(F.col("seq") % 2 == 0, "DEL ").otherwise("delete "), key)).otherwise(F.concat(F.lit("Put "), key, F.lit("   "), kind, F.lit("  "), F.col("seq").cast("string"), F.lit(" \t")))
    )
    return log.select("seq", line.alias("line"))


def repl_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return script.answers(script_lines(spark, sf_dir))


def threshold_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores, keys dealt by their number, each flushed at its write buffer's threshold."""
    log = log_of(spark, sf_dir)
    return memory.threshold_flush(log.withColumn("shard", F.substring_index("key", "_", -1).cast("bigint") % SHARDS))


def streaming_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log read as a stream, until there is no more, into runs of changed keys, and their merge."""
    at, source = scratch(spark, "stream"), f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder, name = source.rsplit("/", 1)
    stream = spark.readStream.schema(schema).parquet(source) if _is_folder(spark, source) else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    state_to_runs(changelog.from_events(stream), f"{at}/runs", f"{at}/progress").awaitTermination()
    return latest(spark.read.parquet(f"{at}/runs"), "file_id", "seq").select("key", "value", "is_deleted", "seq")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def conversation_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second log: the last turn of each conversation."""
    log = changelog.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return without_tombstones(latest(log, "seq")).select("key", "value", "seq")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        put_delete_log, flush_runs, compact_purge, compact_keep_tombstones, compact_partial_purge, count_incl_tombstones, versions_per_key, superseded_rows, manifest_list, run_footer, sparse_index,
        memtable_memory, memtable_scan, get_many, get_one, answered_by, seek_scan, range_scan, tombstone_masking, wal_encode, wal_round_trip, wal_recover, wal_file_recover, run_write_read, manifest_load, store_reopen, store_compacted, recovered_state, bloom_bits, bloom_fpr, bloom_stored_get,
        bloom_round_trip, bloom_pruned_get, repl_asof_get, repl_script, threshold_flush, streaming_latest, conversation_latest,
    )
}

_LOG = """log AS (SELECT event_id AS seq, event_type = 'error' AS is_deleted, 'user_' || CAST(user_id AS VARCHAR) AS key,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || coalesce(props, '') END AS value, CAST(floor(event_id / 1000) AS BIGINT) AS file_id, event_type, user_id FROM events)"""
_RUN = f"""{_LOG}, run AS (SELECT file_id, key, value, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY file_id, key ORDER BY seq DESC) rn FROM log) t WHERE rn = 1)"""
_CUR = f"""{_RUN}, cur AS (SELECT key, value, is_deleted, file_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_id DESC) rn FROM run) t WHERE rn = 1)"""
_WANTED = "wanted AS (SELECT unnest(['user_1', 'user_2', 'user_10', 'user_77', 'user_149', 'nobody', '', 'user_']) AS key)"
_GET = "SELECT w.key, CASE WHEN c.key IS NULL THEN 'ABSENT' WHEN c.is_deleted THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN c.key IS NULL OR c.is_deleted THEN '' ELSE c.value END AS value FROM wanted w LEFT JOIN cur c ON w.key = c.key"
_H1 = f"(CAST('0x' || substr(md5(key), 1, 15) AS BIGINT) % {BITS})"
_H2 = f"(CAST('0x' || substr(md5(key), 16, 15) AS BIGINT) % {BITS})"
_BIT = f"({_H1} + i * (CASE WHEN {_H2} = 0 THEN 1 ELSE {_H2} END)) % {BITS}"
_I = f"(SELECT unnest(range({HASHES})) AS i)"
_BLOOM = f"WITH {_RUN} SELECT DISTINCT file_id, {_BIT} AS bit FROM run, {_I}"
_QUIT = 9000
_SCRIPT = f"""{_LOG}, typed AS (SELECT seq, key, value, event_type, CASE WHEN seq = {_QUIT} THEN 'QUIT' WHEN seq % 97 = 0 THEN '' WHEN seq % 89 = 0 THEN 'frob' WHEN seq % 83 = 0 THEN 'PUT?' WHEN seq % 79 = 0 THEN 'GET?'
    WHEN event_type = 'view' THEN 'GET' WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS verb FROM log WHERE seq <= {_QUIT})"""
_GENERATIONS = f"""{_LOG}, sized AS (SELECT *, user_id % {SHARDS} AS shard, 112 + strlen(key) + strlen(value) AS fresh, strlen(value) AS held FROM log),
    grown AS (SELECT shard, CAST(-1 AS INTEGER) AS generation, CAST(-1 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS stop FROM (SELECT DISTINCT shard FROM sized) t
      UNION ALL SELECT shard, generation + 1, stop, min(seq) FILTER (WHERE total >= 4096)
      FROM (SELECT *, sum(delta) OVER (PARTITION BY shard ORDER BY seq) AS total
        FROM (SELECT s.seq, s.shard, g.generation, g.stop, CASE WHEN lag(s.held) OVER w IS NULL THEN s.fresh ELSE s.held - lag(s.held) OVER w END AS delta
          FROM grown g JOIN sized s ON s.shard = g.shard AND s.seq > g.stop WINDOW w AS (PARTITION BY s.shard, s.key ORDER BY s.seq)) d) t GROUP BY shard, generation, stop)"""
_CONTROL = "chr(8)", "chr(12)", "chr(10)", "chr(13)", "chr(9)"


def _json(text: str) -> str:
    text = f"replace(replace({text}, '\\', '\\\\'), '\"', '\\\"')"
    for char, short in zip(_CONTROL, "bfnrt", strict=True):
        text = f"replace({text}, {char}, '\\{short}')"
    return text


ORACLE_SQL: dict[str, str] = {
    "put_delete_log": f"WITH {_LOG} SELECT seq, key, value, is_deleted, file_id FROM log",
    "flush_runs": f"WITH {_RUN} SELECT * FROM run",
    "compact_purge": f"WITH {_CUR} SELECT key, value FROM cur WHERE NOT is_deleted",
    "compact_keep_tombstones": f"WITH {_CUR} SELECT key, value, is_deleted FROM cur",
    "compact_partial_purge": f"WITH {_RUN} SELECT key, value, is_deleted FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file_id DESC) rn FROM run WHERE file_id < 5) t WHERE rn = 1 AND NOT is_deleted",
    "count_incl_tombstones": f"WITH {_LOG} SELECT file_id, count(DISTINCT key) AS n_keys FROM log GROUP BY file_id",
    "versions_per_key": f"WITH {_RUN} SELECT key, count(*) AS n_versions, min(file_id) AS first_file, max(file_id) AS last_file FROM run GROUP BY key",
    "superseded_rows": f"WITH {_CUR} SELECT r.file_id, r.key, r.value, r.is_deleted, c.file_id AS newest FROM run r JOIN cur c ON r.key = c.key WHERE r.file_id < c.file_id",
    "manifest_list": f"WITH {_RUN} SELECT CAST(row_number() OVER (ORDER BY file_id) - 1 AS INTEGER) AS ordinal, 'data_' || CAST(file_id AS VARCHAR) AS path, file_id FROM (SELECT DISTINCT file_id FROM run) t",
    "run_footer": f"WITH {_RUN} SELECT file_id, count(*) AS entry_count, min(key) AS first_key, max(key) AS last_key, CAST(sum(CAST(is_deleted AS BIGINT)) AS BIGINT) AS tombstones FROM run GROUP BY file_id",
    "sparse_index": f"""WITH {_RUN}, placed AS (SELECT file_id, key, row_number() OVER (PARTITION BY file_id ORDER BY key) - 1 AS n, CAST(sum(9 + strlen(key) + strlen(value)) OVER (PARTITION BY file_id ORDER BY key ROWS UNBOUNDED PRECEDING) - (9 + strlen(key) + strlen(value)) AS BIGINT) AS off FROM run)
        SELECT file_id, key, off FROM placed WHERE n % 16 = 0""",
    "memtable_memory": f"WITH {_RUN} SELECT file_id, CAST(sum(112 + strlen(key) + strlen(value)) AS BIGINT) AS bytes, count(*) AS entries FROM run GROUP BY file_id",
    "memtable_scan": f"WITH {_RUN} SELECT key, value, is_deleted FROM run WHERE file_id = (SELECT max(file_id) FROM run)",
    "get_many": f"WITH {_CUR}, {_WANTED} {_GET}",
    "get_one": f"WITH {_CUR}, wanted AS (SELECT 'user_10' AS key) {_GET}",
    "answered_by": f"WITH {_CUR}, {_WANTED} SELECT w.key, c.file_id, CAST((SELECT count(DISTINCT file_id) FROM run r WHERE c.file_id IS NULL OR r.file_id >= c.file_id) AS INTEGER) AS probes FROM wanted w LEFT JOIN cur c ON w.key = c.key",
    "seek_scan": f"WITH {_CUR} SELECT key, value, is_deleted FROM cur WHERE key >= 'user_12x' ORDER BY key LIMIT 20",
    "range_scan": f"WITH {_CUR} SELECT key, value FROM cur WHERE key >= 'user_1' AND key < 'user_3' AND NOT is_deleted",
    "tombstone_masking": f"WITH {_CUR} SELECT c.key, c.file_id AS deleted_in, count(*) AS masked FROM cur c JOIN run r ON r.key = c.key AND r.file_id < c.file_id WHERE c.is_deleted AND NOT r.is_deleted GROUP BY c.key, c.file_id",
    "wal_encode": f"""WITH {_LOG} SELECT seq, '{{"operation":"' || CASE WHEN is_deleted THEN 'DELETE' ELSE 'PUT' END || '","key":"' || {_json("key")} || '","value":"' || {_json("value")} || '","timestamp":' || CAST(seq * 1000 AS VARCHAR) || '}}' AS line FROM log""",
    "wal_round_trip": f"WITH {_LOG} SELECT file_id, seq, key, value, is_deleted FROM log",
    "wal_recover": f"WITH {_LOG}, torn AS (SELECT file_id, min(seq) AS torn FROM log WHERE user_id % 50 = 0 GROUP BY file_id) SELECT file_id, seq, key, value, is_deleted FROM log LEFT JOIN torn USING (file_id) WHERE torn IS NULL OR seq < torn",
    "wal_file_recover": f"WITH {_LOG} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, key, value, is_deleted FROM log WHERE file_id = (SELECT max(file_id) FROM log)",
    "run_write_read": f"WITH {_RUN} SELECT file_id, key, value, is_deleted FROM run WHERE key >= 'user_1' AND key < 'user_3'",
    "manifest_load": "SELECT CAST(2 - n AS INTEGER) AS ordinal, 'data_' || CAST(2 - n AS VARCHAR) AS path, CAST(2 - n AS BIGINT) AS file_id FROM range(3) t(n)",
    "store_reopen": f"WITH {_CUR} SELECT key, value, is_deleted FROM cur",
    "store_compacted": f"WITH {_LOG} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq % 3 DESC, seq DESC) rn FROM log) t WHERE rn = 1 AND NOT is_deleted",
    "bloom_stored_get": f"WITH {_RUN}, {_WANTED}, bits AS (SELECT DISTINCT file_id, {_BIT} AS bit FROM run, {_I}), asked AS (SELECT DISTINCT key, {_BIT} AS bit FROM wanted, {_I}), passed AS (SELECT key, file_id FROM asked JOIN bits USING (bit) GROUP BY key, file_id HAVING count(*) = (SELECT count(*) FROM asked a WHERE a.key = asked.key)) SELECT p.key, count(*) AS passed, count(r.key) AS held FROM passed p LEFT JOIN run r ON r.key = p.key AND r.file_id = p.file_id GROUP BY p.key",
    "recovered_state": f"WITH {_CUR} SELECT key, value, is_deleted FROM cur",
    "bloom_bits": _BLOOM,
    "bloom_fpr": f"""WITH added AS (SELECT DISTINCT {_BIT} AS bit FROM (SELECT 'inserted_key_' || CAST(n AS VARCHAR) AS key FROM range(1000) t(n)), {_I}),
        asked AS (SELECT DISTINCT key, {_BIT} AS bit FROM (SELECT 'uninserted_key_' || CAST(n AS VARCHAR) AS key FROM range(10000) t(n)), {_I})
        SELECT key FROM asked LEFT JOIN added USING (bit) GROUP BY key HAVING count(added.bit) = count(*)""",
    "bloom_round_trip": _BLOOM,
    "bloom_pruned_get": f"WITH {_CUR}, {_WANTED} SELECT * FROM ({_GET}) t WHERE status <> 'ABSENT'",
    "repl_asof_get": f"""WITH {_LOG}, marked AS (SELECT *, CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v, CASE WHEN event_type = 'view' THEN NULL ELSE is_deleted END AS d FROM log),
        seen AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, last_value(d IGNORE NULLS) OVER w AS ld FROM marked WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT seq, key, CASE WHEN ld IS NULL THEN 'ABSENT' WHEN ld THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN ld IS NULL OR ld THEN '' ELSE lv END AS value FROM seen WHERE event_type = 'view'""",
    "repl_script": f"""WITH {_SCRIPT}, marked AS (SELECT *, CASE verb WHEN 'PUT' THEN event_type || '  ' || CAST(seq AS VARCHAR) WHEN 'DELETE' THEN '' END AS v, CASE verb WHEN 'PUT' THEN false WHEN 'DELETE' THEN true END AS d FROM typed),
        seen AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, last_value(d IGNORE NULLS) OVER w AS ld FROM marked WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT seq, CASE verb WHEN 'QUIT' THEN 'Bye!' WHEN 'frob' THEN '(error) Unknown command: frob' WHEN 'PUT?' THEN '(error) Usage: PUT <key> <val>' WHEN 'GET?' THEN '(error) Usage: GET <key>' WHEN 'GET' THEN CASE WHEN ld IS NULL THEN '(nil)' WHEN ld THEN '(error) Key marked as deleted' ELSE '"' || lv || '"' END ELSE 'OK' END AS output FROM seen WHERE verb <> ''""",
    "threshold_flush": f"""WITH RECURSIVE {_GENERATIONS}, placed AS (SELECT s.shard, g.generation, g.stop AS flush_seq, s.key, s.value, s.is_deleted, row_number() OVER (PARTITION BY s.shard, g.generation, s.key ORDER BY s.seq DESC) AS rn
        FROM grown g JOIN sized s ON s.shard = g.shard AND s.seq > g.start AND s.seq <= coalesce(g.stop, 9223372036854775807) WHERE g.generation >= 0) SELECT shard, generation, flush_seq, key, value, is_deleted FROM placed WHERE rn = 1""",
    "streaming_latest": f"WITH {_LOG} SELECT key, value, is_deleted, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM log) t WHERE rn = 1",
    "conversation_latest": "SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS key, role || ':' || coalesce(text, '') AS value, turn AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) t WHERE rn = 1",
}
