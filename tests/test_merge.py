import random

import pytest
from tables import rows
from pyspark.sql import functions as F

from tidemerge.operators import lookup
from tidemerge.operators.memory import buffer_usage, threshold_flush
from tidemerge.operators.merge import compact, latest, superseded, ties, versions
from tidemerge.operators.run_metadata import footers, sparse_index
from tidemerge.schema import CHANGE, RUN
from tidemerge.sources import runs as run_files

THREE = [
    (1, "apple", "fruit_v1", False), (1, "banana", "yellow_v1", False), (1, "cherry", "red_v1", False), (1, "date", "sweet_v1", False),
    (2, "banana", "yellow_v2", False), (2, "date", "", True), (2, "elderberry", "purple_v1", False),
    (3, "apple", "fruit_v3", False), (3, "cherry", "", True), (3, "fig", "brown_v1", False),
]


def test_compaction_of_three_runs(spark):
    runs = spark.createDataFrame(THREE, RUN)
    assert rows(compact(runs).select("key", "value")) == [("apple", "fruit_v3"), ("banana", "yellow_v2"), ("elderberry", "purple_v1"), ("fig", "brown_v1")]
    assert ("cherry", "", True) in rows(compact(runs, purge_tombstones=False))


def test_tombstones_are_kept_on_request_and_lose_their_value(spark):
    runs = spark.createDataFrame([(10, "k1", "val1", False), (10, "k2", "val2", False), (20, "k1", "stale", True)], RUN)
    assert rows(compact(runs, purge_tombstones=False)) == [("k1", "", True), ("k2", "val2", False)]


def test_partial_purge_is_refused(spark):
    runs = spark.createDataFrame(THREE, RUN)
    with pytest.raises(ValueError):
        compact(runs, inputs=F.col("file_id") > 1)
    assert rows(compact(runs, inputs=F.col("file_id") <= 2, all_inputs=True).select("key")) == [("apple",), ("banana",), ("cherry",), ("elderberry",)]


def test_only_tombstones_and_nothing(spark):
    assert rows(compact(spark.createDataFrame([(1, "a", "", True)], RUN))) == []
    assert rows(compact(spark.createDataFrame([], RUN))) == []


def test_put_delete_put_over_three_runs_and_empty_keys_and_values(spark):
    runs = spark.createDataFrame([(1, "k", "a", False), (2, "k", "", True), (3, "k", "", False), (1, "", "empty key", False), (1, "é", "x", False)], RUN)
    wanted = spark.createDataFrame([("k",), ("",), ("é",), ("none",)], "key string")
    assert rows(lookup.get_many(runs, wanted)) == [("", "FOUND", "empty key"), ("k", "FOUND", ""), ("none", "ABSENT", ""), ("é", "FOUND", "x")]


def test_seek_and_scan_in_byte_order(spark):
    runs = spark.createDataFrame([(1, k, k, False) for k in ("cherry", "apple", "date", "banana")] + [(2, "date", "", True)], RUN)
    assert [r.key for r in lookup.seek(runs, "blueberry", 2).collect()] == ["cherry", "date"]
    assert lookup.seek(runs, "z").collect() == []
    assert [r.key for r in lookup.seek(runs, "blueberry", 2, versions=2).collect()] == ["cherry", "date"]
    assert lookup.seek(runs, "z", versions=2).collect() == []
    assert [r.key for r in lookup.scan(runs, tombstones=False).collect()] == ["apple", "banana", "cherry"]


def test_seek_looks_no_further_than_it_must(spark):
    runs = spark.createDataFrame([(f, f"k{i:03}", f"{f}", (i + f) % 3 == 0) for i in range(200) for f in range(3) if (i * 7 + f) % 4], RUN)
    for target, n in (("", 5), ("k050", 7), ("k198", 9), ("k07", 1)):
        assert lookup.seek(runs, target, n, versions=3).collect() == lookup.seek(runs, target, n).collect()


def test_lookups_across_blocks_equal_a_plain_loop(spark):
    rng = random.Random(3)
    script = [(i, rng.choice(["GET", "GET", "PUT", "DELETE"]), rng.choice(["hot", "hot", "a", "b", "c", None]), f"v{i}") for i in range(300)]
    state, expected = {}, []
    for seq, verb, key, value in script:
        if verb == "GET":
            status, held = state.get(key, ("ABSENT", ""))
            expected.append((seq, key, status, held))
        else:
            state[key] = ("DELETED", "") if verb == "DELETE" else ("FOUND", value)
    df = spark.createDataFrame(script, "seq bigint, verb string, key string, value string")
    for block in (1, 7, 1000):
        assert rows(lookup.asof_get(df, block)) == sorted(expected, key=repr)


def test_answered_by_the_newest_run(spark):
    runs = spark.createDataFrame(THREE, RUN)
    wanted = spark.createDataFrame([("apple",), ("banana",), ("nothing",)], "key string")
    assert rows(lookup.answered_by(runs, wanted)) == [("apple", 3, 1), ("banana", 2, 2), ("nothing", None, 3)]


def test_merging_is_associative_and_compaction_leaves_lookups_alone(spark):
    rng = random.Random(3)
    log = [(i, f"k{rng.randrange(40)}", "" if (d := rng.random() < 0.3) else f"v{i}", d) for i in range(600)]
    changes = spark.createDataFrame(log, CHANGE).withColumn("file_id", F.floor(F.col("seq") / 50).cast("bigint"))
    runs = run_files.cut(changes)
    state = {k: (v, d) for _, k, v, d in log}
    expected = sorted((k, v, d) for k, (v, d) in state.items())
    assert rows(compact(runs, purge_tombstones=False)) == expected
    some = compact(runs, purge_tombstones=False, inputs=F.col("file_id") < 7).withColumn("file_id", F.lit(6).cast("bigint"))
    again = some.select("file_id", "key", "value", "is_deleted").unionByName(runs.where("file_id >= 7"))
    assert rows(compact(again, purge_tombstones=False)) == expected
    assert rows(latest(changes, "seq").select("key", "value", "is_deleted")) == expected
    assert ties(changes, "seq").isEmpty()
    assert sum(r.n_versions for r in versions(runs).collect()) == runs.count() == superseded(runs).count() + len(state)


def test_memory_is_a_function_of_the_state(spark):
    log = spark.createDataFrame([(0, "key1", "val1", False), (1, "key1", "longer", False), (2, "k2", "", True)], CHANGE)
    assert rows(buffer_usage(log)) == [(112 + 4 + 6 + 112 + 2, 2)]


def test_threshold_flush_equals_a_fold(spark):
    rng = random.Random(5)
    log = [(s, i, f"k{rng.randrange(30)}", "v" * rng.randrange(40), rng.random() < 0.2) for i in range(400) for s in (0, 1)]
    log = [(s, i, k, "" if d else v, d) for s, i, k, v, d in log]
    got = rows(threshold_flush(spark.createDataFrame(log, "shard bigint, seq bigint, key string, value string, is_deleted boolean"), buffer_bytes=1500))
    expected = []
    for shard in (0, 1):
        table, generation = {}, 0
        for s, i, k, v, d in log:
            if s == shard:
                table[k] = (v, d)
                if sum(112 + len(a) + len(b) for a, (b, _) in table.items()) >= 1500:
                    expected += [(shard, generation, i, a, *e) for a, e in table.items()]
                    table, generation = {}, generation + 1
        expected += [(shard, generation, None, a, *e) for a, e in table.items()]
    assert got == sorted(expected, key=repr)


def test_footer_and_sparse_index(spark):
    run = spark.createDataFrame([(1, f"key_{i:02}", f"value_{10 * i}", i % 5 == 0) for i in range(50)], RUN)
    assert rows(footers(run)) == [(1, 50, "key_00", "key_49", 10)]
    index = rows(sparse_index(run))
    assert [r[1] for r in index] == ["key_00", "key_16", "key_32", "key_48"]
    assert index[1][2] == sum(9 + 6 + len(f"value_{10 * i}") for i in range(16))


def test_sparse_index_in_ranges_equals_a_plain_loop(spark):
    rng = random.Random(8)
    entries = sorted({(f, f"{rng.randrange(10**6)}é", "v" * rng.randrange(9), False) for f in (1, 2) for _ in range(300)}, key=lambda r: (r[0], r[1].encode()))
    expected, at, place, own = [], 0, 0, None
    for f, key, value, _ in entries:
        if f != own:
            at, place, own = 0, 0, f
        if place % 16 == 0:
            expected.append((f, key, at))
        at, place = at + 9 + len(key.encode()) + len(value), place + 1
    run = spark.createDataFrame(entries, RUN)
    for ranges in (1, 5, 64):
        assert rows(sparse_index(run, ranges=ranges)) == sorted(expected, key=repr)
    assert rows(sparse_index(run.where("false"))) == []


def test_runs_are_written_sorted_and_pushed_down(spark, tmp_path):
    path = str(tmp_path / "runs")
    run_files.write(spark.createDataFrame(THREE, RUN), path)
    back = run_files.read(spark, path)
    assert rows(back) == sorted(THREE, key=repr)
    plan = lookup.get(back, "apple")._jdf.queryExecution().toString()
    assert "EqualTo(key,apple)" in plan
    assert "Window" not in plan
