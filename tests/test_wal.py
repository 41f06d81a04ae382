import random

from tables import rows
from pyspark.sql import functions as F

from tidemerge.schema import CHANGE
from tidemerge.sources import wal


def logged(spark, changes):
    return wal.encode(spark.createDataFrame(changes, CHANGE).withColumn("timestamp", F.col("seq") + 1))


def test_lines_are_exact(spark):
    got = logged(spark, [(0, 'k\\with"quotes"', "a\nb\tc\bd\fe\rf\x01g\x1f", False), (1, "key2", "left", True)]).orderBy("seq").collect()
    assert got[0].line == '{"operation":"PUT","key":"k\\\\with\\"quotes\\"","value":"a\\nb\\tc\\bd\\fe\\rf\\u0001g\\u001f","timestamp":1}'
    assert got[1].line == '{"operation":"DELETE","key":"key2","value":"","timestamp":2}'


def test_round_trip_of_any_text(spark):
    rng = random.Random(1)
    chars = [chr(c) for c in range(1, 128)] + list("éß漢😀")
    changes = [(i, "".join(rng.choices(chars, k=8)), "".join(rng.choices(chars, k=20)), False) for i in range(300)]
    back = wal.changes_of(wal.decode(logged(spark, changes).select(F.col("seq").alias("pos"), "line")))
    assert rows(back) == sorted(changes, key=repr)


def test_stops_at_the_first_damaged_line(spark, tmp_path):
    path = tmp_path / "wal.log"
    good = ['{"operation":"PUT","key":"key1","value":"val1","timestamp":1}', "", '{"operation":"DELETE","key":"key2","value":"","timestamp":2}']
    torn = '{"operation":"PUT","key":"key3","value":"incomplete'
    path.write_text("\n".join([*good, torn, good[0].replace("key1", "key4")]))
    assert rows(wal.recover(spark, str(path))) == [(0, "key1", "val1", False), (2, "key2", "", True)]
    path.write_text("\n".join([good[0], '{"operation":"PUT","key":"key3","timestamp":3}', good[2]]))
    assert rows(wal.recover(spark, str(path))) == [(0, "key1", "val1", False)]


def test_missing_log_unknown_operations_and_a_key_named_timestamp(spark, tmp_path):
    assert wal.recover(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "wal.log"
    path.write_text('{"operation":"MERGE","key":"a","value":"b","timestamp":1}\n{"operation":"PUT","key":"timestamp","value":"b","timestamp":2}\n')
    assert rows(wal.recover(spark, str(path))) == [(1, "timestamp", "b", False)]


def test_written_logs_are_read_back(spark, tmp_path):
    changes = [(i, f"key_{i}", f"value_{2 * i}", False) for i in range(100)] + [(100 + i, f"key_{2 * i}", "", True) for i in range(50)]
    wal.write(spark.createDataFrame(changes, CHANGE).withColumn("timestamp", F.lit(5)), str(tmp_path / "log"))
    part = next((tmp_path / "log").glob("part-*"))
    assert rows(wal.recover(spark, str(part))) == sorted(changes, key=repr)
