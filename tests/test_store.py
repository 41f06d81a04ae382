import pytest
from tables import rows

from tidemerge.operators.merge import latest
from tidemerge.plans.engine import Store
from tidemerge.plans.script import answers
from tidemerge.schema import CHANGE
from tidemerge.streaming.memtable import state_to_runs, to_runs


SCRIPT = ["PUT k1  a  b ", "get k1", "  ", "GET k2", "del k1", "GET k1 ignored", "PUT k1", "PUT", "DELETE", "get", "Put K1 x", "GET K1", "GET k1", "frob x", "DELETE k9", "GET k9", "quit", "PUT k1 late"]


def test_masking_flush_restart_and_compaction(spark, tmp_path):
    folder = str(tmp_path / "db")
    db = Store(spark, folder, write_buffer_bytes=1 << 20)
    db.write(spark.createDataFrame([(0, "user_100", "Alice", False), (1, "user_200", "Bob", False)], CHANGE))
    db.flush()
    db.delete("user_100")
    assert db.get("user_100") == ("DELETED", "")
    again = Store(spark, folder, write_buffer_bytes=1 << 20)
    assert again.get("user_100") == ("DELETED", "") and again.get("user_200") == ("FOUND", "Bob") and again.get("x") == ("ABSENT", "")
    again.put("unflushed", "v")
    again.flush()
    again.flush()
    assert again.run_count() == 2
    third = Store(spark, folder)
    assert third.get("user_100") == ("DELETED", "") and third.get("unflushed") == ("FOUND", "v")
    third.compact()
    assert third.run_count() == 1 and third.get("user_100") == ("ABSENT", "")
    assert [r.key for r in Store(spark, folder).scan().collect()] == ["unflushed", "user_200"]
    assert [r.key for r in Store(spark, folder).seek("user", 3).collect()] == ["user_200"]


def test_automatic_flush(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), write_buffer_bytes=100)
    db.put("key_01", "value_100")
    db.put("key_02", "value_200")
    assert db.run_count() == 2 and db.memory_usage() == 0
    assert db.get("key_01") == ("FOUND", "value_100")


def test_updates_over_flushes_and_missing_runs(spark, tmp_path):
    import shutil

    folder = str(tmp_path / "db")
    db = Store(spark, folder, write_buffer_bytes=1 << 20)
    for n in "123":
        db.put("counter", n)
        assert db.get("counter") == ("FOUND", n)
        if n != "3":
            db.flush()
    assert db.get("counter") == ("FOUND", "3")
    shutil.rmtree(f"{folder}/data_0")
    with pytest.raises(FileNotFoundError):
        Store(spark, folder)
    assert Store(spark, folder, ignore_missing=True).get("counter") == ("FOUND", "3")


def contents(folder, spark):
    return [(r.key, r.value) for r in Store(spark, folder, write_buffer_bytes=1 << 20).scan().collect() if not r.is_deleted]


def test_a_store_survives_any_failed_write(spark, tmp_path, monkeypatch):
    from tidemerge.sources.shared import Files

    folder = str(tmp_path / "db")
    db = Store(spark, folder, write_buffer_bytes=1 << 20)
    for k in range(3):
        db.write(spark.createDataFrame([(0, f"k{k}", f"v{k}", False), (1, "shared", str(k), False)], CHANGE))
        db.flush()
    before = contents(folder, spark)
    assert before == [("k0", "v0"), ("k1", "v1"), ("k2", "v2"), ("shared", "2")]

    def broken(*_, **__):
        raise OSError("no space left")

    for name, act in (("publish", lambda x: x.compact()), ("delete", lambda x: x.compact()), ("publish", lambda x: (x.put("new", "n"), x.flush())), ("delete", lambda x: x.flush())):
        with monkeypatch.context() as m:
            m.setattr(Files, name, broken)
            with pytest.raises(OSError):
                act(Store(spark, folder, write_buffer_bytes=1 << 20))
        now = contents(folder, spark)
        assert now == before or now == [*before[:3], ("new", "n"), before[3]]
    with monkeypatch.context() as m:
        m.setattr(Store, "_written", broken)
        with pytest.raises(OSError):
            Store(spark, folder).compact()
    again = Store(spark, folder, write_buffer_bytes=1 << 20)
    again.put("k1", "later")
    again.flush()
    assert dict(contents(folder, spark)) == dict(before) | {"new": "n", "k1": "later"}


def test_damaged_and_missing_manifests_are_errors(spark, tmp_path):
    folder = tmp_path / "db"
    db = Store(spark, str(folder), write_buffer_bytes=1 << 20)
    db.put("a", "1")
    db.flush()
    newest = max(folder.glob("MANIFEST-*"))
    text = newest.read_text()
    (folder / f".{newest.name}.crc").unlink(missing_ok=True)
    newest.write_text(text[:-5])
    with pytest.raises(ValueError):
        Store(spark, str(folder))
    newest.unlink()
    with pytest.raises(FileNotFoundError):
        Store(spark, str(folder))


def test_compaction_of_neighbours(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), write_buffer_bytes=1 << 20)
    for k, (value, dead) in enumerate([("0", False), ("1", False), ("", True), ("3", False)]):
        db.write(spark.createDataFrame([(0, "k", value, dead), (1, f"own{k}", "x", False)], CHANGE))
        db.flush()
    with pytest.raises(ValueError):
        db.compact(file_ids=[0, 2], purge_tombstones=False)
    with pytest.raises(ValueError):
        db.compact(file_ids=[1, 2])
    db.compact(file_ids=[1, 2], purge_tombstones=False)
    assert [r.file_id for r in db.run_list().collect()] == [3, 2, 0] and db.get("k") == ("FOUND", "3")
    db.compact(file_ids=[0, 2])
    assert db.get("k") == ("FOUND", "3") and db.get("own1") == ("FOUND", "x") and db.run_count() == 2


def test_freeze_clear_empty_and_volatile(spark, tmp_path):
    db = Store(spark, str(tmp_path / "db"), write_buffer_bytes=1 << 20, logged=False)
    assert db.is_empty()
    db.delete("unknown")
    assert not db.is_empty()
    db.freeze()
    with pytest.raises(RuntimeError):
        db.put("a", "b")
    assert db.get("unknown") == ("DELETED", "")
    db.clear()
    assert db.is_empty() and db.get("unknown") == ("ABSENT", "")
    db.write(spark.createDataFrame([(0, "a", None, False)], CHANGE))
    assert db.get("a") == ("FOUND", "") and Store(spark, db.folder).is_empty()


def test_script(spark):
    out = dict(rows(answers(spark.createDataFrame(list(enumerate(SCRIPT)), "seq int, line string"))))
    assert out[1] == '"a  b"' and out[3] == "(nil)" and out[5] == "(error) Key marked as deleted" and out[11] == '"x"'
    assert 2 not in out and out[16] == "Bye!" and 17 not in out


def test_streaming_state_equals_batch_and_is_robust_to_order(spark, tmp_path):
    log = [(i, f"k{i % 7}", "" if i % 5 == 0 else f"v{i}", i % 5 == 0) for i in range(100)]
    source = str(tmp_path / "in")
    for part in (log[50:], log[:50]):
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(source)
    state_to_runs(stream, str(tmp_path / "state"), str(tmp_path / "progress")).awaitTermination()
    expected = {k: (v, d) for _, k, v, d in log}
    state = latest(spark.read.parquet(str(tmp_path / "state")), "file_id", "seq")
    assert {r.key: (r.value, r.is_deleted) for r in state.collect()} == expected
    to_runs(stream, str(tmp_path / "runs"), str(tmp_path / "progress2")).awaitTermination()
    runs = spark.read.parquet(str(tmp_path / "runs"))
    assert runs.select("file_id").distinct().count() == 2 and runs.count() == 14


def test_a_large_batch_is_logged_in_files_and_read_in_splits(spark, tmp_path):
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in held}
    try:
        for name, value in held.items():
            spark.conf.set(name, value)
        db = Store(spark, str(tmp_path / "db"), write_buffer_bytes=1 << 62)
        log = [(i, f"k{i % 7}", "" if i % 5 == 0 else f"v{i}", i % 5 == 0) for i in range(200)]
        db.write(spark.createDataFrame(log[::-1], CHANGE))
        db.write(spark.createDataFrame([], CHANGE))
        db.write(spark.createDataFrame([(0, "k0", "newer", False)], CHANGE))
        files = sorted((tmp_path / "db/wal/0").glob("part-*"))
        assert len(files) > 1
        newest = {k: (v, d) for _, k, v, d in log}
        state = lambda: {r.key: (r.value, r.is_deleted) for r in Store(spark, db.folder, write_buffer_bytes=1 << 62).scan().collect()}
        assert state() == newest | {"k0": ("newer", False)}
        whole = [path.read_text().splitlines() for path in files]
        assert sum(map(len, whole)) == 200
        for part in range(1, len(files)):  # damaged in the middle of a file: what follows in this and later files is lost
            at = sum(map(len, whole[:part])) + len(whole[part]) // 2
            lines = [*whole[part]]
            lines[len(lines) // 2] = lines[len(lines) // 2][:-1]
            (files[part].parent / f".{files[part].name}.crc").unlink(missing_ok=True)
            files[part].write_text("\n".join(lines) + "\n")
            assert state() == {k: (v, d) for _, k, v, d in log[:at]} | {"k0": ("newer", False)}
            files[part].write_text("\n".join(whole[part]) + "\n")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
