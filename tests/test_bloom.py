import os

import pytest
from pyspark.sql import functions as F
from tables import rows

from tidemerge.operators import bloom
from tidemerge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def keys(spark, prefix, n):
    return spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"))


def test_parameters():
    assert bloom.parameters() == (9586, 7)
    assert bloom.parameters(0, 5) == bloom.parameters(1, 0.01)


def test_no_false_negatives_and_few_false_positives(spark):
    bits, hashes = bloom.parameters()
    added = keys(spark, "inserted_key_", 1000)
    table = bloom.build(added, bits, hashes)
    assert bloom.probe(added, table, bits, hashes).where("not may_contain").isEmpty()
    assert bloom.probe(keys(spark, "uninserted_key_", 10000), table, bits, hashes).where("may_contain").count() <= 200


def test_sized_for_its_keys(spark):
    bits, hashes = bloom.parameters(5000)
    table = bloom.build(keys(spark, "in_", 5000), bits, hashes)
    assert bloom.probe(keys(spark, "out_", 5000), table, bits, hashes).where("may_contain").count() <= 100


def test_packed_round_trip(spark):
    bits, hashes = bloom.parameters(9000)
    table = bloom.build(keys(spark, "k", 3000), bits, hashes).unionByName(spark.createDataFrame([(0,), (32767,), (32768,)], "bit bigint")).distinct()
    back = bloom.unpacked(bloom.packed(table))
    assert table.exceptAll(back).isEmpty() and back.exceptAll(table).isEmpty()


def test_stored_filters_are_probed_as_they_are(spark, tmp_path):
    bits, hashes = bloom.parameters(9000)
    added = keys(spark, "k", 900).withColumn("run", F.crc32("key") % 3)
    table = bloom.build(added, bits, hashes, "run").where("run <> 2 or bit >= 32768")
    bloom.packed(table, "run").write.parquet(str(tmp_path / "filters"))
    asked, stored = keys(spark, "k", 2000), spark.read.parquet(str(tmp_path / "filters"))
    found = bloom.probe_stored(asked, stored, bits, hashes, "run")
    assert rows(found) == rows(bloom.probe(asked, table, bits, hashes, "run")) and found.where("may_contain").count() >= 500
    one = table.where("run = 1").drop("run")
    assert rows(bloom.probe_stored(asked, bloom.packed(one), bits, hashes)) == rows(bloom.probe(asked, one, bits, hashes))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_no_stored_filter_is_unpacked_for_a_lookup(spark):
    plan = QUERIES["bloom_stored_get"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap" in plan and "posexplode" not in plan
