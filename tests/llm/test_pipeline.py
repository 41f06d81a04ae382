import os

import pytest

import __spark_entry__ as contract
import corpus_pipeline

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        assert docs.join(before, "doc_id", "left_anti").isEmpty()
        assert docs.columns == columns or k == 4
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5] > counts[0] // 2
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if n.startswith("op")))
def test_queries_give_whole_results(spark, name):
    df = contract.queries()[name](spark, SF)
    found = df.toArrow()
    ids = {"op4_decontamination": None, "op10_ann": None}
    if name not in ids:
        docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
        assert set(found.column("doc_id").to_pylist()) == docs
    assert found.num_rows
