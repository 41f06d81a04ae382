"""A training-corpus pipeline in stages, each written as Parquet and read again as the next one's documents.

In order: toxic documents go, one document of each group of near copies stays, repeated sentence runs are cut from all but their
first place, documents that hold benchmark items go, and the rest is encoded into pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemerge.llm import toxicity
from tidemerge.llm.common import shared_folder, table
from tidemerge.llm.decontamination import find_leaks
from tidemerge.llm.near_copies import keep_one
from tidemerge.llm.queries import piece_model
from tidemerge.llm.sentencepiece_bpe import encode_documents
from tidemerge.llm.substring_dedup import rewritten


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic by compression distance go; all others stay as they are."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with five-word shingles at least 0.8 similar, found by SimHash fingerprints and bands of minima, form a group; that of the smallest id stays."""
    return keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated runs are cut; a document of which nothing is left goes."""
    return rewritten(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, with an id or without."""
    columns = [f"c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*columns).withColumn("key", F.xxhash64(columns[docs.columns.index("text")]))
    texts = named.select(F.col("key").alias("doc_id"), F.col(columns[docs.columns.index("text")]).alias("text"))
    leaks = find_leaks(texts, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("key")).distinct()
    return named.join(leaks, "key", "left_anti").select(*columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of each document."""
    return encode_documents(docs, piece_model(), with_text=False).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("sentencepiece", encode),
]

#: Dictionaries, fingerprints and pieces can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
