"""The registered queries of this subpackage: thin digests of what the operators return, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from . import quality, toxicity
from .common import dealt, held_out_fold, shared_folder, table
from .decontamination import find_leaks
from .langid import fit as fit_languages
from .langid import identify
from .sentencepiece_bpe import encode_documents
from .sharding import shard_documents
from .simhash import near_duplicates
from .substring_dedup import deduplicate
from .token_counts import count_tokens


def piece_model() -> str:
    """Where the public tokenizers' BPE model lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a slot map that is dealt, stored, rebalanced to the sizes of the table, stored again and loaded."""
    return shard_documents(documents(spark, sf_dir), store=f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = identify(docs, fit_languages(docs))
    return out.select("doc_id", held_out_fold(out.doc_id).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out_fold(out.doc_id).alias("held_out"), "score", "predicted")


def graded(labels: DataFrame) -> DataFrame:
    """Graded ratings from the two labels: 0 poor, 1 good but toxic, 2 good."""
    poor, toxic = F.col("quality") == 0, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.where(F.col("quality").isNotNull()).select("doc_id", F.when(poor, 0).when(toxic, 1).otherwise(2).alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality.grade(docs, quality.fit(docs, graded(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", held_out_fold(out.doc_id).alias("held_out"), "expected_grade", "tails", "selected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id", "n_links")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(documents(spark, sf_dir), piece_model(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_langid": op2_langid,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_ann": op10_ann,
}

ORACLE_SQL: dict[str, str] = {}
