"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame.

In all of them a null text is an empty text (and stays null), null ids and repeated ids are allowed, extra
columns of any name pass through, and empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinbridge.llm import bpe, decontaminate, quality_cnn, secret_scan, simhash
from kinbridge.llm.common import table
from kinbridge.llm.queries import RANK_FILE
from kinbridge.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts; equal rows fare alike; without labels of both classes it keeps all or none."""
    ship(spark)
    scored = quality_cnn.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id, ties by the text's hash; a repeated row stays once."""
    ship(spark)
    return simhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item; each row is judged by its own text; null and empty items match nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live credentials; n_chars follows the text and is null with it; all rows stay."""
    ship(spark)
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; decoding them gives the text back, which the digests show."""
    ship(spark)
    done = bpe.encode_documents(docs, RANK_FILE, public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("benchmark_decontamination", benchmark), ("secret_scan", secrets), ("byte_bpe", tokens)]
