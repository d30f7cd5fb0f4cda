"""From raw documents to token ids: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage works on all that its predecessor kept, written as Parquet in the shared folder and read
again.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinbridge.llm.common import cut, table
from kinbridge.llm.stages import STAGES

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: Convolution, components, edit distance and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
