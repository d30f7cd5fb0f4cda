"""Incremental linking, an extension: a stream of new records against a fixed index.

The join is stateless: each micro-batch meets the index's postings and vocabulary, which stay static.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.operators.retrieve import Channel, ranked, score_pairs
from kinbridge.operators.tokens import postings, query_postings


def link_stream(records: DataFrame, index: DataFrame, vocab: DataFrame, channel: Channel, part: str, doc: str, path: str, checkpoint: str):
    """Starts a query that appends each batch's (q, t, score, rank) to Parquet; a batch is written once, by its id."""

    def one(batch: DataFrame, batch_id: int) -> None:
        asked = query_postings(postings(batch, part, doc, channel.field, channel.mode), vocab, channel.df_cap)
        found = ranked(score_pairs(asked, index), channel.top_k).withColumn("batch", F.lit(batch_id))
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
