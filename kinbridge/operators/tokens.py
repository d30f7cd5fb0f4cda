"""Postings, vocabularies and document frequencies, per partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("tokens", "key")
#: Document frequencies beyond which a vocabulary's tail is counted.
TAILS = (100, 1_000, 10_000, 100_000)


def tokenize(text: Column, mode: str = "tokens") -> Column:
    """Distinct tokens as an array: split at single spaces, or the whole value as one token."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    parts = F.split(text, " ", -1) if mode == "tokens" else F.array(text)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def postings(docs: DataFrame, part: str, doc: str, text: str, mode: str = "tokens") -> DataFrame:
    """(part, doc, token), each pair once."""
    return docs.select(F.col(part).alias("part"), F.col(doc).alias("doc"), F.explode(tokenize(F.col(text), mode)).alias("token"))


def vocabulary(posts: DataFrame, docs: DataFrame, part: str) -> DataFrame:
    """(part, token, df, n, idf): idf = ln(n / df), n counts all documents of the partition, empty ones too.

    The count of partitions is small beside the tokens; Spark decides by size whether to broadcast it.
    """
    sizes = docs.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"))
    df = posts.groupBy("part", "token").agg(F.count("*").alias("df"))
    return df.join(sizes, "part").select("part", "token", "df", "n", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"))


def query_postings(query: DataFrame, vocab: DataFrame, df_cap: int | None = None) -> DataFrame:
    """Query postings with the idf of known tokens; unknown tokens and those above the cap are dropped."""
    known = vocab if df_cap is None else vocab.where(F.col("df") <= df_cap)
    return query.join(known, ["part", "token"]).select("part", "doc", "token", "df", "idf")


def df_summary(vocab: DataFrame) -> DataFrame:
    """A row a partition: documents, tokens, postings, df quantiles (interpolated, then cut to whole numbers), tails."""
    q = lambda p: F.floor(F.round(F.percentile("df", F.lit(p)), 6)).cast("long")
    over = lambda k: F.sum(F.when(F.col("df") > k, 1).otherwise(0)).alias(f"over_{k}")
    share = lambda k: F.round(F.sum(F.when(F.col("df") > k, F.col("df")).otherwise(0)) / F.sum("df"), 6).alias(f"share_over_{k}")
    return vocab.groupBy("part").agg(
        F.max("n").alias("n_docs"), F.count("*").alias("n_tokens"), F.sum("df").alias("n_postings"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), q(0.999).alias("p999"),
        F.max("df").alias("max_df"), *[f(k) for k in TAILS for f in (over, share)],
    )


def top_tokens(vocab: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens of each partition; ties by token."""
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("df"), "token"))
    return vocab.withColumn("rank", rank).where(F.col("rank") <= k).select("part", "token", "df", "rank")


def index_size(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(part, n_tokens, n_postings, token_bytes): what an index holds; a posting is a document number, a token is stored once."""
    words = vocab.groupBy("part").agg(F.count("*").alias("n_tokens"), F.sum(F.octet_length("token").cast("long")).alias("token_bytes"))
    return words.join(posts.groupBy("part").agg(F.count("*").alias("n_postings")), "part").select("part", "n_tokens", "n_postings", "token_bytes")
