"""Candidate retrieval: idf-weighted token overlap as equi-joins, top-K, union and merge of channels.

Ranks start at 0; ties go to the smaller target.  Scores are rounded to six places before they rank, so
the order of summation never shows.  A channel's document-frequency cap bounds the rows that one token
can make; its join is on (part, token) with all partial sums combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinbridge.operators.tokens import postings, query_postings, vocabulary


@dataclass(frozen=True)
class Channel:
    """A retrieval channel: the text column, how it is tokenised, its df cap and how many targets a query keeps."""

    name: str
    field: str
    mode: str = "tokens"
    df_cap: int | None = 1000
    top_k: int | None = None


def score_pairs(query: DataFrame, index: DataFrame) -> DataFrame:
    """(q, t, score): summed idf of shared tokens; query has part, doc, token, idf, index part, doc, token."""
    pairs = query.select("part", "token", F.col("doc").alias("q"), "idf").join(index.select("part", "token", F.col("doc").alias("t")), ["part", "token"])
    return pairs.groupBy("q", "t").agg(F.round(F.sum("idf"), 6).alias("score")).where("score > 0")


def ranked(scored: DataFrame, k: int | None = None, score: str = "score", rank: str = "rank") -> DataFrame:
    """Adds the rank of each target within its query; k keeps the first k (a limit Spark pushes into the sort)."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(score), "t"))
    out = scored.withColumn("_n", place)
    if k is not None:
        out = out.where(F.col("_n") <= k)
    return out.withColumn(rank, (F.col("_n") - 1).cast("long")).drop("_n")


@dataclass(frozen=True)
class Index:
    """One text column of both sides: target postings, their vocabulary, query postings."""

    posts: DataFrame
    vocab: DataFrame
    asked: DataFrame


def field_index(queries: DataFrame, targets: DataFrame, part: str, doc: str, field: str, mode: str = "tokens") -> Index:
    posts = postings(targets, part, doc, field, mode)
    return Index(posts, vocabulary(posts, targets, part), postings(queries, part, doc, field, mode))


def retrieve(queries: DataFrame, targets: DataFrame, channel: Channel, part: str, doc: str, index: Index | None = None) -> DataFrame:
    """(q, t, score, rank) of one channel; a query whose partition has no targets gets nothing.

    Channels of one column can share its index.
    """
    index = index or field_index(queries, targets, part, doc, channel.field, channel.mode)
    return ranked(score_pairs(query_postings(index.asked, index.vocab, channel.df_cap), index.posts), channel.top_k)


def union_candidates(parts: list[DataFrame], top_k: int | None = None) -> DataFrame:
    """(q, t, score, mask, rank): scores add up, bit i is set where part i has the pair; at most eight parts."""
    if len(parts) > 8:
        raise ValueError("a mask has eight bits")
    rows = reduce(DataFrame.unionByName, [p.select("q", "t", "score", F.lit(1 << i).alias("bit")) for i, p in enumerate(parts)])
    return ranked(rows.groupBy("q", "t").agg(F.round(F.sum("score"), 6).alias("score"), F.bit_or("bit").cast("int").alias("mask")), top_k)


def merge_channels(parts: dict[str, DataFrame]) -> DataFrame:
    """One row a pair: s_<channel> and r_<channel> (null if absent), mask, s_sum, r_sum, n_cand, n_channels, s_best."""
    rows = reduce(DataFrame.unionByName, [p.select("q", "t", "score", "rank", F.lit(i).alias("ch"), F.lit(1 << i).alias("bit")) for i, p in enumerate(parts.values())])
    of = lambda i, c: F.max(F.when(F.col("ch") == i, F.col(c)))
    columns = [x for i, n in enumerate(parts) for x in (of(i, "score").alias(f"s_{n}"), of(i, "rank").alias(f"r_{n}"))]
    merged = rows.groupBy("q", "t").agg(*columns, F.bit_or("bit").cast("int").alias("mask"), F.round(F.sum("score"), 6).alias("s_sum"))
    all_of = Window.partitionBy("q")
    return ranked(merged, score="s_sum", rank="r_sum").withColumns({"n_cand": F.count("*").over(all_of), "s_best": F.max("s_sum").over(all_of), "n_channels": F.bit_count("mask").cast("int")})


def cap_merged(merged: DataFrame, cap: int) -> DataFrame:
    """Pairs of union rank below cap; n_cand and s_best stay those of all pairs."""
    return merged.where(F.col("r_sum") < cap)


def extra_pairs(more: DataFrame, base: DataFrame) -> DataFrame:
    """Pairs that base does not have."""
    return more.select("q", "t").join(base.select("q", "t"), ["q", "t"], "left_anti")


def script_group(script: Column) -> Column:
    """latin, indic, mixed or other."""
    return F.when(script.isin("latin", "mixed"), script).when(script.isin("other", "empty"), F.lit("other")).otherwise(F.lit("indic"))


def indic_targets(targets: DataFrame, script: str = "name_script") -> DataFrame:
    """The targets whose names are Indic or mixed: a channel over them has its own document counts."""
    return targets.where(~F.col(script).isin("empty", "latin", "other"))
