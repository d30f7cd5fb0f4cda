"""Evaluation of predicted pairs and of retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_beta(n_pred: Column, n_true: Column, n_hit: Column, beta2: float = 0.25) -> Column:
    """Of one entity: 1 if nothing is predicted and nothing true, 0 if there is no hit."""
    p, r = n_hit.cast("double") / F.nullif(n_pred, F.lit(0)), n_hit.cast("double") / F.nullif(n_true, F.lit(0))
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(n_hit == 0, 0.0).otherwise((1 + beta2) * p * r / (beta2 * p + r))


def f05_from_recall(r: Column) -> Column:
    """F0.5 at precision 1."""
    return F.when(r == 0, 0.0).otherwise(1.25 * r / (0.25 + r))


def evaluate(scores: DataFrame) -> DataFrame:
    """One row of macro figures from per-entity rows (n_pred, n_true, n_hit, f05), to six places."""
    r6 = lambda c, n: F.round(c, 6).alias(n)
    single = F.col("n_true") == 0
    exact = ((F.col("n_pred") == F.col("n_hit")) & (F.col("n_true") == F.col("n_hit"))).cast("double")
    return scores.agg(
        F.count("*").alias("n"), r6(F.avg("f05"), "macro_f05"), r6(F.avg(exact), "exact_set_rate"), F.sum(single.cast("long")).alias("n_singletons"), r6(F.avg(F.when(single, F.col("f05"))), "f05_singletons"),
        r6(F.avg(F.when(~single, F.col("f05"))), "f05_with_match"), r6(F.try_divide(F.sum("n_hit").cast("double"), F.sum("n_pred")), "micro_precision"), r6(F.try_divide(F.sum("n_hit").cast("double"), F.sum("n_true")), "micro_recall"),
        r6(F.avg(F.when(F.col("n_pred") > 0, F.col("n_hit") / F.nullif(F.col("n_pred"), F.lit(0)))), "mean_precision"), r6(F.avg(F.when(~single, F.col("n_hit") / F.nullif(F.col("n_true"), F.lit(0)))), "mean_recall"),
        F.sum("n_pred").alias("total_pred"), F.sum("n_true").alias("total_true"), F.sum("n_hit").alias("total_hit"),
    )


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row of quantiles by index: the value at int(share * n) in ascending order, the last at most.

    Values are counted first, so one place orders distinct values, not rows.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    upto = counts.withColumn("c", F.sum("k").over(Window.orderBy("v"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda s: F.min(F.when(F.col("c") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col("v")))
    return upto.agg(*[at(s).alias(n) for n, s in shares.items()])


def candidate_diagnostics(candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: recall ceiling, best possible F0.5, candidate counts; p95 by index."""
    c = candidates.select("q", "t").distinct()
    hits = c.join(truth.select("q", "t").distinct(), ["q", "t"], "left_semi").groupBy("q").agg(F.count("*").alias("n_hit"))
    n_true = truth.select("q", "t").distinct().groupBy("q").agg(F.count("*").alias("n_true"))
    e = queries.select("q").distinct().join(c.groupBy("q").agg(F.count("*").alias("n_cand")), "q", "left").join(hits, "q", "left").join(n_true, "q", "left").na.fill(0, ["n_cand", "n_hit", "n_true"])
    return diagnostic_figures(e)


def diagnostic_figures(e: DataFrame) -> DataFrame:
    """``candidate_diagnostics`` of (q, n_cand, n_hit, n_true), a row a query."""
    best = F.when(F.col("n_true") == 0, 1.0).otherwise(f05_from_recall(F.col("n_hit") / F.nullif(F.col("n_true"), F.lit(0))))
    one = e.agg(
        F.round(F.try_divide(F.sum("n_hit").cast("double"), F.sum("n_true")), 6).alias("recall_ceiling"), F.round(F.avg(best), 6).alias("oracle_f05"), F.sum("n_cand").alias("total"), F.round(F.avg("n_cand"), 6).alias("mean"),
        F.max("n_cand").alias("max"), F.sum((F.col("n_cand") == 0).cast("long")).alias("none"), F.round(F.percentile("n_cand", F.lit(0.5)), 6).alias("median"),
    )
    return one.crossJoin(nearest_rank(e, "n_cand", {"p95": 0.95}))  # one row each


def truth_ranks(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, t, rank) of every true pair, null if it was not retrieved; raises if truth repeats a pair."""
    once = truth.groupBy("q", "t").agg(F.count("*").alias("n")).withColumn("t", F.when(F.col("n") == 1, F.col("t")).otherwise(F.raise_error(F.lit("truth repeats a pair")).cast("long"))).drop("n")
    return once.join(candidates.groupBy("q", "t").agg(F.min("rank").alias("rank")), ["q", "t"], "left")


def recall_at(ranks: DataFrame, queries: DataFrame, ks: list[int | None], stratum: str | None = None) -> DataFrame:
    """A row for each k (null: all) and stratum of the queries: pair recall, query recall, oracle F0.5, shares of all, any, none."""
    found = ranks.crossJoin(F.broadcast(queries.sparkSession.createDataFrame([(k,) for k in ks], "k int")))  # a fixed list of ks
    per = found.groupBy("k", "q").agg(F.count("*").alias("n_true"), F.sum(F.when(F.col("rank").isNotNull() & (F.col("k").isNull() | (F.col("rank") < F.col("k"))), 1).otherwise(0)).alias("n_hit"))
    return recall_of_hits(per, queries, ks, stratum)


def recall_of_hits(per: DataFrame, queries: DataFrame, ks: list[int | None], stratum: str | None = None) -> DataFrame:
    """``recall_at`` of (k, q, n_true, n_hit), rows only of queries with true pairs."""
    columns = ["q"] + ([stratum] if stratum else [])
    by_k = queries.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    all_q = queries.select(*columns).distinct().crossJoin(F.broadcast(by_k))
    e = all_q.join(per, [all_q["q"] == per["q"], all_q["k"].eqNullSafe(per["k"])], "left").select(all_q["k"], *[all_q[c] for c in columns], F.coalesce("n_true", F.lit(0)).alias("n_true"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"))
    has = F.col("n_true") > 0
    r = F.col("n_hit") / F.nullif(F.col("n_true"), F.lit(0))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return e.groupBy("k", *columns[1:]).agg(
        F.count("*").alias("n_queries"), F.sum("n_true").alias("n_pairs"), r6(F.try_divide(F.sum("n_hit").cast("double"), F.sum("n_true")), "pair_recall"), r6(F.avg(F.when(has, r)), "query_recall"),
        r6(F.avg(F.when(has, f05_from_recall(r)).otherwise(1.0)), "oracle_f05"), r6(F.avg(F.when(has, (F.col("n_hit") == F.col("n_true")).cast("double"))), "share_all"),
        r6(F.avg(F.when(has, (F.col("n_hit") > 0).cast("double"))), "share_any"), r6(F.avg(F.when(has, (F.col("n_hit") == 0).cast("double"))), "share_none"),
    )


def candidate_counts(ranks: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """One row over queries: candidates within the first k (columns q, rank), interpolated quantiles, total, percent without any."""
    kept = ranks if k is None else ranks.where(F.col("rank") < k)
    n = queries.select("q").distinct().join(kept.groupBy("q").agg(F.count("*").alias("n")), "q", "left").na.fill(0, ["n"])
    return count_figures(n)


def count_figures(n: DataFrame) -> DataFrame:
    """``candidate_counts`` of (q, n), a row a query."""
    at = lambda share, name: F.round(F.percentile("n", F.lit(share)), 6).alias(name)
    return n.agg(
        F.round(F.avg("n"), 2).alias("mean"), at(0.5, "median"), at(0.9, "p90"), at(0.95, "p95"), at(0.99, "p99"), F.max("n").alias("max"), F.sum("n").alias("total"),
        F.round(100 * F.avg((F.col("n") == 0).cast("double")), 3).alias("pct_zero"),
    )


def pair_recall_by(ranks: DataFrame, stratum: str, k: int | None = None) -> DataFrame:
    """(stratum, n_pairs, pair_recall) over true pairs with their ranks, null where they were not retrieved."""
    hit = F.col("rank").isNotNull() if k is None else F.coalesce(F.col("rank") < k, F.lit(False))
    return ranks.groupBy(stratum).agg(F.count("*").alias("n_pairs"), F.round(F.avg(hit.cast("double")), 4).alias("pair_recall"))


def warnings(pred: DataFrame, truth_queries: DataFrame, candidates: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(warning, n) of what an evaluation should tell: only warnings with a count.

    unknown_query: predicted queries beyond the truth; unpredicted_query: queries of the truth without a row (rows: q of
    all result lines, also empty ones; by default those with pairs); outside_candidates: queries with a predicted pair
    that is no candidate.
    """
    asked, lines = truth_queries.select("q").distinct(), (rows if rows is not None else pred).select("q").distinct()
    found = {"unknown_query": lines.join(asked, "q", "left_anti"), "unpredicted_query": asked.join(lines, "q", "left_anti")}
    if candidates is not None:
        found["outside_candidates"] = pred.select("q", "t").join(candidates.select("q", "t"), ["q", "t"], "left_anti").select("q").distinct()
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("warning"), "n") for name, df in found.items()]
    return reduce(DataFrame.unionByName, counts).where("n > 0")


def paired_bootstrap(pairs: DataFrame, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """One row from per-entity scores a and b: mean difference, 2.5 and 97.5 percentiles, better, worse and equal shares.

    Differences are counted by value first; each round then draws each value's total weight as a sum of
    unit Poisson draws, so the cost follows distinct differences, not entities.
    """
    import numpy as np
    import pandas as pd

    counts = pairs.select(F.round(F.col("b") - F.col("a"), 9).alias("d")).groupBy("d").agg(F.count("*").alias("n"))

    def draws(frames):
        for f in frames:
            for d, n in zip(f["d"], f["n"], strict=True):
                rng = np.random.default_rng([seed, abs(int(round(d * 1e9))), int(d < 0)])
                w = rng.poisson(float(n), rounds)
                yield pd.DataFrame({"round": np.arange(rounds), "w": w.astype("float64"), "s": w * d})

    sums = counts.mapInPandas(draws, "round int, w double, s double").groupBy("round").agg((F.sum("s") / F.sum("w")).alias("mean"))
    ci = sums.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    n = F.sum("n")
    point = counts.agg((F.sum(F.col("d") * F.col("n")) / n).alias("difference"), (F.sum(F.when(F.col("d") > 0, F.col("n")).otherwise(0)) / n).alias("better"), (F.sum(F.when(F.col("d") < 0, F.col("n")).otherwise(0)) / n).alias("worse"), (F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)) / n).alias("equal"))
    return point.crossJoin(ci)  # one row each
