"""Buckets, folds, stratified subsets, holdouts and negative sampling: all by keyed hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinbridge.functions.hashing import md5_key, uniform


def match_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")


def placed(rows: DataFrame, part: str, within: Column, order: list[str]) -> DataFrame:
    """Adds _n: the place from 1 of a row in its part, where ``within`` is a range that rises with the order.

    Rows are ordered within ranges and the ranges' counts added up, so no task orders a whole part.
    """
    keyed = rows.withColumn("_range", within)
    counts = keyed.groupBy(part, "_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(part).alias("_part"), F.col("_range").alias("_r"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(part, "_range").orderBy(*order))
    out = keyed.withColumn("_n", own).join(starts, F.col(part).eqNullSafe(F.col("_part")) & F.col("_range").eqNullSafe(F.col("_r")))
    return out.withColumn("_n", F.col("_n") + F.col("_start")).drop("_range", "_part", "_r", "_start")


def assign_folds(rows: DataFrame, key: str, stratum: str, folds: int, seed: str, hashed: Column | None = None) -> DataFrame:
    """Adds fold: rows of a stratum in order of hash and key, dealt in turn."""
    h = md5_key(F.col(key), seed) if hashed is None else hashed
    out = placed(rows.withColumn("_h", h), stratum, F.substring("_h", 1, 3), ["_h", key])
    return out.withColumn("fold", ((F.col("_n") - 1) % folds).cast("int")).drop("_h", "_n")


def stratified_subset(rows: DataFrame, key: str, stratum: str, n: int, seed: str) -> DataFrame:
    """n rows: each stratum's share by largest remainder (ties to the earlier label), its least hashes first."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    whole = Window.partitionBy()  # a row a stratum
    quota = sizes.withColumn("exact", F.lit(float(n)) * F.col("size") / F.sum("size").over(whole)).withColumn("base", F.floor("exact"))
    order = Window.partitionBy().orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), stratum)
    left = F.lit(n) - F.sum("base").over(whole)
    quota = quota.withColumn("quota", F.col("base") + (F.row_number().over(order) <= left).cast("long")).select(stratum, "quota")
    ranked = placed(rows.withColumn("_h", md5_key(F.col(key), f"{seed}-subset")), stratum, F.substring("_h", 1, 3), ["_h", key])
    return ranked.join(quota, stratum).where("_n <= quota").drop("_h", "_n", "quota")


def holdout(key: Column, share: float, seed: str) -> Column:
    """True for a share of keys."""
    return F.conv(F.substring(md5_key(key, seed), 1, 8), 16, 10).cast("long") % 10_000 < int(round(share * 10_000))


def sample_negatives(pairs: DataFrame, seed: str, near: int = 200, near_rate: float = 0.05, far_rate: float = 0.005) -> DataFrame:
    """All positives (label 1); of the others a share by rank r_sum, weighted by its inverse."""
    rate = F.when(F.col("label") == 1, 1.0).when(F.col("r_sum") < near, near_rate).otherwise(far_rate)
    u = uniform(F.concat_ws(":", F.col("q"), F.col("t")), seed)
    return pairs.withColumn("_rate", rate).where((F.col("label") == 1) | (u < F.col("_rate"))).withColumn("weight", F.round(1 / F.col("_rate"), 6)).drop("_rate")


def build_train_split(queries: DataFrame, truth_counts: DataFrame, folds: int, seed: str) -> DataFrame:
    """Queries (q, country) with n_matches, bucket, stratum and fold; raises if one lacks a truth row."""
    joined = queries.join(truth_counts.select("q", "n_matches"), "q", "left")
    n = F.when(F.col("n_matches").isNotNull(), F.col("n_matches")).otherwise(F.raise_error(F.lit("a query lacks its truth row")).cast("long"))
    out = joined.withColumn("n_matches", n).withColumn("bucket", match_bucket(F.col("n_matches"))).withColumn("stratum", F.concat_ws("|", "country", "bucket"))
    return assign_folds(out, "q", "stratum", folds, seed)


def deterministic_sample(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """The n rows of the least keyed hashes."""
    return rows.orderBy(md5_key(F.col(key), seed), key).limit(n)


def block_plan(rows: DataFrame, part: str, key: str, size: int, width: int = 1_000_000) -> DataFrame:
    """Adds block: rows of a partition in order of a numeric key, in blocks of a size; keys are ordered in ranges of a width."""
    out = placed(rows, part, F.floor(F.col(key) / width), [key])
    return out.withColumn("block", F.floor((F.col("_n") - 1) / size).cast("int")).drop("_n")
