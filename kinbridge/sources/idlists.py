"""Result files: one line an entity with its comma list of ids; writer, tolerant reader, validator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinbridge.sources.records import explode_ids


def id_lists(pairs: DataFrame, entities: DataFrame, id_col: str, target: str, order: str | None = None) -> DataFrame:
    """(id, ids): every entity once, its targets in order, an empty list allowed."""
    item = F.struct(F.col(order or target).alias("o"), F.col(target).cast("string").alias("v"))
    lists = pairs.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), ",").alias("ids"))
    return entities.select(id_col).distinct().join(lists, id_col, "left").select(id_col, F.coalesce("ids", F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str, id_col: str, header: tuple[str, str], single: bool = False) -> None:
    """Range-sorted text parts, each with the header as its first line; single makes one part, for small results."""
    rows = lists.select(F.col(id_col).cast("string").alias(header[0]), F.col("ids").alias(header[1])).orderBy(header[0])
    (rows.coalesce(1) if single else rows).write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="").csv(path)


def read_id_lists(spark: SparkSession, path: str, header: tuple[str, str]) -> DataFrame:
    """(id, ids): marks, line ends, blank lines, quotes and trailing commas are forgiven; repeated rows are merged."""
    line = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\r$", "")
    lines = spark.read.text(path).select(line.alias("line")).where((F.trim("line") != "") & (F.col("line") != "\t".join(header)))
    parts = F.split("line", "\t", 2)
    plain = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("")))
    rows = lines.select(plain(F.get(parts, F.lit(0))).alias("id"), plain(F.get(parts, F.lit(1))).alias("list"))
    items = explode_ids(rows, "id", "list").groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    return rows.select("id").distinct().join(items, "id", "left").select("id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def repairs(lines: DataFrame, header: tuple[str, str]) -> DataFrame:
    """(warning, n) of what ``read_id_lists`` forgives in lines (column value): only warnings with a count.

    no_tab: lines without a tab, read as empty lists; repeated_row: ids of several lines, which are merged;
    repeated_id: ids that a list holds more than once.
    """
    line = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), r"\r$", "")
    body = lines.select(line.alias("line")).where((F.trim("line") != "") & (F.col("line") != "\t".join(header)))
    parts = F.split("line", "\t", 2)
    plain = lambda c: F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit("")))
    items = F.filter(F.transform(F.split(plain(F.get(parts, F.lit(1))), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = body.select(plain(F.get(parts, F.lit(0))).alias("id"), (F.size(parts) == 1).alias("bare"), (F.size(items) - F.size(F.array_distinct(items))).alias("again"))
    once = rows.agg(F.sum(F.col("bare").cast("long")).alias("no_tab"), F.sum((F.col("again") > 0).cast("long")).alias("repeated_id"))
    merged = rows.groupBy("id").agg(F.count("*").alias("k")).agg(F.sum((F.col("k") > 1).cast("long")).alias("repeated_row"))
    both = once.crossJoin(merged)  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("warning"), F.col(c).alias("n")) for c in ("no_tab", "repeated_id", "repeated_row")])).alias("w")).select("w.*").where("n > 0")


def validate(lines: DataFrame, entities: DataFrame, header: tuple[str, str], known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-")) -> DataFrame:
    """(rule, n, examples): what is wrong in the lines (column value) of a result file; up to five examples.

    Rules: header, csv, width, repeated_row, repeated_id, self_match, bad_prefix, unknown_id (if known is
    given), missing, extra.  A file without a fault gives no row.
    """
    head = "\t".join(header)
    body = lines.where(F.col("value") != head)
    parts = F.split("value", "\t", -1)
    rows = body.select("value", F.size(parts).alias("w"), F.get(parts, F.lit(0)).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("list"))
    items = rows.where("w = 2").select("id", F.explode(F.split("list", ",", -1)).alias("item")).where("item <> ''")
    prefix_ok = F.lit(False)
    for p in prefixes:
        prefix_ok = prefix_ok | F.startswith("item", F.lit(p))
    entity = entities.select(F.col(entities.columns[0]).cast("string").alias("id")).distinct()
    fault = lambda df, rule, what: df.select(F.lit(rule).alias("rule"), F.col(what).cast("string").alias("what"))
    has_head = lines.where(F.col("value") == head).agg(F.count("*").alias("k")).where("k <> 1").withColumn("what", F.concat(F.lit("header lines: "), F.col("k")))
    out = [
        fault(has_head, "header", "what"), fault(rows.where((F.col("w") == 1) & F.contains(F.col("value"), F.lit(","))), "csv", "value"), fault(rows.where("w <> 2"), "width", "value"),
        fault(rows.groupBy("id").count().where("count > 1"), "repeated_row", "id"), fault(items.groupBy("id", "item").count().where("count > 1"), "repeated_id", "item"), fault(items.where("id = item"), "self_match", "id"),
        fault(items.where(~prefix_ok), "bad_prefix", "item"), fault(entity.join(rows, "id", "left_anti"), "missing", "id"), fault(rows.where("w = 2").select("id").distinct().join(entity, "id", "left_anti"), "extra", "id"),
    ]
    if known is not None:
        out.append(fault(items.select("item").distinct().join(known.select(F.col(known.columns[0]).cast("string").alias("item")), "item", "left_anti"), "unknown_id", "item"))
    faults = out[0]
    for f in out[1:]:
        faults = faults.unionByName(f)
    # a bounded number of examples a rule: five least by rank, never a list of all
    ranked = faults.withColumn("_n", F.row_number().over(Window.partitionBy("rule").orderBy("what"))).where("_n <= 5").groupBy("rule").agg(F.array_sort(F.collect_list("what")).alias("examples"))
    return faults.groupBy("rule").agg(F.count("*").alias("n")).join(ranked, "rule")
