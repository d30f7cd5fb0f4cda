"""Record sources: strict and tolerant TSV, ground truth, pools, cached Parquet with a freshness manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quotes are literal, every value a string, empty values stay empty; a wrong header or width raises."""
    options = {"sep": "\t", "header": True, "quote": "", "escape": "", "emptyValue": "", "nullValue": "\u0000", "mode": "FAILFAST", "enforceSchema": False}
    return spark.read.schema(schema).options(**options).csv(path).na.fill("")


def read_tsv_tolerant(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Short rows are padded; width tells each row's own number of fields; only a file's first line is its header."""
    whole_lines = {"sep": "\u0001", "header": True, "quote": "", "escape": "", "emptyValue": "", "nullValue": "\u0000", "enforceSchema": True}
    lines = spark.read.schema("value string").options(**whole_lines).csv(path)
    parts = F.split(F.regexp_replace("value", r"\r$", ""), "\t", -1)
    return lines.select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)], F.size(parts).alias("width"))


def chunks(rows: DataFrame, key: str, size: int) -> Iterator[DataFrame]:
    """The rows in ranges of a numeric key, each a filter that reaches the scan; ranges without rows come too."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if low is not None:
        for at in range(low, high + 1, size):
            yield rows.where(F.col(key).between(at, min(high, at + size - 1)))


def with_source(records: DataFrame, source: int) -> DataFrame:
    """Adds source; raises on an id without the source's prefix."""
    ok = F.startswith(F.col("entity_id"), F.lit(f"S{source}-"))
    checked = F.when(ok, F.col("entity_id")).otherwise(F.raise_error(F.concat(F.lit(f"id without prefix S{source}-: "), F.col("entity_id"))))
    return records.withColumn("entity_id", checked).withColumn("source", F.lit(source).cast("byte"))


def read_source(spark: SparkSession, path: str, source: int) -> DataFrame:
    return with_source(read_tsv(spark, path, RECORD), source)


def explode_ids(rows: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, item) of a comma list; items are trimmed, empty ones dropped."""
    return rows.select(id_col, F.explode(F.split(list_col, ",")).alias("item")).select(id_col, F.trim("item").alias("item")).where("item <> ''")


def parse_truth(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source1_entity_id, n_matches) of every row, also without matches; and the pairs with target_source."""
    pairs = explode_ids(raw, "source1_entity_id", "matched_entity_ids").withColumnRenamed("item", "target_entity_id")
    digit = F.regexp_extract("target_entity_id", r"^S([23])-", 1)
    pairs = pairs.withColumn("target_source", F.when(digit != "", digit.cast("byte")).otherwise(F.raise_error(F.concat(F.lit("not a target id: "), F.col("target_entity_id"))).cast("byte")))
    n = pairs.groupBy("source1_entity_id").agg(F.count("*").alias("n_matches"))
    s1 = raw.select("source1_entity_id").join(n, "source1_entity_id", "left").select("source1_entity_id", F.coalesce("n_matches", F.lit(0)).cast("short").alias("n_matches"))
    return s1, pairs


def target_pool(s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Both target sources with row_idx: source 2 before source 3, each in order of file position.

    Needs a column pos; numbers within ranges of pos are made from counts, so no task orders all rows.
    """
    both = s2.unionByName(s3)
    size = 1_000_000
    keyed = both.withColumn("_range", F.floor(F.col("pos") / size))
    counts = keyed.groupBy("source", "_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy().orderBy("source", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    place = F.row_number().over(Window.partitionBy("source", "_range").orderBy("pos"))
    return keyed.withColumn("_n", place).join(starts, ["source", "_range"]).withColumn("row_idx", F.col("_start") + F.col("_n") - 1).drop("_range", "_n", "_start")


# ---- caches

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stamp(spark: SparkSession, path: str) -> list[int]:
    """Total size and last change of a file or folder, in any store that Spark reads."""
    fs, p = _fs(spark, path)
    status = fs.getFileStatus(p)
    files = [status] if status.isFile() else [f for f in fs.listStatus(p) if f.isFile()]
    return [sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)]


def is_fresh(spark: SparkSession, source: str, cache: str, version: str) -> bool:
    """The cache is whole and was made of this source by this version."""
    fs, manifest = _fs(spark, f"{cache}/_manifest")
    if not fs.exists(manifest) or not fs.exists(_fs(spark, f"{cache}/data/_SUCCESS")[1]):
        return False
    about = json.loads(spark.read.text(f"{cache}/_manifest").first()[0])
    return about == {"stamp": stamp(spark, source), "version": version}


def build_cache(spark: SparkSession, source: str, cache: str, version: str, load: Callable[[], DataFrame], force: bool = False, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """The cached table, built anew if the source, the version or the cache changed; refuses a source that changes meanwhile.

    The table is written aside and checked; only then the old manifest goes, the new table takes the old one's
    place and the new manifest follows, so what has a manifest is whole.
    """
    if force or not is_fresh(spark, source, cache, version):
        before = stamp(spark, source)
        fs, aside = _fs(spark, f"{cache}/_aside-{uuid.uuid4().hex}")
        try:
            load().write.option("compression", "zstd").parquet(aside.toString())
            if stamp(spark, source) != before:
                raise RuntimeError("the source changed while it was cached")
            if check:
                check(spark.read.parquet(aside.toString()))
            manifest, data = (_fs(spark, f"{cache}/{n}")[1] for n in ("_manifest", "data"))
            fs.delete(manifest, True)
            fs.delete(data, True)
            if not fs.rename(aside, data):
                raise RuntimeError(f"{aside} cannot take the place of {data}")
        finally:
            fs.delete(aside, True)
        spark.createDataFrame([(json.dumps({"stamp": before, "version": version}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{cache}/_manifest")
    return spark.read.parquet(f"{cache}/data")


def read_cache(spark: SparkSession, source: str, cache: str, version: str, columns: list[str] | None = None) -> DataFrame:
    """The cached table or an error if it is stale."""
    if not is_fresh(spark, source, cache, version):
        raise RuntimeError(f"{cache} is stale")
    rows = spark.read.parquet(f"{cache}/data")
    return rows.select(*columns) if columns else rows


def write_checkpoint(rows: DataFrame, path: str, block: str) -> None:
    """Blocks as partitions; only those written now are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(block).parquet(path)


def pending_blocks(plan: DataFrame, spark: SparkSession, path: str, block: str) -> DataFrame:
    """The rows of a plan whose blocks have no checkpoint yet."""
    fs, blocks = _fs(spark, f"{path}/{block}=*")
    if not fs.globStatus(blocks):
        return plan
    done = spark.read.parquet(path).select(F.col(block).cast(plan.schema[block].dataType)).distinct()
    return plan.join(done, block, "left_anti")
