"""Shared folder, row keys and Arrow batching used by the operators of this subpackage.

Row identity.  A document is a (doc_id, text) pair: rows that repeat both are one document listed
twice and get equal results; rows that share only the id are told apart by 64 bits of the text's hash.
Documents whose id is null have no id to share: they go by 127 bits of their text's hash.  Ids may be of
any type that sorts.  Null ids come before all ids from 0 on, in order of their hashes.  A null text is
an empty text.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinbridge.session import ship

#: The highest bit: it is set in the keys of documents without an id.
NULL_ID = -(2**63)
#: A run's place in its text is one long: unit offset (31 bits), window count (11 bits).
START_BITS, COUNT_BITS = 31, 11
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, as in tests, one of our own.

    On a cluster a folder of our own would be each machine's, so there the setting must be there.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (root or "file:///tmp/checkpoints/kinbridge").rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the session's process ends."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_root(spark)}/kinbridge-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may already be gone
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Ends the lineage (a lost executor costs at most its own tasks), lets several consumers share one
    computation, and frees the shuffle files behind it: the JVM is asked to collect, upon which Spark's
    cleaner deletes shuffles that no live plan refers to.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    schema = df.schema
    del df, writer
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._kinbridge_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` has written for df; nothing may read it any more."""
    drop_path(df.sparkSession, df._kinbridge_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(col: str = "text") -> Column:
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def text_hash(col: str = "text", *salt: int) -> Column:
    """64 bits of the text's hash; a null text is empty."""
    return F.xxhash64(*map(F.lit, salt), F.coalesce(F.col(col).cast("string"), F.lit("")))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", d: str = "d", tag: str = "tag") -> DataFrame:
    """Adds the two longs that name a document: d, in order of the ids, and tag.

    Ids that are no whole numbers are numbered in their order; the numbers are written to the shared folder.
    """
    nameless = text_hash(text_col, 1).bitwiseOR(F.lit(NULL_ID))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        number = F.col(id_col).cast("long")
    else:
        ids = docs.select(F.col(id_col).alias("__kb_id")).where("__kb_id is not null").distinct()
        numbers = ids.repartitionByRange("__kb_id").sortWithinPartitions("__kb_id").withColumn("__kb_n", F.monotonically_increasing_id())
        docs = docs.join(cut(numbers, "ids"), F.col(id_col) == F.col("__kb_id"), "left")
        number = F.col("__kb_n")
    return docs.withColumns({d: F.when(F.col(id_col).isNotNull(), number).otherwise(nameless), tag: text_hash(text_col)}).drop("__kb_id", "__kb_n")


def shingle_places(words: list[bytes], shingle: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, and where its shingles start and end; fewer words are one shingle."""
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    return b" ".join(words), starts[:n], (starts + sizes - 1)[min(shingle, len(words)) - 1 :]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to at most ``most``, one row at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts add up to at most ``most`` bytes, one row at least."""
    for batch in batches:
        for lo, hi in slices(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist(), most):
            yield batch.slice(lo, hi - lo)
