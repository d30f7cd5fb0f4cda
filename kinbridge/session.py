"""What a session needs before Python functions run on its executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_spooled: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where Python functions are looked up by module, once a context.

    Also sets the rows of an Arrow batch for the session.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kinbridge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kinbridge-")) / "kinbridge.zip"  # served by the driver
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))
    # texts of a batch are in a Python worker's memory at once
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc._kinbridge_shipped = True


def spool(df: DataFrame, name: str, folders: list[str] | None = None) -> str:
    """Write df as Parquet below spark.checkpoint.dir, which all executors share; the path is deleted when the process ends.

    Without that setting a cluster gets an error; a local session gets a folder of its own.
    """
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{(root or 'file:///tmp/checkpoints/kinbridge').rstrip('/')}/kinbridge-{name}-{uuid.uuid4().hex}"
    if not _spooled:
        atexit.register(_clean)
    _spooled.append((spark, path))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*folders) if folders else writer).parquet(path)
    spark.sparkContext._jvm.System.gc()  # upon which Spark deletes the shuffle files behind it
    return path


def _clean() -> None:
    for spark, path in _spooled:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may already be gone
            return
