"""Where a dataset lies, and what its caches depend on; driver-side only."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinbridge.functions.normalize import normalize_records
from kinbridge.sources import records

VARIABLE = "KINBRIDGE_DATA"
FILES = [f"{split}/{split}_source{n}.tsv" for split in ("train", "test") for n in (1, 2, 3)]
TRUTH_FILE = "train/train_ground_truth.tsv"
EXPECTED = [*FILES, TRUTH_FILE]


def is_dataset(path: str | os.PathLike) -> bool:
    return all((Path(path) / f).is_file() for f in EXPECTED)


def find_data_dir(given: str | None = None, default: str | None = None, search: str | None = None) -> str:
    """The argument, which must be a dataset; else the first dataset of: the environment, the default, folders below ``search``."""
    if given is not None:
        if not is_dataset(given):
            raise FileNotFoundError(f"{given} lacks files of the dataset")
        return str(given)
    for path in (os.environ.get(VARIABLE), default):
        if path and is_dataset(path):
            return str(path)
    if search:
        for path in sorted(Path(search).glob("**/train/train_source1.tsv")):
            if is_dataset(path.parent.parent):
                return str(path.parent.parent)
    raise FileNotFoundError("no folder with the dataset's files was found")


@dataclass(frozen=True)
class Config:
    data_dir: str
    work_dir: str

    def validate(self) -> Config:
        data, work = Path(self.data_dir).resolve(), Path(self.work_dir).resolve()
        if not is_dataset(data):
            raise FileNotFoundError(f"{data} lacks source files")
        if data == work or data in work.parents or work in data.parents:
            raise ValueError("work and data folders must not overlap")
        return self


def code_fingerprint() -> str:
    """Of the normaliser's modules: a cache made by other code is stale."""
    folder = Path(__file__).resolve().parent.parent / "functions"
    return hashlib.sha256(b"".join((folder / f).read_bytes() for f in ("normalize.py", "addresses.py", "rules.py"))).hexdigest()


def source_table(spark: SparkSession, config: Config, split: str, n: int) -> DataFrame:
    """A raw source through its cache."""
    path = f"{config.data_dir}/{split}/{split}_source{n}.tsv"
    return records.build_cache(spark, path, f"{config.work_dir}/raw/{split}{n}", "1", lambda: records.read_source(spark, path, n))


def normalized_table(spark: SparkSession, config: Config, split: str, n: int) -> DataFrame:
    """A normalised source through its cache; a table that lost rows never becomes the cache."""
    path = f"{config.data_dir}/{split}/{split}_source{n}.tsv"
    raw = lambda: source_table(spark, config, split, n)

    def check(out: DataFrame) -> None:
        if out.count() != raw().count():
            raise RuntimeError("the normalised table has not the rows of its source")

    return records.build_cache(spark, path, f"{config.work_dir}/norm/{split}{n}", code_fingerprint(), lambda: normalize_records(raw()), check=check)


def truth_tables(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """Parsed ground truth through caches of its two tables."""
    path = f"{config.data_dir}/{TRUTH_FILE}"
    parsed = lambda: records.parse_truth(records.read_tsv(spark, path, records.TRUTH))
    return tuple(records.build_cache(spark, path, f"{config.work_dir}/truth/{name}", "1", lambda i=i: parsed()[i]) for i, name in enumerate(("s1", "pairs")))


def save_split(split: DataFrame, path: str) -> None:
    split.withColumn("fold", F.col("fold").cast("byte")).write.mode("overwrite").parquet(path)
