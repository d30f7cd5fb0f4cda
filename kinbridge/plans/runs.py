"""Runs over blocks of queries: resumable scoring, rescoring of stored pairs, comparison, assembly, timings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinbridge.operators import decide, models
from kinbridge.sources import records

#: Rows of a plan (q, block) to their scored pairs (q, t, p, block).
Score = Callable[[DataFrame], DataFrame]


@dataclass
class Report:
    """What a range of blocks took and how it differs from another run."""

    groups: int = 0
    stopped: bool = False
    seconds: dict[str, float] = field(default_factory=dict)
    largest: float = 0.0
    unmatched: int = 0

    def timed(self, phase: str, action: Callable[[], object]) -> object:
        began = time.monotonic()
        try:
            return action()
        finally:
            self.seconds[phase] = self.seconds.get(phase, 0.0) + time.monotonic() - began


def claim(spark: SparkSession, path: str, about: dict) -> None:
    """Marks a run's folder with its description; refuses a folder that a run of another description marked."""
    fs, mark = records._fs(spark, f"{path}/_about")
    text = json.dumps(about, sort_keys=True)
    if not fs.exists(mark):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(mark.toString())
    elif spark.read.text(mark.toString()).first()[0] != text:
        raise RuntimeError(f"{path} holds a run of another description")


def light_index(queries: DataFrame, targets: DataFrame, key: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """What assembly reads: ids and countries of both sides, and the targets' sources; no text is read."""
    return queries.select(F.col(key).alias("q"), "entity_id", "country"), targets.select(F.col(key).alias("t"), "entity_id", "country", "source")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: pairs of both runs, pairs of one run only, and the largest difference of p."""
    both = a.select("q", "t", F.col("p").alias("x")).join(b.select("q", "t", F.col("p").alias("y")), ["q", "t"], "full")
    return difference_of(both.withColumn("n", F.lit(1)))


def difference_of(both: DataFrame) -> DataFrame:
    """``difference`` of rows (x, y, n): n pairs with these figures, null where a run lacks them."""
    alone = F.col("x").isNull() | F.col("y").isNull()
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n")).otherwise(0)), F.sum(F.lit(0))).cast("long")
    return both.agg(count(~alone).alias("n_both"), count(alone).alias("n_one"), F.round(F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)), 6).alias("largest"))


def run_range(plan: DataFrame, path: str, score: Score, start: int = 0, stop: int | None = None, at_once: int = 64, seconds: float | None = None, reference: str | None = None) -> Report:
    """Scores the blocks from start to stop that have no checkpoint below path yet, ``at_once`` blocks to a job.

    plan: (q, block), blocks numbered from 0.  After ``seconds`` no new job begins.  With a reference run's
    path, each job's pairs are compared with its.
    """
    spark, report, began = plan.sparkSession, Report(), time.monotonic()
    if stop is None:
        stop = (plan.agg(F.max("block")).first()[0] or 0) + 1
    for low in range(start, stop, at_once):
        inside = F.col("block").between(low, min(low + at_once, stop) - 1)
        part = records.pending_blocks(plan.where(inside), spark, path, "block")
        if report.timed("plan", part.isEmpty):
            continue
        if seconds is not None and time.monotonic() - began > seconds:
            report.stopped = True
            break
        report.timed("score", lambda part=part: records.write_checkpoint(score(part), path, "block"))
        report.groups += 1
        if reference is not None:
            own, other = (spark.read.parquet(p).where(inside) for p in (path, reference))
            row = report.timed("compare", lambda own=own, other=other: difference(own, other).first())
            report.largest, report.unmatched = max(report.largest, row["largest"]), report.unmatched + (row["n_one"] or 0)
    return report


def rescorer(reference: str, features: Callable[[DataFrame], DataFrame], stage2: PipelineModel, inputs: list[str]) -> Score:
    """Another matcher over a run's stored pairs: ``features`` adds the inputs to (q, t, block)."""

    def score(part: DataFrame) -> DataFrame:
        stored = part.sparkSession.read.parquet(reference).select("q", "t", "block").join(part.select("q").distinct(), "q", "left_semi")
        return models.score(stage2, features(stored), inputs).select("q", "t", F.round("p", 6).alias("p"), "block")

    return score


def assemble_run(plan: DataFrame, path: str, threshold: float, partial: bool = False) -> DataFrame:
    """(q, matches, candidates) of every query of the plan; all blocks must be there unless partial."""
    spark = plan.sparkSession
    if not partial and not records.pending_blocks(plan, spark, path, "block").isEmpty():
        raise RuntimeError(f"{path} lacks blocks of the plan")
    return decide.finalize(spark.read.parquet(path).select("q", "t", "p"), plan.select("q"), threshold)
