"""The linking plan: retrieval channels, merge, cap, ranking, matching, one query a target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.operators import byquery
from kinbridge.operators import decide as d
from kinbridge.operators import features as f
from kinbridge.operators import models
from kinbridge.operators import retrieve as r
from kinbridge.operators import walkfeatures as w
from kinbridge.operators.metrics import recall_at, truth_ranks


@dataclass(frozen=True)
class LinkPlan:
    """Channels and limits of one linking run, and the records' text columns."""

    channels: tuple[r.Channel, ...]
    part: str = "country"
    key: str = "row_idx"
    cap: int = 1000
    top_k: int = 200
    threshold: float = 0.66
    name: str = "name_fold"
    address: str = "address_norm"
    key_field: str = "name_key"

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.channels]


Indexes = dict[tuple[str, str], r.Index]


def indexes(plan: LinkPlan, queries: DataFrame, targets: DataFrame) -> Indexes:
    """Each text column once, for all channels and statistics; equal plans let Spark reuse their exchanges."""
    wanted = dict.fromkeys([*((c.field, c.mode) for c in plan.channels), (plan.name, "tokens"), (plan.address, "tokens"), (plan.key_field, "key")])
    return {k: r.field_index(queries, targets, plan.part, plan.key, *k) for k in wanted}


def candidates(plan: LinkPlan, queries: DataFrame, targets: DataFrame, index: Indexes | None = None) -> DataFrame:
    """Merged and capped candidates of all channels."""
    index = index or indexes(plan, queries, targets)
    found = {c.name: r.retrieve(queries, targets, c, plan.part, plan.key, index[c.field, c.mode]) for c in plan.channels}
    return r.cap_merged(r.merge_channels(found), plan.cap)


def statistics(plan: LinkPlan, queries: DataFrame, targets: DataFrame, index: Indexes) -> tuple[DataFrame, DataFrame]:
    """What the features need of each query and of each target."""
    masses = {c.name: ((c.field, c.mode), c.df_cap) for c in plan.channels}
    vocabs = {k: i.vocab for k, i in index.items()}
    side = lambda records, which: f.side_statistics(records, {k: getattr(i, which) for k, i in index.items()}, vocabs, masses, plan.name, plan.address, plan.key_field, plan.key)
    return side(queries, "asked"), side(targets, "posts")


def pair_features(plan: LinkPlan, queries: DataFrame, targets: DataFrame, pairs: DataFrame, index: Indexes | None = None) -> DataFrame:
    """The pairs with all stage-1 features."""
    return f.stage1_features(pairs, plan.names, *statistics(plan, queries, targets, index or indexes(plan, queries, targets)))


def walks(plan: LinkPlan, queries: DataFrame, targets: DataFrame) -> bool:
    """Whether ``walked_stage1`` can take the records: no channel has a top-K, and ids are unique longs."""
    return all(c.top_k is None for c in plan.channels) and byquery.can(queries, targets, plan.key)


def _walked(plan: LinkPlan, queries: DataFrame, targets: DataFrame, kind: tuple, more: tuple[str, ...]) -> DataFrame:
    asked, known = statistics(plan, queries, targets, indexes(plan, queries, targets))
    # a task has queries of few parts, so it reads few lists; records are small, so only a number keeps them apart
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = w.with_statistics(queries, asked, plan.names, plan.key).repartition(n, plan.part, F.pmod(F.xxhash64(plan.key), F.lit(max(1, n // 4))))
    return byquery.by_query(asked, w.with_statistics(targets, known, plan.names, plan.key), list(plan.channels), plan.part, plan.key, *kind, more=more)


def walked_stage1(plan: LinkPlan, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``pair_features`` of ``candidates``, each pair made in the task of its query."""
    return _walked(plan, queries, targets, w.stage1(plan.names, plan.cap), w.stage1_columns(plan.names))


def walked_stage2(plan: LinkPlan, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """``stage2_features`` where the union score is the ranker's: (q, t, all its columns), texts scored in the task of the query."""
    return _walked(plan, queries, targets, w.stage2(plan.names, plan.cap, plan.top_k), (*w.stage1_columns(plan.names), *w.STAGE2_COLUMNS))


def link(plan: LinkPlan, queries: DataFrame, targets: DataFrame, stage1, stage2, stage1_inputs: list[str] | None = None, stage2_inputs: list[str] | None = None) -> DataFrame:
    """(q, t, p) of the accepted pairs: both models applied, texts joined only to what the first one keeps."""
    index = indexes(plan, queries, targets)
    pairs = pair_features(plan, queries, targets, candidates(plan, queries, targets, index), index)
    ranked = models.score(stage1, pairs, stage1_inputs or f.stage1_names(plan.names), "s1_score", "_p1").withColumn("s1_score", F.round("s1_score", 6))
    full = stage2_features(plan, queries, targets, ranked)
    scored = models.score(stage2, full, stage2_inputs or f.stage2_names(plan.names))
    return d.decide(scored.withColumn("p", F.round("p", 6)), plan.threshold).select("q", "t", "p")


def stage2_features(plan: LinkPlan, queries: DataFrame, targets: DataFrame, scored: DataFrame) -> DataFrame:
    """The first top_k pairs of each query by s1_score, with all stage-2 features."""
    kept = f.rank_context(r.ranked(scored, plan.top_k, "s1_score", "_r").drop("_r"))
    return f.string_features(kept, queries, targets, plan.key)


def study(plan: LinkPlan, queries: DataFrame, targets: DataFrame, truth: DataFrame, ks: list[int | None], unions: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(strategy, k, ...) recall figures of every channel and union over one pass of the channels."""
    found = {c.name: r.retrieve(queries, targets, c, plan.part, plan.key).persist() for c in plan.channels}
    q = queries.select(F.col(plan.key).alias("q"))
    out = None
    for name, members in ({n: (n,) for n in found} | (unions or {"all": tuple(found)})).items():
        union = r.union_candidates([found[m] for m in members])
        rows = recall_at(truth_ranks(union, truth), q, ks).withColumn("strategy", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
