import numpy as np
import pytest
from pyspark.sql import functions as F

from kinbridge import queries
from kinbridge.operators import byquery, decide, features, retrieve

SF = "/root/testdata/sf0.001"
#: Queries whose pairs stay in the task of their query.
WALKED = ["compare_channel", "pair_labels", "best_per_target", "candidate_counts", "candidate_diagnostics", "decide_threshold", "evaluate_macro", "f_beta", "score_decision", "evaluate_predicted", "evaluation_warnings", "feature_stats", "final_summary", "finalize_lists", "hybrid_assembly", "paired_bootstrap", "recall_at_k", "pair_recall_by_source", "partial_assembly", "recall_by_stratum", "run_difference"]
ROWS = [
    (0, "x", "a b c"), (2, "x", "a b"), (4, "x", ""), (6, "y", "a"), (8, None, "a b"), (10, "x", None), (12, "z", "a"), (14, "x", "c c d"),
    (1, "x", "b a c"), (3, "x", "a b c"), (5, "x", "d"), (7, "x", ""), (9, "y", "b"), (11, None, "a b"), (13, "x", None), (2**40 + 1, "x", "a b"),
]
CHANNELS = [retrieve.Channel("name", "txt", df_cap=3), retrieve.Channel("key", "txt", mode="key", df_cap=None)]


@pytest.fixture(scope="module")
def sides(spark):
    df = spark.createDataFrame(ROWS, "id long, part string, txt string")
    return df.where("id % 2 = 0"), df.where("id % 2 = 1")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pairs_equal_those_of_joins(sides):
    q, t = sides
    merged = retrieve.merge_channels({c.name: retrieve.retrieve(q, t, c, "part", "id") for c in CHANNELS})
    p = features.union_features(merged).select("q", "t", F.col("s_rel").alias("p"))
    found = byquery.by_query(q, t, CHANNELS, "part", "id", *byquery.relative())
    assert rows(found) == rows(p) and found.count() > 5
    assert rows(byquery.best_per_target(q, t, CHANNELS, "part", "id").select("q", "t", "p", "best")) == rows(decide.best_per_target(p))
    assert rows(byquery.by_query(q, t, CHANNELS, "part", "id", *byquery.relative(0.7))) == rows(p.where("p >= 0.7"))


def test_truth_and_ranks(sides):
    q, t = sides
    name = retrieve.retrieve(q, t, CHANNELS[0], "part", "id")
    truth = q.select("part", "txt", F.col("id").alias("q")).join(t.select("part", "txt", F.col("id").alias("t")), ["part", "txt"]).select("q", "t")
    found = byquery.by_query(q, t, CHANNELS[:1], "part", "id", *byquery.true_ranks(), truth="txt")
    assert rows(found) == rows(truth.join(name, ["q", "t"], "left").select("q", "t", F.coalesce("rank", F.lit(-1))))
    assert rows(byquery.by_query(q, t, CHANNELS[:1], "part", "id", *byquery.labelled(), truth="txt")) == rows(features.labels(name, truth).select("q", "t", "label"))


def test_records_of_several_rows_are_refused(spark, sides):
    q, t = sides
    assert byquery.can(q, t, "id")
    assert not byquery.can(q.union(q), t, "id") and not byquery.can(q, t.withColumn("id", F.lit(None).cast("long")), "id")
    assert not byquery.can(q.withColumn("id", F.col("id").cast("string")), t, "id")


def test_no_targets(sides):
    q, t = sides
    assert byquery.by_query(q, t.where("false"), CHANNELS, "part", "id", *byquery.relative()).count() == 0
    assert byquery.by_query(q.where("false"), t, CHANNELS, "part", "id", *byquery.counts()).count() == 0


@pytest.mark.parametrize("name", WALKED)
def test_pairs_are_not_shuffled(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "token#" not in plan


def test_entity_counts_equal_those_of_joins(sides):
    q, t = sides
    truth = q.select("part", "txt", F.col("id").alias("q")).join(t.select("part", "txt", F.col("id").alias("t")), ["part", "txt"]).select("q", "t")
    p = byquery.by_query(q, t, CHANNELS, "part", "id", *byquery.relative())
    for least in (0.0, 0.6, 1.0):
        want = decide.entity_scores(decide.decide(p, least), truth, q.select(F.col("id").alias("q"))).drop("f05")
        for parts in (1, 5):
            found = byquery.entity_counts(q.repartition(parts), t, CHANNELS, "part", "id", "txt", least)
            assert rows(found) == rows(want) and found.columns == want.columns


@pytest.mark.parametrize("name", ["f_beta", "evaluate_macro", "score_decision"])
def test_scores_do_not_shuffle_pairs_or_join_the_truth(spark, name):
    """A task gives a row a target: no window over pairs, no full join of accepted and true pairs."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "FullOuter" not in plan


def pairs_of(ids, found):
    """Pairs by hand; found: of each query its targets and their scores."""
    return [byquery.Pairs(q, ids, np.searchsorted(ids, t), np.array([s], float), np.empty(0, np.int64)) for q, t, s in found]


def test_a_task_gives_a_row_a_target_though_it_comes_back_to_a_part():
    """Lists are read again for further queries, so the same targets come as another array."""
    first, other, again = np.array([1, 3, 5]), np.array([7]), np.array([1, 3, 5])
    pairs = pairs_of(first, [(4, [1, 3], [2e6, 1e6])]) + pairs_of(other, [(6, [7], [1e6])]) + pairs_of(again, [(2, [1], [1e6]), (8, [3, 5], [3e6, 1e6]), (0, [], [])])
    found = [r for x in byquery.best_of_task()[0](iter(pairs)) for r in zip(*(x[c].tolist() for c in "tpq"), strict=True)]
    assert sorted(found) == [(1, 1.0, 2), (3, 1.0, 8), (5, 0.333333, 8), (7, 1.0, 6)]


def test_tasks_that_look_for_the_best_follow_the_cores(spark, sides, monkeypatch):
    q, t = sides
    plans, put = [], byquery.spool
    monkeypatch.setattr(byquery, "spool", lambda df, name, *more: (plans.append((name, df)), put(df, name, *more))[1])
    many = 9 * byquery.WAVES * spark.sparkContext.defaultParallelism
    found = byquery.best_per_target(q.repartition(many), t, CHANNELS, "part", "id")
    plan = dict(plans)["owners"]._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {many // 9}, false" in plan
    assert rows(found) == rows(byquery.best_per_target(q, t, CHANNELS, "part", "id"))


@pytest.mark.parametrize("most", [3, 4, 1 << 21])
def test_pairs_are_returned_by_p(spark, sides, monkeypatch, most):
    """Up to so many at once, also where they end inside a query."""
    q, t = sides
    want = rows(byquery.best_per_target(q, t, CHANNELS, "part", "id"))
    path = byquery.spool(spark.createDataFrame([(1, 4), (3, 2), (7, 6)], "t long, q long"), "owners")
    pairs = pairs_of(np.array([1, 3, 5]), [(2, [1, 3, 5], [2e6, 4e6, 1e6]), (4, [1, 3], [4e6, 1e6])]) + pairs_of(np.array([7]), [(6, [7], [1e6])])
    monkeypatch.setattr(byquery, "SORTED", most)
    found = [list(zip(*(x[c].tolist() for c in ("q", "t", "p", "best")), strict=True)) for x in byquery.owned(path)[0](iter(pairs))]
    assert all([r[2] for r in x] == sorted(r[2] for r in x) for x in found)
    assert sorted(r for x in found for r in x) == [(2, 1, 0.5, False), (2, 3, 1.0, True), (2, 5, 0.25, False), (4, 1, 1.0, True), (4, 3, 0.25, False), (6, 7, 1.0, True)]
    assert max(map(len, found)) <= most and rows(byquery.best_per_target(q, t, CHANNELS, "part", "id")) == want
