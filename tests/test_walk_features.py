from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kinbridge import queries
from kinbridge.operators import features, retrieve
from kinbridge.plans import link

SF = "/root/testdata/sf0.001"
PLAN = replace(queries.PART_PLAN, cap=3, top_k=2)
NAMES = ["red fox ltd", "red fox", "fox", "", None, "blue fox ltd", "red hen", "red fox ltd", "hen"]


@pytest.fixture(scope="module")
def sides(spark):
    """Empty and null texts, a null part, a part without targets, equal records, words that only queries have."""
    rows = []
    for i in range(60):
        name, part = NAMES[i * 7 % 9], ["x", "x", "x", "y", None][i * 3 % 5] if i != 58 else "z"
        rows.append((i, part, name, name.split(" ")[-1] if name else name, " ".join(sorted(set(name.split()))) if name is not None else None, ["steel box", "", None, "tin box", f"only {i}"][i % 5], ["7", "", None][i % 3],
                     ["", "ltd", None, "gmbh"][i % 4], ["latin", "other", None][i % 3], [True, False, None][i % 3], ["12 3", "12", "", None, "5"][i * 3 % 5], ["", "1", None][i % 3], ["9", f"{i}", None][i % 3], 2 + i % 2))
    df = spark.createDataFrame(rows, "row_idx long, country string, name_fold string, name_stripped string, name_key string, address_norm string, address_numbers string, legal_forms string, name_script string, address_missing boolean, house_numbers string, unit_numbers string, postcode string, source int")
    return df.where("row_idx % 2 = 0"), df.where("row_idx % 2 = 1")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def joined(plan, q, t):
    index = link.indexes(plan, q, t)
    return link.pair_features(plan, q, t, link.candidates(plan, q, t, index), index)


def test_stage1_equals_that_of_joins(sides):
    q, t = sides
    for plan in (PLAN, replace(PLAN, cap=1000, channels=tuple(replace(c, df_cap=c.df_cap and 4) for c in PLAN.channels))):
        found, want = link.walked_stage1(plan, q, t), joined(plan, q, t)
        assert found.dtypes == want.dtypes and want.count() > 20
        assert rows(found) == rows(want)


def test_who_cannot_walk(sides):
    q, t = sides
    assert link.walks(PLAN, q, t)
    assert not link.walks(PLAN, q.union(q), t) and not link.walks(PLAN, q.withColumn("row_idx", F.col("row_idx").cast("int")), t)
    assert not link.walks(replace(PLAN, channels=(retrieve.Channel("name", "name_fold", top_k=5),)), q, t)


def test_stage1_pairs_are_not_shuffled(spark):
    """Pairs by joins are ranked in windows."""
    plan = queries.QUERIES["stage1_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_stage2_equals_that_of_joins(sides):
    q, t = sides
    for plan in (PLAN, replace(PLAN, cap=1000, top_k=1000)):
        names = features.stage2_names(plan.names)
        want = link.stage2_features(plan, q, t, joined(plan, q, t).withColumn("s1_score", F.col("s_sum"))).select("q", "t", *names)
        found = link.walked_stage2(plan, q, t)
        assert found.dtypes == want.dtypes and want.count() > 20
        assert rows(found) == rows(want)


def test_stage2_pairs_are_not_shuffled(spark):
    plan = queries.QUERIES["stage2_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
