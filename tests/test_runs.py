import pytest
from pyspark.sql import functions as F

from kinbridge.operators import decide, models
from kinbridge.plans import runs


@pytest.fixture
def plan(spark):
    return spark.createDataFrame([(q, q // 10) for q in range(60)], "q long, block int")


def pairs_of(shift):
    """Two pairs a query: p falls with the query."""

    def score(part):
        rows = part.select("q", "block", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        return rows.select("q", (F.col("q") * 2 + F.col("k")).alias("t"), F.round(1 - F.col("q") / 100 - F.col("k") / 2 - shift, 6).alias("p"), "block")

    return score


def test_ranges_resume_compare_and_assemble(spark, tmp_path, plan):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    runs.claim(spark, first, {"chunk": 10})
    runs.claim(spark, first, {"chunk": 10})
    with pytest.raises(RuntimeError, match="another description"):
        runs.claim(spark, first, {"chunk": 20})
    assert runs.run_range(plan, first, pairs_of(0.0), stop=3, at_once=2).groups == 2
    with pytest.raises(RuntimeError, match="lacks blocks"):
        runs.assemble_run(plan, first, 0.5)
    assert runs.assemble_run(plan, first, 0.5, partial=True).where("size(candidates) > 0").count() == 30
    rest = runs.run_range(plan, first, pairs_of(0.0), at_once=2)
    assert rest.groups == 2 and set(rest.seconds) == {"plan", "score"} and runs.run_range(plan, first, pairs_of(0.0)).groups == 0
    report = runs.run_range(plan, second, pairs_of(0.25), reference=first)
    assert (report.largest, report.unmatched) == (0.25, 0) and report.seconds["compare"] > 0
    assert runs.run_range(plan, str(tmp_path / "c"), pairs_of(0.0), at_once=1, seconds=-1.0).stopped
    final = runs.assemble_run(plan, first, 0.5)
    assert decide.summary(final).first().asDict() == {"n_queries": 60, "n_matched": 51, "n_empty": 9, "n_matches": 52, "most_matches": 2, "n_candidates": 120, "n_without_candidates": 0}


def test_rescoring_stored_pairs(spark, tmp_path, plan):
    reference, path = str(tmp_path / "a"), str(tmp_path / "b")
    runs.run_range(plan, reference, pairs_of(0.0))
    features = lambda stored: stored.withColumn("x", (F.col("t") % 2).cast("double"))
    model = models.train(features(spark.read.parquet(reference)).withColumn("label", F.col("t") % 2), ["x"], trees=2, depth=2)
    report = runs.run_range(plan, path, runs.rescorer(reference, features, model, ["x"]), reference=reference)
    out = spark.read.parquet(path)
    assert report.unmatched == 0 and out.count() == 120 and out.where("(t % 2 = 1) <> (p > 0.5)").count() == 0


def test_finalize_guards(spark):
    queries = spark.createDataFrame([("S1-1",), ("S1-2",)], "q string")
    pairs = lambda *rows: spark.createDataFrame(list(rows), "q string, t string, p double")
    prefixes = {"q": ("S1-",), "t": ("S2-", "S3-")}
    good = decide.finalize(pairs(("S1-1", "S2-1", 0.9), ("S1-1", "S3-1", 0.2)), queries, 0.5, prefixes).collect()
    assert {r["q"]: (r["matches"], r["candidates"]) for r in good} == {"S1-1": (["S2-1"], ["S2-1", "S3-1"]), "S1-2": ([], [])}
    for rows, text in ((((("S1-1", "S2-1", 0.9)), ("S1-1", "S2-1", 0.8)), "occurs twice"), ((("S1-9", "S2-1", 0.9),), "outside the plan"), ((("S1-1", "X-1", 0.9),), "without its prefix")):
        with pytest.raises(Exception, match=text):
            decide.finalize(pairs(*rows), queries, 0.5, prefixes).collect()


def test_light_index(spark):
    rows = spark.createDataFrame([(1, "S1-1", "US", "name", 2)], "row_idx long, entity_id string, country string, name_fold string, source int")
    q, t = runs.light_index(rows, rows)
    assert q.columns == ["q", "entity_id", "country"] and t.columns == ["t", "entity_id", "country", "source"]
