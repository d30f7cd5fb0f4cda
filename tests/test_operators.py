import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinbridge.operators import decide, features, metrics, models, profile, retrieve, splits, tokens

POOL = [(10, "acme group", "1 main street", "acme"), (11, "acme labs", "2 main street", "acme labs"), (12, "zen group", "5 oak road", "zen"), (13, "zen labs group", "", "labs zen"), (14, "orbit group", "1 main street", "orbit")]
ASK = [(0, "acme group", "1 main street", "acme"), (1, "zen labs", "9 pine", "labs zen")]


@pytest.fixture(scope="module")
def pool(spark):
    schema = "row_idx long, name_fold string, address_norm string, name_key string"
    part = F.lit("US")
    return spark.createDataFrame(ASK, schema).withColumn("country", part), spark.createDataFrame(POOL, schema).withColumn("country", part)


def pairs(df):
    return sorted((r["q"], r["t"]) for r in df.collect())


def test_vocabulary_counts_empty_documents(spark):
    docs = spark.createDataFrame([(0, "p", "b a"), (1, "p", "a a c"), (2, "p", ""), (3, "p", "a")], "doc long, part string, x string")
    v = {r["token"]: (r["df"], r["n"]) for r in tokens.vocabulary(tokens.postings(docs, "part", "doc", "x"), docs, "part").collect()}
    assert v == {"a": (3, 4), "b": (1, 4), "c": (1, 4)}
    with pytest.raises(ValueError):
        tokens.tokenize(F.col("x"), "other")


def test_channels(pool):
    q, t = pool
    run = lambda c: pairs(retrieve.retrieve(q, t, c, "country", "row_idx"))
    assert run(retrieve.Channel("n", "name_fold", df_cap=3)) == [(0, 10), (0, 11), (1, 11), (1, 12), (1, 13)]
    assert (0, 14) in run(retrieve.Channel("n", "name_fold", df_cap=10))
    assert run(retrieve.Channel("n", "name_fold", df_cap=10, top_k=1)) == [(0, 10), (1, 13)]
    assert run(retrieve.Channel("k", "name_key", "key", None)) == [(0, 10), (1, 13)]
    assert run(retrieve.Channel("a", "address_norm")) == [(0, 10), (0, 11), (0, 14)]


def test_union_and_merge(spark):
    a = spark.createDataFrame([(0, 5, 1.0, 1), (0, 7, 3.0, 0), (1, 5, 2.0, 0)], "q long, t long, score double, rank long")
    b = spark.createDataFrame([(0, 5, 4.0, 0), (1, 9, 0.5, 0)], "q long, t long, score double, rank long")
    got = {(r["q"], r["t"]): (r["score"], r["mask"], r["rank"]) for r in retrieve.union_candidates([a, b]).collect()}
    assert got == {(0, 5): (5.0, 3, 0), (0, 7): (3.0, 1, 1), (1, 5): (2.0, 1, 0), (1, 9): (0.5, 2, 1)}
    m = {(r["q"], r["t"]): r for r in retrieve.merge_channels({"a": a, "b": b, "none": a.limit(0)}).collect()}
    assert m[0, 5]["s_none"] is None and m[0, 5]["n_cand"] == 2 and m[0, 7]["s_best"] == 5.0
    assert {k for k, r in m.items() if r["r_sum"] < 1} == set(pairs(retrieve.cap_merged(retrieve.merge_channels({"a": a, "b": b}), 1)))
    with pytest.raises(ValueError):
        retrieve.union_candidates([a] * 9)


@pytest.mark.parametrize("k", [None, 1, 3, 10])
def test_scores_equal_brute_force(spark, k):
    rng = random.Random(k or 0)
    q = [(i, " ".join(rng.sample("abcdefgh", 3))) for i in range(12)]
    t = [(i, " ".join(rng.sample("abcdefgh", 4))) for i in range(30)]
    frame = lambda rows: spark.createDataFrame(rows, "row_idx long, x string").withColumn("country", F.lit("p"))
    got = {(r["q"], r["t"]): (r["score"], r["rank"]) for r in retrieve.retrieve(frame(q), frame(t), retrieve.Channel("x", "x", top_k=k), "country", "row_idx").collect()}
    import math

    df = Counter(w for _, x in t for w in x.split())
    want = {}
    for i, x in q:
        s = {j: round(sum(round(math.log(30 / df[w]), 6) for w in set(x.split()) & set(y.split())), 6) for j, y in t}
        order = sorted((j for j in s if s[j] > 0), key=lambda j: (-s[j], j))[:k]
        want |= {(i, j): (s[j], n) for n, j in enumerate(order)}
    assert got == want


def test_equal_and_conflict(spark):
    df = spark.createDataFrame([("12", "12"), ("12 4", "13"), ("", "5"), ("", "")], "a string, b string")
    eq, no = features.equal_conflict(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(eq, no).collect()] == [(1, 0), (0, 1), (0, 0), (0, 0)]


def test_decide(spark):
    p = spark.createDataFrame([(0, 7, 0.9), (1, 7, 0.95), (1, 8, 0.6), (2, 8, 0.6)], "q long, t long, p double")
    assert [(r["q"], r["t"]) for r in decide.best_per_target(p).where("best").orderBy("q", "t").collect()] == [(1, 7), (1, 8)]
    assert pairs(decide.decide(p, 0.7)) == [(1, 7)]
    assert pairs(decide.decide(p, 0.7, one_to_one=False)) == [(0, 7), (1, 7)]
    with pytest.raises(Exception, match="twice"):
        decide.finalize(p.unionByName(p), p.select("q"), 0.5).collect()


@pytest.mark.parametrize(("counts", "f"), [((3, 2, 2), 0.7142857), ((0, 0, 0), 1), ((1, 0, 0), 0), ((0, 2, 0), 0), ((2, 2, 0), 0), ((1, 2, 1), 0.8333333), ((2, 1, 1), 0.5555556)])
def test_f_beta(spark, counts, f):
    df = spark.createDataFrame([counts], "a long, b long, c long")
    assert df.select(metrics.f_beta(df.a, df.b, df.c)).first()[0] == pytest.approx(f, abs=1e-6)


def test_recall_and_repeated_truth(spark):
    found = spark.createDataFrame([(0, 5, 0), (1, 8, 0)], "q long, t long, rank long")
    truth = spark.createDataFrame([(0, 5), (0, 7), (1, 9)], "q long, t long")
    q = spark.createDataFrame([(0,), (1,), (2,)], "q long")
    r = metrics.recall_at(metrics.truth_ranks(found, truth), q, [None]).first()
    assert (r["pair_recall"], r["query_recall"]) == (pytest.approx(1 / 3, abs=1e-6), 0.25)
    assert r["oracle_f05"] == pytest.approx((0.8333333 + 0 + 1) / 3, abs=1e-6)
    with pytest.raises(Exception, match="repeats"):
        metrics.truth_ranks(found, truth.unionByName(truth)).collect()


def test_folds_and_subset(spark):
    rng = random.Random(3)
    rows = [(i, f"{rng.choice(['US', 'India'])}|{rng.choice('0124')}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, stratum string")
    folds = {r["id"]: r["fold"] for r in splits.assign_folds(df, "id", "stratum", 5, "s").collect()}
    assert folds == {r["id"]: r["fold"] for r in splits.assign_folds(df.orderBy(F.desc("id")).repartition(7), "id", "stratum", 5, "s").collect()}
    for s in {s for _, s in rows}:
        sizes = Counter(folds[i] for i, x in rows if x == s)
        assert max(sizes.values()) - min(sizes.values()) <= 1
    assert splits.stratified_subset(df, "id", "stratum", 137, "s").count() == 137
    assert folds != {r["id"]: r["fold"] for r in splits.assign_folds(df, "id", "stratum", 5, "other").collect()}


def test_nearest_rank(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 9, 7, 3]], "v long")
    assert tuple(metrics.nearest_rank(df, "v", {"a": 0.0, "b": 0.5, "c": 0.95}).first()) == (1, 5, 9)


def test_bootstrap(spark):
    df = spark.createDataFrame([(0.0, 0.1)] * 50 + [(0.5, 0.5)] * 50, "a double, b double")
    r = metrics.paired_bootstrap(df, rounds=400).first()
    assert r["difference"] == pytest.approx(0.05) and r["low"] < 0.05 < r["high"] and r["better"] == 0.5 and r["equal"] == 0.5


def test_models(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("q"), F.lit(0).alias("t"), (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 5 > 0, (F.col("id") % 2) + F.col("id") % 3 / 10).alias("x"), F.rand(1).alias("y"))
    model = models.train(rows, ["x", "y"], trees=5, depth=3)
    scored = models.score(model, rows, ["x", "y"])
    right = scored.where((F.col("p") > 0.5).cast("int") == F.col("label")).count()
    assert right > 300
    both = models.prefix_margin(model, scored, ["x", "y"], 5, "again")
    assert both.where(F.abs(F.col("margin") - F.col("again")) > 1e-6).count() == 0
    assert models.importance(model, ["x", "y"])[0][0] == "x"
    models.save(model, str(tmp_path / "m"), ["x", "y"], {"trees": 5})
    assert models.load(spark, str(tmp_path / "m"), ["x", "y"]).stages
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / "m"), ["x"])


def test_random_pairs_leave_truth_out(spark):
    q, t = spark.range(5).withColumnRenamed("id", "q"), spark.range(20).withColumnRenamed("id", "t")
    truth = q.crossJoin(t.where("t < 10"))
    assert all(r["t"] >= 10 for r in profile.random_pairs(q, t, truth, 4, "s").collect())
