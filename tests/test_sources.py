import pytest
from pyspark.sql import functions as F

from kinbridge.plans.link import LinkPlan, candidates, link, pair_features, stage2_features, study
from kinbridge.operators import features, models, retrieve, tokens
from kinbridge.sources import idlists, records
from kinbridge.streaming import incremental

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_strict_tsv(spark, tmp_path):
    good = write(tmp_path / "a.tsv", HEADER + 'S1-1\t"Quoted" name\t\tUS\nS1-2\tB\t2 Road\tFrance\n')
    rows = {r["entity_id"]: r for r in records.read_source(spark, good, 1).collect()}
    assert rows["S1-1"]["business_name"] == '"Quoted" name' and rows["S1-1"]["business_address"] == "" and rows["S1-2"]["source"] == 1
    assert records.read_source(spark, write(tmp_path / "e.tsv", HEADER), 1).count() == 0
    for name, text in (("prefix", HEADER + "S2-1\ta\tb\tUS\n"), ("header", "id\tbusiness_name\tbusiness_address\tcountry\nS1-1\ta\tb\tUS\n"), ("width", HEADER + "S1-1\ta\n")):
        with pytest.raises(Exception):  # noqa: B017
            records.read_source(spark, write(tmp_path / f"{name}.tsv", text), 1).collect()


def test_tolerant_tsv(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "a\tb\nx\ty\nz\n")
    assert sorted(map(tuple, records.read_tsv_tolerant(spark, path, ["a", "b"]).collect())) == [("x", "y", 2), ("z", "", 1)]


def test_truth(spark):
    raw = spark.createDataFrame([("S1-1", "S2-10, S3-20,"), ("S1-2", "S2-11"), ("S1-3", "")], records.TRUTH)
    s1, pairs = records.parse_truth(raw)
    assert sorted(map(tuple, s1.collect())) == [("S1-1", 2), ("S1-2", 1), ("S1-3", 0)]
    assert sorted(map(tuple, pairs.collect())) == [("S1-1", "S2-10", 2), ("S1-1", "S3-20", 3), ("S1-2", "S2-11", 2)]
    with pytest.raises(Exception, match="not a target"):
        records.parse_truth(spark.createDataFrame([("S1-1", "X-1")], records.TRUTH))[1].collect()


def test_cache(spark, tmp_path):
    source = write(tmp_path / "s.tsv", HEADER + "S1-1\ta\tb\tUS\n")
    cache, calls = str(tmp_path / "cache"), []

    def load():
        calls.append(1)
        return records.read_source(spark, source, 1)

    for version, n in (("1", 1), ("1", 1), ("2", 2)):
        assert records.build_cache(spark, source, cache, version, load).count() == 1 and len(calls) == n
    assert records.read_cache(spark, source, cache, "2", ["entity_id"]).columns == ["entity_id"]
    write(tmp_path / "s.tsv", HEADER + "S1-1\ta\tb\tUS\nS1-2\ta\tb\tUS\n")
    with pytest.raises(RuntimeError):
        records.read_cache(spark, source, cache, "2")


def test_checkpoints(spark, tmp_path):
    plan = spark.createDataFrame([(i, i % 3) for i in range(9)], "q long, block int")
    path = str(tmp_path / "blocks")
    assert records.pending_blocks(plan, spark, path, "block").count() == 9
    records.write_checkpoint(plan.where("block = 1"), path, "block")
    assert {r["block"] for r in records.pending_blocks(plan, spark, path, "block").collect()} == {0, 2}


def test_id_lists(spark, tmp_path):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    pairs = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S2-1")], "id string, t string")
    lists = idlists.id_lists(pairs, entities, "id", "t")
    path = str(tmp_path / "lists")
    idlists.write_id_lists(lists, path, "id", ("id", "ids"))
    back = {r["id"]: r["ids"] for r in idlists.read_id_lists(spark, path, ("id", "ids")).collect()}
    assert back == {"S1-1": ["S2-1", "S2-2"], "S1-2": []}
    messy = write(tmp_path / "m.tsv", '﻿id\tids\r\n"S1-1"\tS2-1, S2-2,\r\n\r\nS1-1\tS2-3\r\nS1-2\t\r\n')
    assert {r["id"]: r["ids"] for r in idlists.read_id_lists(spark, messy, ("id", "ids")).collect() if r["id"] != "id"} == {"S1-1": ["S2-1", "S2-2", "S2-3"], "S1-2": []}


def test_validate(spark):
    entities = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "id string")
    lines = ["id\tids", "S1-1\tS2-1,S2-1,X-1", "S1-1\tS2-2", "S1-2,S2-1", "S1-9\tS2-7"]
    found = {r["rule"]: r["n"] for r in idlists.validate(spark.createDataFrame([(x,) for x in lines], "value string"), entities, ("id", "ids"), spark.createDataFrame([("S2-1",), ("S2-2",)], "t string")).collect()}
    assert found == {"repeated_id": 1, "bad_prefix": 1, "repeated_row": 1, "csv": 1, "width": 1, "missing": 2, "extra": 1, "unknown_id": 2}
    clean = spark.createDataFrame([("id\tids",), ("S1-1\tS2-1",), ("S1-2\t",), ("S1-3\t",)], "value string")
    assert idlists.validate(clean, entities, ("id", "ids")).count() == 0


def records_frame(spark, rows):
    columns = "row_idx long, country string, name_fold string, name_stripped string, name_key string, address_norm string, address_numbers string, legal_forms string, name_script string, address_missing boolean, house_numbers string, unit_numbers string, postcode string, source byte"
    return spark.createDataFrame([(i, "US", n, n, " ".join(sorted(n.split())), a, "", "", "latin", a == "", a.split(" ")[0], "", "", 2) for i, n, a in rows], columns)


def test_link_plan_and_stream(spark, tmp_path):
    targets = records_frame(spark, [(10, "acme group", "1 main street"), (11, "acme labs", "2 main street"), (12, "zen group", "5 oak road"), (13, "zen labs group", "")])
    queries = records_frame(spark, [(0, "acme group", "1 main street"), (1, "zen labs", "9 pine")])
    name, key = retrieve.Channel("name", "name_fold", df_cap=10), retrieve.Channel("key", "name_key", "key", None)
    four = (name, retrieve.Channel("addr", "address_norm"), key, retrieve.Channel("strip", "name_stripped"))
    assert len(features.stage1_names([c.name for c in four])) == 44 and len(features.stage2_names([c.name for c in four])) == 62
    plan = LinkPlan(four, cap=10, top_k=3, threshold=0.5)
    pairs = pair_features(plan, queries, targets, candidates(plan, queries, targets)).persist()
    assert pairs.columns == ["q", "t", *features.stage1_names(plan.names)]
    row = pairs.where("q = 0 and t = 10").first()
    assert (row["house_eq"], row["house_conflict"], row["unit_eq"], row["q_name_ntok"], row["t_key_df"], row["country"], row["q_script"], row["t_addr_missing"]) == (1, 0, 0, 2, 1, 0, 1, 0)
    other = pairs.where("q = 0 and t = 11").first()
    assert (other["house_eq"], other["house_conflict"], other["q_key_df"]) == (0, 1, 1) and pairs.where("q = 1").first()["q_key_df"] == 0
    truth = spark.createDataFrame([(0, 10), (1, 13)], "q long, t long")
    labelled = features.labels(pairs, truth)
    stage1 = models.train(labelled, features.stage1_names(plan.names), trees=2, depth=2)
    scored = models.score(stage1, labelled, features.stage1_names(plan.names), "s1_score", "_p1").persist()
    stage2 = models.train(stage2_features(plan, queries, targets, scored), features.stage2_names(plan.names), trees=3, depth=2)
    out = link(plan, queries, targets, stage1, stage2).collect()
    assert all(r["p"] >= 0.5 for r in out) and len({r["t"] for r in out}) == len(out)
    assert {r["strategy"] for r in study(plan, queries, targets, truth, [1, None]).collect()} == {"name", "addr", "key", "strip", "all"}
    # the stream finds what the batch finds
    source = str(tmp_path / "in")
    queries.write.parquet(source)
    index = tokens.postings(targets, "country", "row_idx", "name_fold")
    stream = spark.readStream.schema(queries.schema).parquet(source)
    incremental.link_stream(stream, index, tokens.vocabulary(index, targets, "country"), name, "country", "row_idx", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r["q"], r["t"], r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["q"], r["t"], r["rank"]) for r in retrieve.retrieve(queries, targets, name, "country", "row_idx").collect())


def test_target_pool(spark):
    s2 = records.with_source(spark.createDataFrame([("S2-5", 0), ("S2-1", 1)], "entity_id string, pos long"), 2)
    s3 = records.with_source(spark.createDataFrame([("S3-1", 0)], "entity_id string, pos long"), 3)
    assert [r["entity_id"] for r in records.target_pool(s2, s3).orderBy("row_idx").collect()] == ["S2-5", "S2-1", "S3-1"]
    assert F is not None


def test_dataset_folder(spark, tmp_path, monkeypatch):
    from kinbridge.sources import config

    for f in config.FILES:
        p = tmp_path / "data" / f
        p.parent.mkdir(parents=True, exist_ok=True)
        n = f[-5]
        p.write_text(HEADER + f"S{n}-1\tACME Corp.\t12 Main St\tUS\nS{n}-2\tÉcole SARL\t\tFrance\n", encoding="utf-8")
    (tmp_path / "data" / config.TRUTH_FILE).write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    assert config.find_data_dir(str(tmp_path / "data")) == config.find_data_dir(search=str(tmp_path)) == str(tmp_path / "data")
    monkeypatch.setenv(config.VARIABLE, str(tmp_path / "data"))
    assert config.find_data_dir() == str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        config.find_data_dir(str(tmp_path))
    with pytest.raises(ValueError):
        config.Config(str(tmp_path / "data"), str(tmp_path / "data/work")).validate()
    c = config.Config(str(tmp_path / "data"), str(tmp_path / "work")).validate()
    rows = {r["entity_id"]: r for r in config.normalized_table(spark, c, "train", 1).collect()}
    assert rows["S1-1"]["name_key"] == "acme" and rows["S1-2"]["name_fold"] == "ecole sarl" and rows["S1-2"]["legal_forms"] == "sarl"
    s1, pairs = config.truth_tables(spark, c)
    assert s1.count() == 2 and pairs.count() == 2 and len(config.code_fingerprint()) == 64


def test_experiments(spark):
    from kinbridge.operators import profile
    from kinbridge.plans import experiments

    names = spark.createDataFrame([(1, "US", "राम मार्केटिंग", "devanagari"), (2, "US", "ram marketing", "latin")], "row_idx long, country string, name_fold string, name_script string")
    skel = experiments.with_skeletons(names)
    for variant in experiments.INDIC_VARIANTS:
        found = experiments.retrieve_indic(skel.where("row_idx = 2"), skel.unionByName(names.where("row_idx = 2").selectExpr("9 as row_idx", "country", "'zen' as name_fold", "name_script", "'sn' as name_skel", "'sn' as name_skel_key")), variant, "country", "row_idx")
        assert all(r["t"] in (1, 2) for r in found.collect())
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "q long, t long")
    assert experiments.differences(a, a).count() == 0 and experiments.differences(a, a.distinct()).count() == 1
    assert '"q": 1' in experiments.report(a)
    folded = spark.createDataFrame([("Éﬁ",)], "x string")
    assert folded.select(profile.compatible_fold()("x")).first()[0] == "efi"


def test_only_the_first_line_is_a_header(spark, tmp_path):
    path = write(tmp_path / "p.tsv", "a\tb\n1\t2\na\tb\n3\n")
    assert sorted(tuple(r) for r in records.read_tsv_tolerant(spark, path, ["a", "b"]).collect()) == [("1", "2", 2), ("3", "", 1), ("a", "b", 2)]


def test_repairs_are_told(spark):
    lines = ["﻿id\tids", "S1-1\tS2-1, S2-1", "S1-1\tS2-2\r", "S1-2", '"S1-3"\t', ""]
    found = {r["warning"]: r["n"] for r in idlists.repairs(spark.createDataFrame([(x,) for x in lines], "value string"), ("id", "ids")).collect()}
    assert found == {"no_tab": 1, "repeated_id": 1, "repeated_row": 1}


def test_chunks(spark):
    parts = [sorted(r["id"] for r in part.collect()) for part in records.chunks(spark.range(3, 14), "id", 4)]
    assert parts == [[3, 4, 5, 6], [7, 8, 9, 10], [11, 12, 13]] and list(records.chunks(spark.range(0), "id", 4)) == []
