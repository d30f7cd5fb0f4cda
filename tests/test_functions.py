import itertools
import random

import pytest

from kinbridge.functions import hashing, normalize, phonetic, similarity


@pytest.mark.parametrize(
    ("raw", "country", "norm"),
    [("Fußball Haus", "", "fussball haus"), ("O’Neill Ltd.", "", "oneill ltd"), ("L'Heure d'Or", "France", "l heure d or"), ("B.B.Q Grill", "", "bbq grill"), (None, "US", ""), ("  <NULL> ", "US", ""), ("A & B", "France", "a et b"), ("A&B", "", "a and b")],
)
def test_cleaned(raw, country, norm):
    assert normalize.cleaned(raw, country) == norm


def test_legal_forms():
    assert normalize.without_legal_forms("zeta tools opc pvt ltd", "India") == ("zeta tools", ["opc", "pvt ltd"])
    assert normalize.without_legal_forms("boulangerie chenee sarl", "US") == ("boulangerie chenee sarl", [])
    assert normalize.without_legal_forms("boulangerie chenee sarl", "France") == ("boulangerie chenee", ["sarl"])
    assert normalize.without_legal_forms("company limited", "India") == ("company", ["ltd"])
    assert normalize.without_legal_forms("moreau et cie", "France") == ("moreau", ["cie"])
    assert normalize.without_legal_forms("oneill and sons and co", "") == ("oneill and sons", ["co"])
    assert normalize.without_legal_forms("m s lotus traders", "India") == ("lotus traders", ["m/s"])
    assert normalize.without_legal_forms("plc", "") == ("plc", [])


@pytest.mark.parametrize(
    ("raw", "country", "forms"),
    [
        ("Nordic Fish Co., LLC", "US", ("nordic fish co llc", "nordic fish co llc", "nordic fish", "co llc", "latin")), ("Boulangerie Chênée SARL", "France", ("boulangerie chênée sarl", "boulangerie chenee sarl", "boulangerie chenee", "sarl", "latin")),
        ("कमल स्टोर प्राइवेट लिमिटेड", "India", ("कमल स्टोर प्राइवेट लिमिटेड", "कमल स्टोर प्राइवेट लिमिटेड", "कमल स्टोर", "pvt ltd", "devanagari")), ("404", "", ("404", "404", "404", "", "empty")),
    ],
)
def test_name_forms(raw, country, forms):
    assert normalize.name_forms(raw, country) == forms


def test_normalising_again_changes_nothing():
    for raw in ("Boulangerie Chênée SARL", "B.B.Q Grill", "Zeta Tools (OPC)"):
        once = normalize.cleaned(raw, "France")
        assert normalize.cleaned(once, "France") == once


@pytest.mark.parametrize(("text", "label"), [("123 456", "empty"), ("abc", "latin"), ("lotus कमल", "mixed"), ("大阪", "other"), ("राम", "devanagari"), ("தமிழ்", "tamil"), ("abc 東", "mixed")])
def test_script(spark, text, label):
    assert normalize.script(text) == label
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(normalize.script_column(df.x)).first()[0] == label


@pytest.mark.parametrize(("raw", "number"), [("06252-00a0-000", "6252-0a0-0"), ("#51", "51"), ("g-58/1", "g-58-1"), ("0", "0"), ("000", "0")])
def test_canonical_number(spark, raw, number):
    assert normalize.canonical_number(raw) == number
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(normalize.canonical_number_column(df.x)).first()[0] == number


@pytest.mark.parametrize(
    ("raw", "country", "postcode", "houses", "units", "norm"),
    [
        ("Flat No. 27, 3rd Floor, Lake View, Pune 411 001", "India", "411001", "", "27", "flat no 27 3rd floor lake view pune 411 1"), ("48 ter avenue des Lilas, 69003 Lyon", "France", "69003", "48ter", "", "48 ter avenue des lilas 69003 lyon"),
        ("901 Oak Blvd Apt 12, Salem, OR 97301-0042", "US", "97301", "901", "12", "901 oak boulevard apartment 12 salem or 97301 42"), ("Plot No 0045/7, Sector 9, Noida", "India", "", "45-7", "", "plot no 45 7 sector 9 noida"),
        ("n°12 rue Haute", "France", "", "12", "", "no 12 rue haute"), ("7 Fjord Rd, Bergen, 5003", "Norway", "5003", "7", "", "7 fjord road bergen 5003"), ("Unit b, 3-5 Mill Ln, Reno, NV 89501", "US", "89501", "", "b", "unit b 3 5 mill lane reno nv 89501"),
        ("Shop 7, House No. 12a, Door No 3", "India", "", "12a 3", "7", "shop 7 house no 12a door no 3"), ("21st Street", "US", "", "", "", "21st street"), ("<null>, nan", "", "", "", "", ""),
    ],
)
def test_address(raw, country, postcode, houses, units, norm):
    a = dict(zip(normalize.ADDRESS, normalize.address_forms(raw, country), strict=True))
    assert (a["postcode"], a["house_numbers"], a["unit_numbers"], a["norm"], a["missing"]) == (postcode, houses, units, norm, norm == "")
    assert normalize.address_forms(None, None)[1] is True


def test_normalize_records(spark):
    rows = [("S1-1", "ACME Corp.", "12 Main St, X, IL 62704", "US", 1), ("S2-1", None, None, None, 2), ("S2-2", "ACME Corp.", "<NULL>", "US", 2)]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, source byte")
    got = {r["entity_id"]: r for r in normalize.normalize_records(df).collect()}
    assert len(got) == 3 and len(got["S1-1"]) == 20
    assert (got["S1-1"]["name_key"], got["S1-1"]["legal_forms"], got["S1-1"]["postcode"]) == ("acme", "corp", "62704")
    assert all(r["address_missing"] == (r["address_norm"] == "") for r in got.values())


def test_skeleton_column_equals_function(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeiouchtgsxkqupnyz") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "x string")
    assert [r[0] for r in df.select(phonetic.skeleton_column(df.x)).collect()] == [phonetic.skeleton(w) for w in words]


def test_skeleton_crosses_scripts():
    key = lambda s: sorted(set(phonetic.skeleton(s).split()))
    assert key("भारत स्टील") == key("Steel Bharat") == ["prt", "stl"]
    assert key("కిరణ్ ప్రింట్") == key("kiran print")


def _lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def test_ratio_equals_quadratic_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == _lcs(a, b)


def test_token_scores():
    assert similarity.token_sort_ratio("b a", "a b") == 100
    assert similarity.token_set_ratio("a b c", "c b a d") == 100
    assert similarity.partial_ratio("abc", "xxabcxx") == 100
    assert similarity.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    for a, b in itertools.product(("acme labs", "labs acme inc", "zen"), repeat=2):
        assert similarity.ratio(a, b) == similarity.ratio(b, a)


def test_blake_key_is_stable(spark):
    base = spark.range(5)
    df = base.withColumn("h", hashing.blake_key(base.id, "s")).repartition(3)
    assert len({r["h"] for r in df.collect()}) == 5 and all(len(r["h"]) == 16 for r in df.collect())
