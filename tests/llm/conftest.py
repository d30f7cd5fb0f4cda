import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def messy():
    """Rows (doc_id, text): nulls, empties, blanks, repeats, near copies, shared passages, other scripts, a long text."""
    rng = random.Random(5)
    passage, base = prose(rng, 90), prose(rng, 200)
    w = base.split()
    near = " ".join(w[:120] + ["changed"] + w[121:])
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, near), (9, base.upper()), (10, prose(rng, 40) + " " + passage + " " + prose(rng, 30)),
        (11, passage), (12, "x" * 900), (13, "aé" * 450), (14, ("日本 語 　 text\r\n" * 60)), (15, prose(rng, 6000) + " " + passage), (16, "word " * 500), (17, "line one here\nline one here\nother\n" * 30), (None, passage + " " + prose(rng, 20)),
        (20, "🙂 ñ " * 100), (21, base + " tail"), (22, near),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark, messy):
    """With an unused column and names that the operators use inside."""
    rows = [(i, t, "en" if i and i % 2 else None, None if i and i % 5 == 0 else "s", len(t) if t is not None else None, 1, "x", 0.5, "y", 3, 4) for i, t in messy]
    columns = "doc_id long, text string, lang string, source string, n_chars long, d int, tag string, score double, _shard string, start int, place int"
    return spark.createDataFrame(rows, columns).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
