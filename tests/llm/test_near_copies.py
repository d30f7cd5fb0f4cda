"""The pipeline's near-duplicate stage against brute force: links, groups and what is kept."""

import random

import numpy as np
import pytest

from kinbridge.llm import jaccard, simhash
from tests.llm import brute
from tests.llm.conftest import SF, prose


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    """Components of pairs of similarity 0.8, equal sets, or fingerprints within four bits."""
    sets, fps, root = [shingles(t) for _, t in rows], [brute.fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(rows))]


def copies(rng, base, edits):
    words = list(base)
    for at in rng.sample(range(len(words)), edits):
        words[at] = "changed" + str(rng.randrange(1000))
    return " ".join(words)


def kept_and_wanted(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(df).collect())
    return kept, sorted(rows[i][0] for i in set(groups(rows)))


def test_similar_but_not_near_copies_stay(spark):
    """Pairs of a similarity of 0.45 to 0.95: kept and dropped ones are those of brute force."""
    rng, rows = random.Random(31), []
    for edits in list(range(2, 24)) * 4:
        base = prose(rng, 200).split()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, copies(rng, base, edits))]
    kept, want = kept_and_wanted(spark, rows)
    assert kept == want and len(rows) // 2 < len(kept) < len(rows)


@pytest.mark.parametrize(("few", "sampled"), [(2, True), (2, False), (24, True)])
def test_links_find_every_pair_of_crowded_and_small_buckets(spark, few, sampled, monkeypatch):
    """Groups chained at the limit, a passage that many share, short texts; crowded buckets or not, with and without
    shingles that a sample puts last."""
    rng, rows = random.Random(32), []
    passage = prose(rng, 40)
    for n in (12, 60, 150):
        base = prose(rng, n).split()
        rows += [(len(rows) + i, copies(rng, base, rng.randint(0, n // 30))) for i in range(40)]
    rows += [(len(rows) + i, passage + " " + prose(rng, rng.choice((3, 8, 60)))) for i in range(60)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, " ", "one two", "One  two", "a b c d e f", "a b c d e f g", "a b c d e f g h i", "a b c d e f g h"])]
    exact = jaccard.jaccard_links
    monkeypatch.setattr(jaccard, "jaccard_links", lambda prints, keyed: exact(prints, keyed, few))
    if not sampled:
        monkeypatch.setattr(jaccard, "common_shingles", lambda keyed: (np.empty(0, np.uint64), np.empty(0, np.int64)))
    kept, want = kept_and_wanted(spark, rows)
    assert kept == want


def test_stage_on_a_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept, want = kept_and_wanted(spark, sorted(rows))
    assert kept == want


def test_sketches_refuse_no_pair_that_is_alike():
    """Sets of all sizes and overlaps, of equal and of neighbouring widths; most pairs far apart are refused."""
    rng, refused, far = np.random.default_rng(33), 0, 0
    for n in (1, 2, 5, 15, 16, 17, 60, 64, 70, 300, 520, 5000):
        base = np.unique(rng.integers(0, 2**64, n, np.uint64))
        sets = [base] + [np.unique(np.concatenate([base[: n - k // 2], rng.integers(0, 2**64, k - k // 2, np.uint64)])) for k in {0, 1, 2, n // 9, n // 8, n // 5, n // 4, n // 2, n}]
        found = jaccard.Sketches([jaccard.sketch(h).tobytes() for h in sets], np.array([len(h) for h in sets]))
        for i, x in enumerate(sets):
            near = found.near(i, np.arange(len(sets)))
            for y, passes in zip(sets, near.tolist(), strict=True):
                assert passes or not jaccard.alike(x, y)
                both = len(np.intersect1d(x, y))
                far += 10 * both < 7 * (len(x) + len(y) - both)
                refused += not passes
    assert refused >= far > 100


def test_a_large_group_does_not_fetch_its_texts_for_all_pairs(spark, monkeypatch):
    """Half of the group's pairs are under the limit, so many components are left when the forest is verified."""
    rng, rows = random.Random(34), []
    base = prose(rng, 150).split()
    rows += [(i, copies(rng, base, rng.randint(0, 5))) for i in range(240)]
    asked, exact = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *a: (asked.append(pairs.distinct().count()), exact(pairs, *a))[1])
    kept, want = kept_and_wanted(spark, rows)
    assert kept == want and sum(asked) < 5 * len(rows)
