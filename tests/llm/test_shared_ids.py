import random

import pytest
import xxhash

from kinbridge.llm import lpf_dedup, substring_dedup
from tests.llm.conftest import prose


@pytest.mark.parametrize("shared", [7, None])
def test_texts_of_one_id_whose_hashes_agree_in_many_bits_stay_apart(spark, shared):
    """The low 21 bits of the two texts' hashes agree; only the first has a passage of another document."""
    rng = random.Random(41)
    passage, other = prose(rng, 120), prose(rng, 200)
    seen, pair = {}, None
    for i in range(20_000):
        first = i % 2 == 0
        text = f"{passage} {i}" if first else f"{other} {i}"
        low = xxhash.xxh64_intdigest(text.encode(), 42) & ((1 << 21) - 1)
        if (low, not first) in seen:
            pair = sorted((text, seen[low, not first]), key=lambda t: t.startswith(other))
            break
        seen[low, first] = text
    assert pair
    df = spark.createDataFrame([(shared, pair[0]), (shared, pair[1]), (9, passage)], "doc_id long, text string")
    for done, size in ((lpf_dedup.remove_repeats(df, window=400, mode="all"), "n_bytes"), (substring_dedup.remove_repeats(df, window=20, mode="all"), "n_words")):
        whole = {len(t.encode()) if size == "n_bytes" else len(t.split()): t for t in (*pair, passage)}
        assert len(whole) == 3
        removed = {whole[r[size]]: r["n_removed"] for r in done.collect()}
        assert removed[pair[1]] == 0 and removed[pair[0]] > 0 and removed[passage] > 0
