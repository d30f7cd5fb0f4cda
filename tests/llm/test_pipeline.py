import hashlib

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from kinbridge.llm import bpe, decontaminate, quality_cnn, queries, simhash
from tests.llm.conftest import SF


def test_stages_take_effect_and_compose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        seen.append(out.persist())
    text = [{r["doc_id"]: r["text"] for r in df.collect()} for df in seen]
    scored = {r["doc_id"]: r["predicted"] for r in quality_cnn.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(text[1]) == {i for i, p in scored.items() if p == 1}
    # near duplicates: of equal texts the least id stays, and what stays has no fingerprint within the radius
    least = {}
    for i in sorted(text[1]):
        least.setdefault(" ".join(text[1][i].split()), i)
    assert set(text[2]) <= set(least.values())
    f = np.array([simhash.fingerprint(t.encode()) for t in text[2].values()]).view(np.uint64)
    assert all((np.bitwise_count(f[i + 1 :] ^ f[i]) > 4).all() for i in range(len(f)))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    assert set(text[3]) == {i for i, t in text[2].items() if not matcher.find(t)}
    assert set(text[4]) == set(text[3]) and any("<SECRET>" in t for t in text[4].values())
    ranks = bpe.read_ranks(open(queries.RANK_FILE, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode_ordinary(t) for i, t in text[4].items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[4][r["doc_id"]].encode()).hexdigest() for r in rows)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, rows))
