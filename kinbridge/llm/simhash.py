"""SimHash near-duplicates by pigeonhole blocks.

Texts' word shingles are hashed with XXH64; a bit of the 64-bit fingerprint is set if it is set in over
half the hashes.  Fingerprints link at ``radius`` or fewer differing bits.  Each is split into
``radius + 3`` blocks, so a close pair agrees on three blocks at least, and every choice of three blocks
is a join key.  Within a key's bucket the Hamming distance is verified and a spanning forest of the
links kept, not all pairs.  Only distinct fingerprints take part, so copies cost one row.  A bucket of
over ``crowded`` fingerprints is solved in another exact way: two fingerprints are within 2r bits
exactly if some point is within r bits of both, so each emits all points near it, and those that
emit the same point link.

Null and empty texts, and texts without words, have fingerprint zero, linked like any other; shorter
texts than a shingle are one shingle; repeated rows get equal results; a null id never names a
component unless all of the component's ids are null; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm import jaccard
from kinbridge.llm.common import cut, shingle_places, small_batches, text_bytes, with_key
from kinbridge.llm.components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Shingles whose bits are counted at once, in 16 bits each.
CHUNK = 1 << 14


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        ones += np.unpackbits(h[at : at + CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined, starts, ends = shingle_places(words, shingle)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([fingerprint(t.as_py(), shingle) for t in part["text"]], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, f"doc_id {key}, fp long")


def block_masks(radius: int) -> list[int]:
    """A mask for each choice of three of radius + 3 blocks, as signed 64-bit integers."""
    edges = np.linspace(0, 64, radius + 4).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [x | y | z for x, y, z in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_points(r: int) -> list[int]:
    out = [0]
    for k in range(1, r + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def forest(ids: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links within the radius connect; at most one a row."""
    a, b = [], []
    while len(ids) > 1:
        top, front = ids[0], words[:1]
        ids, words = ids[1:], words[1:]
        while len(front) and len(ids):
            near = np.zeros(len(ids), bool)
            for f in front:
                near |= distances(words, f) <= radius
                if near.all():
                    break
            front = words[near]
            b.append(ids[near])
            a.append(np.full(len(front), top))
            ids, words = ids[~near], words[~near]
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def bucket_links(radius: int, words: int, small: int = 24) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of ids in buckets, from rows (key, id, w0, ...) sorted by key and id; a bucket may span batches."""

    def links(key: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(edge, len(key)))
        few = np.repeat(sizes <= small, sizes)
        a, b = [], []
        k, i, u = key[few], ids[few], x[few]
        for lag in range(1, small):
            hit = np.flatnonzero(k[lag:] == k[:-lag])
            if not len(hit):
                break
            hit = hit[distances(u[hit], u[hit + lag]) <= radius]
            a.append(i[hit])
            b.append(i[hit + lag])
        for at, n in zip(edge[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            for side, found in zip((a, b), forest(ids[at : at + n], x[at : at + n], radius), strict=True):
                side.append(found)
        if not sum(map(len, a)):
            return None
        pairs = np.stack([np.concatenate(a), np.concatenate(b)], 1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in batches:
            x = np.stack([batch[f"w{j}"].to_numpy().view(np.uint64) for j in range(words)], 1)
            held.append((batch["key"].to_numpy(), batch["id"].to_numpy(), x))
            n += batch.num_rows
            if n < 1 << 17:
                continue
            key, ids, x = (np.concatenate(v) for v in zip(*held, strict=True))
            whole = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if whole and (out := links(key[:whole], ids[:whole], x[:whole])) is not None:
                yield out
            held, n = [(key[whole:], ids[whole:], x[whole:])], len(key) - whole
        if n and (out := links(*(np.concatenate(v) for v in zip(*held, strict=True)))) is not None:
            yield out

    return run


def in_buckets(rows: DataFrame, radius: int, words: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(bucket_links(radius, words), "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, crowded: int = 20_000) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (column fp) within the radius."""
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(radius))]))
    keyed = fps.select(keys.alias("key"), "fp")
    counts = keyed.groupBy("key").count().where(F.col("count") > crowded).select("key")
    hot = cut(counts, "simhash-crowded")
    rows = keyed
    many = not hot.isEmpty()
    if many:
        rows = keyed.join(hot, "key", "left_anti")
    found = in_buckets(rows.select("key", F.col("fp").alias("id"), F.col("fp").alias("w0")), radius, 1)
    if many:
        members = keyed.join(hot, "key", "left_semi").select("fp").distinct()
        low, high = near_points(radius // 2), near_points(radius - radius // 2)
        near = members.select("fp", F.explode(F.array(*map(F.lit, high))).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("point"), "fp", (F.bit_count("x") <= radius // 2).alias("inner"))
        # an odd radius: one end within the smaller, the other within the larger half
        hubs = near.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("hub")).where("hub is not null") if len(low) != len(high) else near.groupBy("point").agg(F.min("fp").alias("hub"))
        found = found.unionByName(near.join(hubs, "point").where("hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", crowded: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id), one row a document."""
    prints = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = fingerprint_links(distinct.select("fp"), radius, crowded)
    roots = connected_components(edges)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(names, "root").select("fp", "component_id")
    out = prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumnRenamed("doc_id", id_col)


# ---- near copies: what SimHash links, and beyond it what shares four fifths of its shingles


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, tag, nameless, root): each document's key, whether its id is null, and its group.

    Two documents are near copies if their fingerprints link (``near_duplicates``), or if their sets of
    five-word shingles have a Jaccard similarity of 0.8 or more (``jaccard``); both are exact.
    """
    return _groups(_keyed(with_key(docs, id_col, text_col, "__kb_d", "__kb_tag"), id_col, text_col))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col("__kb_d").alias("d"), F.col("__kb_tag").alias("tag"), F.col(id_col).isNull().alias("nameless"), text_bytes(text_col).alias("text"))


def _groups(keyed: DataFrame) -> DataFrame:
    common, counts = jaccard.common_shingles(keyed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for part in small_batches(batches):
            texts = [t.as_py() for t in part["text"]]
            sets = [jaccard.shingle_set(t) for t in texts]
            ids = [jaccard.set_id(h) for h in sets]
            firsts, sketches = [], []
            for i, h in zip(ids, sets, strict=True):
                firsts.append(None if i in given else jaccard.prefix(h, common, counts).view(np.int64))
                sketches.append(None if i in given else jaccard.sketch(h).tobytes())
                if len(given) < 1 << 17:
                    given.add(i)
            yield pa.RecordBatch.from_arrays(
                [part["d"], part["tag"], part["nameless"], pa.array([fingerprint(t) for t in texts], pa.int64()), pa.array(ids, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["d", "tag", "nameless", "fp", "set", "n", "prefix", "sketch"],
            )

    prints = cut(keyed.mapInArrow(run, "d long, tag long, nameless boolean, fp long, set long, n long, prefix array<long>, sketch binary"), "simhash-prints").withColumn("node", F.xxhash64("fp", "set"))
    nodes = prints.select("node", "fp", "set").distinct()
    # nodes of one fingerprint, and nodes of one set, are linked to the least of them
    hub = lambda by: nodes.join(nodes.groupBy(by).agg(F.min("node").alias("a")), by).where("a <> node").select("a", F.col("node").alias("b"))

    def of_nodes(links: DataFrame, by: str) -> DataFrame:
        least = nodes.groupBy(by).agg(F.min("node").alias("node"))
        one = lambda end, name: least.select(F.col(by).alias(end), F.col("node").alias(name))
        return links.join(one("a", "x"), "a").join(one("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    edges = of_nodes(fingerprint_links(nodes.select("fp").distinct()), "fp").unionByName(of_nodes(jaccard.jaccard_links(prints, keyed), "set"))
    roots = connected_components(hub("fp").unionByName(hub("set")).unionByName(edges))
    return prints.join(roots, "node", "left").select("d", "tag", "nameless", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near copies, that of the least id; all columns are kept.

    Ids that are null come last; documents that share an id go by their texts' hashes; a row that is
    repeated stays once.
    """
    keyed = with_key(docs, id_col, text_col, "__kb_d", "__kb_tag")
    groups = _groups(_keyed(keyed, id_col, text_col))
    chosen = groups.groupBy("root").agg(F.min(F.struct("nameless", F.col("d").alias("__kb_d"), F.col("tag").alias("__kb_tag"))).alias("k")).select("k.__kb_d", "k.__kb_tag")
    return keyed.join(chosen, ["__kb_d", "__kb_tag"]).dropDuplicates(["__kb_d", "__kb_tag"]).select(*docs.columns)
