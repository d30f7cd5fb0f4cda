"""Links between documents whose sets of word shingles have a Jaccard similarity of 4/5 or more, exactly.

Sets that are so similar share one of the first n - ceil(4n/5) + 1 shingles of either, in any order that
is common to all sets (prefix filter), and after the first that they share enough must be left in both
(positional filter, which implies the length filter).  Every pair that passes is a candidate; each
candidate's similarity is computed from its texts before it links.

The order is by hash, but shingles that occur twice or more in a sample of documents come last, so that a
common passage is no key of the documents that hold it.  The sample decides on cost alone, not on results.

Before its texts are fetched a pair must pass its sketches: each set has a bit for the parity of its
shingles' hashes, so two sketches differ in at most as many bits as the sets in shingles, and pairs that
differ in more than a ninth of their shingles are refused.  No pair that is alike is.

A bucket of up to ``few`` sets gives all its pairs.  A larger one, as of a large group of near copies,
first gives a spanning forest of the pairs that pass; once these are verified and their components known,
it gives all pairs that pass and lie in two components.  So no pair goes unseen that could join components,
and a large group does not cost all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import cut, discard, shingle_places, small_batches
from kinbridge.llm.components import connected_components

SHINGLE = 5
#: Distinct texts of the sample, about, and the most shingles that it puts last.
SAMPLE, COMMON = 20_000, 200_000
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the shingles; fewer words are one shingle, no words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, starts, ends = shingle_places(words, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts)))


def set_id(h: np.ndarray) -> int:
    x = xxhash.xxh3_64_intdigest(h.tobytes())
    return x - (1 << 64) if x >> 63 else x


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two shingle sets have a similarity of 4/5 or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first shingles in the common order; common is ascending."""
    n = len(h)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[at] == h, counts[at], 0)
    return h[np.argsort(rank, kind="stable")[: n + (-4 * n // 5) + 1]] if n else h


#: Bits of a sketch for each shingle, at least; their number is a power of two.
SKETCH = 4


def sketch(h: np.ndarray) -> np.ndarray:
    """The parity of the set's hashes at each value of their last bits, in 64-bit words."""
    bits = max(64, 1 << (SKETCH * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def halved(words: np.ndarray) -> np.ndarray:
    """Sketches, a row each, of half as many bits."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


class Sketches:
    """Sketches of sets by their width; sets whose widths differ by more than a factor of two are never alike."""

    def __init__(self, sketches: list[bytes], sizes: np.ndarray):
        self.sizes = sizes
        self.width = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        self.row = np.zeros(len(sketches), np.int64)
        self.full: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.row[at] = np.arange(len(at))
            self.full[w] = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), w)
        self.half = {w: halved(x) for w, x in self.full.items() if w // 2 in self.full}

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may be alike with one of the sets."""
        w, out = int(self.width[one]), np.zeros(len(others), bool)
        mine = self.full[w][self.row[one]]
        for v, words, x in ((w, self.full, mine), (2 * w, self.half, mine), (w // 2, self.full, halved(mine))):
            if v in words:
                at = np.flatnonzero(self.width[others] == v)
                k = others[at]
                differ = np.bitwise_count(words[v][self.row[k]] ^ x).sum(axis=1, dtype=np.int64)
                out[at] = 9 * differ <= self.sizes[k] + self.sizes[one]
        return out


def common_shingles(keyed: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles that several texts of a sample hold; keyed has tag, text."""
    every = max(1, keyed.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            found = [shingle_set(t.as_py()) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64))], names=["h"])

    texts = keyed.where(F.pmod(F.xxhash64("tag"), F.lit(every)) == 0).select("tag", "text").dropDuplicates(["tag"]).select("text")
    counts = texts.mapInArrow(run, "h long").groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = counts["h"].to_numpy().view(np.uint64), counts["count"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


#: A posting's size of set and place in its prefix are one long.
PLACE_BITS = 31


def may_be_alike(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    """Whether two sets may be alike that share their first shingle at these places; x and y: size, place.

    Implies the length filter.  At a later shared shingle it may refuse what it let pass at the first.
    """
    m, n, last = x >> PLACE_BITS, y >> PLACE_BITS, (1 << PLACE_BITS) - 1
    return 9 * np.minimum(m - (x & last), n - (y & last)) >= 4 * (m + n)


def whole_buckets(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], most: int = 1 << 17) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, cut between its values only."""
    held: list[list[np.ndarray]] = []
    n, limit = 0, most
    for batch in batches:
        held.append([batch[c].to_numpy(zero_copy_only=False) for c in names])
        n += batch.num_rows
        if n < limit:
            continue
        rows = [np.concatenate(v) for v in zip(*held, strict=True)]
        whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
        if whole:
            yield [v[:whole] for v in rows]
        held, n = [[v[whole:] for v in rows]], n - whole
        limit = max(most, 2 * n)
    if n:
        yield [np.concatenate(v) for v in zip(*held, strict=True)]


FOUND = "crowded boolean, a long, b long, n long"


def _found(crowded: bool, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), crowded)), pa.array(a), pa.array(b), pa.array(n)], names=["crowded", "a", "b", "n"])


def first_pairs(few: int) -> Run:
    """Candidate pairs (a < b) of buckets from rows (key, id, n) sorted by key and id; a crowded bucket's rows go on as (key, id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, n in whole_buckets(batches, ("key", "id", "n")):
            fresh = np.ones(len(key), bool)  # a set that several tasks saw
            fresh[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            key, ids, n = key[fresh], ids[fresh], n[fresh]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(edge, len(key)))
            small = np.repeat(sizes <= few, sizes)
            k, i, m = key[small], ids[small], n[small]
            a, b = [], []
            for lag in range(1, few):
                hit = np.flatnonzero(k[lag:] == k[:-lag])
                if not len(hit):
                    break
                hit = hit[may_be_alike(m[hit], m[hit + lag])]
                a.append(i[hit])
                b.append(i[hit + lag])
            if sum(map(len, a)):
                pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
                yield _found(False, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))
            if not small.all():
                yield _found(True, key[~small], ids[~small], n[~small])

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _crowded(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Each bucket's ids, places, sketches and further columns, from rows (key, id, n, sketch, ...) sorted by key."""
    for key, *columns in whole_buckets(batches, ("key", "id", "n", "sketch", *more), 1 << 14):
        edge = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield tuple(c[lo:hi] for c in columns)


def spanning_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a < b) that connect what all candidate pairs of a bucket connect, from rows (key, id, n, sketch) sorted by key and id."""
    for ids, n, words in _crowded(batches):
        sketches, left, a, b = Sketches(words.tolist(), n >> PLACE_BITS), np.arange(len(ids)), [], []
        while len(left) > 1:
            front, left = [int(left[0])], left[1:]
            for x in front:  # grows
                if not len(left):
                    break
                near = sketches.near(x, left) & may_be_alike(n[left], n[x])
                a.append(np.full(near.sum(), ids[x]))
                b.append(ids[left[near]])
                front += left[near].tolist()
                left = left[~near]
        if sum(map(len, a)):
            yield _pairs(np.concatenate(a), np.concatenate(b))


def pairs_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All candidate pairs (a < b) of buckets whose roots differ, from rows (key, id, n, sketch, root) sorted by key."""
    for ids, n, words, root in _crowded(batches, "root"):
        _, group, count = np.unique(root, return_inverse=True, return_counts=True)
        if len(count) == 1:
            continue
        order = np.argsort(count[group] * len(count) + group, kind="stable")  # the largest component last
        i, m, g = ids[order], n[order], group[order]
        sketches = Sketches(words[order].tolist(), m >> PLACE_BITS)
        ends = np.append(np.flatnonzero(g[1:] != g[:-1]) + 1, len(g))
        end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
        for at in range(int(ends[-2])):
            rest = end[at] + np.flatnonzero(may_be_alike(m[end[at] :], m[at]))
            hit = rest[sketches.near(at, rest)]
            if len(hit):
                yield _pairs(np.full(len(hit), i[at]), i[hit])


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches pass, from rows (a, b, x, y, sizes): their sketches and the sum of their sizes."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for k, (x, y, sizes) in enumerate(zip(batch["x"].to_pylist(), batch["y"].to_pylist(), batch["sizes"].to_pylist(), strict=True)):
            u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
            if len(v) == 2 * len(u):
                v = halved(v)
            keep[k] = len(u) == len(v) and 9 * int(np.bitwise_count(u ^ v).sum()) <= sizes
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep))


def check_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, id) that are alike, from rows (a, salt, id, text) sorted so that a's own text comes before its partners'."""
    group = last = None
    first = np.empty(0, np.uint64)
    for batch in batches:
        out = []
        for a, salt, own, text in zip(batch["a"].to_pylist(), batch["salt"].to_pylist(), batch["id"].to_pylist(), batch["text"], strict=True):
            if (a, salt, own) == last:  # a document listed twice
                continue
            last = (a, salt, own)
            if (a, salt) != group:
                if a != own:
                    raise RuntimeError("a pair without its first text")
                group, first = (a, salt), shingle_set(text.as_py())
            elif alike(first, shingle_set(text.as_py())):
                out.append((a, own))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def some_of(keyed: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of keyed whose key may be in needed: it is, or shares one of 2**23 bits with one that is.  Saves a shuffle of all texts."""
    at = F.xxhash64("d", "tag")
    word, bit = F.shiftrightunsigned(at, 6).bitwiseAND(F.lit((1 << 17) - 1)).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)
    bits = needed.select(word.alias("word"), one(bit).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = keyed.withColumn("word", word).join(F.broadcast(bits), "word")
    return found.where(F.col("bits").bitwiseAND(one(bit)) != 0).drop("word", "bits")


def verified(pairs: DataFrame, keyed: DataFrame, holders: DataFrame, most: int = 256) -> DataFrame:
    """The pairs (a < b) of sets that are alike; holders: (id, d, tag), a document of each set; keyed: d, tag, text.

    The text of a travels once for its partners, or once for about ``most`` of them.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = cut(pairs.distinct(), "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    salted = pairs.join(pairs.groupBy("a").count(), "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / most)).alias("salt"), "b")
    ends = salted.select("a", "salt", F.col("b").alias("id")).unionByName(salted.select("a", "salt", F.col("a").alias("id")).distinct())
    needed = cut(holders.join(ends.select("id").distinct(), "id"), "jaccard-needed")
    texts = some_of(keyed, needed).join(needed, ["d", "tag"]).select("id", "text")
    rows = ends.join(texts, "id").select("a", "salt", "id", "text")
    links = cut(rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "id").mapInArrow(check_pairs, "a long, b long"), "jaccard-links")
    discard(pairs)
    discard(needed)
    return links


def jaccard_links(prints: DataFrame, keyed: DataFrame, few: int = 24) -> DataFrame:
    """Edges (a, b) of set ids whose components are those of all pairs of sets that are alike.

    prints: d, tag, set, n, prefix and sketch (null where the task gave the set's before); keyed: d, tag, text.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = prints.where("prefix is not null")
    posts = firsts.select(F.posexplode("prefix").alias("place", "key"), F.col("set").alias("id"), "n")
    posts = posts.select("key", "id", F.shiftleft("n", PLACE_BITS).bitwiseOR(F.col("place")).alias("n"))
    found = cut(posts.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(first_pairs(few), FOUND), "jaccard-found", ["crowded"])
    holders = prints.groupBy(F.col("set").alias("id")).agg(F.min(F.struct("d", "tag")).alias("h")).select("id", "h.d", "h.tag")
    sketches = firsts.select(F.col("set").alias("id"), "n", "sketch").dropDuplicates(["id"])
    of = lambda end, name: sketches.select(F.col("id").alias(end), F.col("sketch").alias(name), F.col("n").alias(f"n_{name}"))
    pairs = found.where("not crowded").select("a", "b").distinct().join(of("a", "x"), "a").join(of("b", "y"), "b")
    pairs = pairs.select("a", "b", "x", "y", (F.col("n_x") + F.col("n_y")).alias("sizes")).mapInArrow(near_pairs, "a long, b long")
    crowded = found.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("id"), "n")
    if crowded.isEmpty():
        return verified(pairs, keyed, holders)
    crowded = cut(crowded.join(sketches.drop("n"), "id"), "jaccard-crowded")
    in_buckets = lambda rows, run: rows.repartition(parts, "key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long")
    links = verified(pairs.unionByName(in_buckets(crowded.select("key", "id", "n", "sketch"), spanning_pairs)), keyed, holders)
    discard(found)
    roots = connected_components(links).withColumnRenamed("node", "id")
    rows = crowded.join(roots, "id", "left").select("key", "id", "n", "sketch", F.coalesce("root", "id").alias("root"))
    return links.unionByName(verified(in_buckets(rows, pairs_across), keyed, holders))
