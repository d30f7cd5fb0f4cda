"""Super-k-mers: consecutive windows of a text that share a minimiser, dealt to buckets by it.

A text is a sequence of units (bytes or words) with a 64-bit code each.  A window is ``window``
consecutive units of one document; its minimiser is the leftmost k-gram of least hash in it, which
depends on the window's content alone, so equal windows always meet in the bucket of their minimiser.
Consecutive windows with the same minimiser occurrence form a super-k-mer, packed as one string.

Equal strings count once and a second time, whatever their number:

1. ``scatter`` sends each super-k-mer to its bucket as (bucket, digest, document, place).  Of the equal
   strings of a batch only the first two travel; whatever comes after two equals is repeated for sure.
2. ``gather`` streams each bucket, sorted, in constant memory, and again keeps the first two places of each
   string, of the buckets that have two places or more.
3. The string of each first place travels packed to its bucket, the second place beside it, and the caller's
   ``solve`` decides each window of both.
4. Of a bucket of over ``hot`` places, as of a passage that many texts surround differently, each window
   travels by itself, as two hashes and a place, and is streamed in constant memory too.

Two digests of 64 bits, the bucket's and the string's, must agree for strings to count as equal.
Results are runs of windows (document key d, tag, first window, count).  ``mode`` is ``later`` (every
occurrence of a window but the first, in order of document and place) or ``all`` (every occurrence of
a window that occurs twice or more).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import COUNT_BITS, NULL_ID, START_BITS, cut, small_batches, text_bytes, text_hash, with_key

POS_MASK = np.uint64((1 << 31) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
RUNS = "d long, tag long, place long"
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ROWS = "kind byte, h long, sig long, d long, tag long, place long"
#: Texts are hashed in tiles of so many units; windows that cross a border are seen once.
TILE = 1 << 19
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Units:
    """``code``: text to (unit codes, units); ``pack``: units of a range to one string, and back."""

    kind: str
    window: int
    k: int

    @property
    def span(self) -> int:
        return self.window - self.k + 1

    def read(self, text: bytes) -> bytes | list[bytes]:
        return text if self.kind == "bytes" else text.split()

    def pack(self, units: bytes | list[bytes]) -> bytes:
        return units if self.kind == "bytes" else b" ".join(units)

    def codes(self, units: bytes | list[bytes], memo: dict[bytes, int]) -> np.ndarray:
        if self.kind == "bytes":
            return _BYTE_CODES[np.frombuffer(units, np.uint8)]
        out = np.empty(len(units), np.uint64)
        digest = xxhash.xxh3_64_intdigest
        if len(memo) > 100_000:
            memo.clear()
        for i, w in enumerate(units):
            c = memo.get(w)
            if c is None:
                c = digest(w)
                if len(w) < 64:
                    memo[w] = c
            out[i] = c
        return out


_BYTE_CODES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)
_powers = np.ones(0, np.uint64), np.ones(0, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, TILE + 4096)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram: a polynomial by prefix sums, then mixed."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up, out=sums[1:])
        h = (sums[k:] - sums[:n]) * down[:n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def window_anchors(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` k-grams the place of its leftmost least hash."""
    keys = (h & ~POS_MASK) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= span:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if span > size:
        keys = np.minimum(keys[: len(keys) - (span - size)], keys[span - size :])
    return (keys & POS_MASK).astype(np.int64)


def super_kmers(codes: np.ndarray, owner_end: np.ndarray, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts: (bucket hash, first window, windows).  owner_end: each unit's text's end."""
    h = gram_hashes(codes, units.k)
    if len(codes) < units.window:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    at = window_anchors(h, units.span)
    n = len(at)
    valid = np.arange(n) + units.window <= owner_end[:n]
    key = np.where(valid, at, -1)
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    first = np.concatenate([[0], edge])
    count = np.diff(np.concatenate([first, [n]]))
    keep = valid[first]
    first, count = first[keep], count[keep]
    return h[at[first]], first, count


def place_of(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start << COUNT_BITS) | count


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def combined(h: np.ndarray, sig: np.ndarray, d: np.ndarray, tag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """The first two places of each string (kind 0), and those after two equals (kind 1), which are settled."""
    h, sig = h.view(np.int64), sig.view(np.int64)
    order = np.lexsort((place, tag, d, sig, h))
    h, sig, d, tag, place = (x[order] for x in (h, sig, d, tag, place))
    fresh = np.ones(len(h), bool)  # the same document listed twice
    fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1])
    h, sig, d, tag, place = (x[fresh] for x in (h, sig, d, tag, place))
    third = np.zeros(len(h), bool)
    third[2:] = (h[2:] == h[:-2]) & (sig[2:] == sig[:-2])
    # settled rows only pass through: any spread of bucket hashes will do for them
    with np.errstate(over="ignore"):
        h = np.where(third, d * np.int64(0x9E3779B1) ^ place, h)
    return _table(kind=third.astype(np.int8), h=h, sig=np.where(third, 0, sig), d=d, tag=tag, place=place)


def scatter(units: Units) -> Run:
    """Rows (kind 0: bucket hash, digest, document, place; kind 1: a run that is settled already)."""

    def tiles(d: list[int], tag: list[int], texts: list[bytes]):
        for key, t, text in zip(d, tag, texts, strict=True):
            seq = units.read(text)
            for at in range(0, max(1, len(seq) - units.window + 1), TILE):
                yield key, t, at, seq[at : at + TILE + units.window - 1]

    def flush(part: list, memo: dict) -> pa.RecordBatch | None:
        part = [p for p in part if len(p[3]) >= units.window]
        if not part:
            return None
        sizes = np.array([len(p[3]) for p in part])
        if units.kind == "bytes":
            data = b"".join(p[3] for p in part)
            codes = units.codes(data, memo)
            view = memoryview(data)
        else:
            codes = np.concatenate([units.codes(p[3], memo) for p in part])
            view = memoryview(codes.view(np.uint8))
        ends = np.cumsum(sizes)
        h, first, count = super_kmers(codes, np.repeat(ends, sizes), units)
        if not len(h):
            return None
        wide = 1 if units.kind == "bytes" else 8
        digest = xxhash.xxh3_64_intdigest
        a, b = first * wide, (first + count + units.window - 1) * wide
        sig = np.fromiter((digest(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
        own = np.searchsorted(ends, first, side="right")
        start = first - (ends - sizes)[own] + np.array([p[2] for p in part])[own]
        d = np.array([p[0] for p in part], np.int64)[own]
        tag = np.array([p[1] for p in part], np.int64)[own]
        return combined(h, sig, d, tag, place_of(start, count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in small_batches(batches):
            part, size = [], 0
            for tile in tiles(batch["d"].to_pylist(), batch["tag"].to_pylist(), batch["text"].to_pylist()):
                part.append(tile)
                size += len(tile[3]) * (1 if units.kind == "bytes" else 6)
                if size >= BATCH_BYTES:
                    if (out := flush(part, memo)) is not None:
                        yield out
                    part, size = [], 0
            if (out := flush(part, memo)) is not None:
                yield out

    return run


FOUND = "rep boolean, second boolean, h long, sig long, n int, d long, tag long, place long"


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted buckets; out: settled runs, and the first two places of each string (rep), numbered in their bucket.

    A bucket of one place gives nothing.
    """
    held: tuple | None = None  # the last row; its rank among its equals; its number; whether it waits for a second row
    for batch in batches:
        kind, h, sig, d, tag, place = (batch[c].to_numpy(zero_copy_only=False) for c in ("kind", "h", "sig", "d", "tag", "place"))
        if (done := kind == 1).any():
            none = np.zeros(done.sum(), bool)
            yield _table(rep=none, second=none, h=h[done], sig=sig[done], n=none.astype(np.int32), d=d[done], tag=tag[done], place=place[done])
            h, sig, d, tag, place = (x[~done] for x in (h, sig, d, tag, place))
        if not len(h):
            continue
        if held is not None:
            h, sig, d, tag, place = (np.concatenate([[v], x]) for v, x in zip(held[0], (h, sig, d, tag, place), strict=True))
        fresh = np.ones(len(h), bool)  # the same document listed twice, in different tasks
        fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1])
        h, sig, d, tag, place = (x[fresh] for x in (h, sig, d, tag, place))
        top, lead = np.ones(len(h), bool), np.ones(len(h), bool)
        top[1:] = h[1:] != h[:-1]
        lead[1:] = top[1:] | (sig[1:] != sig[:-1])
        at = np.arange(len(h))
        rank = at - np.maximum.accumulate(np.where(lead, at, 0))
        first_string, bucket = np.cumsum(lead) == 1, np.cumsum(top) - 1
        if held is not None:
            rank[first_string] += held[1]
        rep = rank < 2
        number = np.cumsum(rep) - 1
        number = number - number[top][bucket]
        several = np.bincount(bucket) > 1
        if held is not None:
            number[bucket == 0] += held[2]
            several[0] |= not held[3]
        out = several[bucket]
        last = (h[-1], sig[-1], d[-1], tag[-1], place[-1]), min(int(rank[-1]), 2), int(number[-1]), not several[-1]
        if held is not None and not held[3]:
            out[0] = False  # it is out already
        held = last
        if out.any():
            yield _table(rep=rep[out], second=rank[out] == 1, h=h[out], sig=sig[out], n=number[out].astype(np.int32), d=d[out], tag=tag[out], place=place[out])


#: kind 0: a place and its string (null: that of the row before); 1: a window by its hashes; 2: a run that is settled.
PACKED = "kind byte, h long, sig long, packed binary, d long, tag long, place long"


def unpack(units: Units, most: int = 50_000) -> Run:
    """The packed strings of the wanted places, cut out of their texts; of hot buckets each window's hashes."""

    def windows(out: list[tuple]) -> pa.RecordBatch:
        h, sig, d, tag, start = zip(*out, strict=True)
        found = combined(np.array(h, np.uint64), np.array(sig, np.uint64), np.array(d, np.int64), np.array(tag, np.int64), place_of(np.array(start, np.int64), 1))
        kind = pc.add(found["kind"], pa.scalar(1, pa.int8()))
        return pa.RecordBatch.from_arrays([kind, found["h"], found["sig"], pa.nulls(found.num_rows, pa.binary()), found["d"], found["tag"], found["place"]], names=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        single: list[tuple] = []
        for batch in small_batches(batches):
            out: list[tuple] = []
            size = 0
            for text, d, tag, reps in zip(*(batch[c].to_pylist() for c in ("text", "d", "tag", "reps")), strict=True):
                seq = units.read(text)
                for rep in reps:
                    place = rep["place"]
                    start, count = (place >> COUNT_BITS) & ((1 << START_BITS) - 1), place & ((1 << COUNT_BITS) - 1)
                    if rep["hot"]:
                        for at in range(start, start + count):
                            window = units.pack(seq[at : at + units.window])
                            single.append((digest(window), digest(window, 1), d, tag, at))
                        continue
                    out.append((0, rep["h"], rep["sig"], units.pack(seq[start : start + count + units.window - 1]), d, tag, place))
                    size += len(out[-1][3])
                    if size > 2 * BATCH_BYTES:
                        yield _packed(out)
                        out, size = [], 0
                if len(single) > most:
                    yield windows(single)
                    single = []
            if out:
                yield _packed(out)
        if single:
            yield windows(single)

    return run


_PACKED = ["kind", "h", "sig", "packed", "d", "tag", "place"]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_PACKED)


def repeated(mode: str) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
    """Of single windows, batch by batch in order of hashes and place, those that the mode asks for."""
    last: tuple | None = None  # the last row, and whether it is out

    def take(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        nonlocal last
        h, sig, d, tag, place = (batch[c].to_numpy(zero_copy_only=False) for c in ("h", "sig", "d", "tag", "place"))
        if last is not None:
            h, sig, d, tag, place = (np.concatenate([[v], x]) for v, x in zip(last[0], (h, sig, d, tag, place), strict=True))
        fresh = np.ones(len(h), bool)  # the same document listed twice
        fresh[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (d[1:] != d[:-1]) | (tag[1:] != tag[:-1]) | (place[1:] != place[:-1])
        h, sig, d, tag, place = (x[fresh] for x in (h, sig, d, tag, place))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (sig[1:] == sig[:-1])
        out = again.copy()
        if mode == "all":
            out[:-1] |= again[1:]
        if last is not None and last[1]:
            out[0] = False
        last = (h[-1], sig[-1], d[-1], tag[-1], place[-1]), bool(out[-1]) or (last is not None and len(h) == 1 and last[1])
        return _table(d=d[out], tag=tag[out], place=place[out]) if out.any() else None

    return take


Solve = Callable[[list[bytes], str], tuple[np.ndarray, np.ndarray]]


def settle(units: Units, mode: str, solve: Solve, chunk: int = 3 * BATCH_BYTES // 4) -> Run:
    """Runs of windows that ``solve`` finds among the strings of whole buckets, and of windows that travelled alone.

    solve(strings, mode) gets strings in order of bucket, document and place and returns (string,
    window) pairs, ascending.
    """

    def answer(rows: list[tuple]) -> pa.RecordBatch | None:
        rows.sort(key=lambda r: (r[0], r[3], r[4], r[5]))
        string, window = solve([r[2] for r in rows], mode)
        if not len(string):
            return None
        first = np.ones(len(string), bool)
        first[1:] = (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(string)))
        d, tag, place = (np.array([r[k] for r in rows], np.int64)[string[at]] for k in (3, 4, 5))
        return _table(d=d, tag=tag, place=((place >> COUNT_BITS) + window[at] << COUNT_BITS) | count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # h, sig, string, d, tag, place
        size, seen, alone = 0, None, repeated(mode)
        for batch in batches:
            kind = batch["kind"].to_numpy(zero_copy_only=False)
            ends = np.searchsorted(kind, [0, 1, 2], side="right")  # kinds are in order
            for h, sig, packed, d, tag, place in zip(*(batch[c].slice(0, ends[0]).to_pylist() for c in _PACKED[1:]), strict=True):
                if (h, sig, d, tag, place) == seen:  # the same document listed twice
                    continue
                if packed is None:
                    if not rows or rows[-1][:2] != (h, sig):
                        raise RuntimeError("a second place without its first")
                    packed = rows[-1][2]
                elif size > chunk and h != rows[-1][0]:
                    if (out := answer(rows)) is not None:
                        yield out
                    rows, size = [], 0
                seen = (h, sig, d, tag, place)
                rows.append((h, sig, packed, d, tag, place))
                size += len(packed)
            if ends[1] > ends[0] and (out := alone(batch.slice(ends[0], ends[1] - ends[0]))) is not None:
                yield out
            if ends[2] > ends[1]:
                yield batch.slice(ends[1]).select(["d", "tag", "place"])
        if rows and (out := answer(rows)) is not None:
            yield out

    return run


#: Reps of a bucket that meet in one key when hot buckets are marked.
MARKED = 256


def find_runs(texts: DataFrame, units: Units, mode: str, solve: Solve, hot: int) -> DataFrame:
    """Rows (d, tag, runs: array of (start, count)), one for each document with a run; texts has d, tag, text."""
    if units.span >> COUNT_BITS:
        raise ValueError(f"a super-k-mer may hold {units.span} windows, over {(1 << COUNT_BITS) - 1}: choose longer k-grams")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    rows = texts.select("d", "tag", "text").mapInArrow(scatter(units), ROWS)
    found = rows.repartition(parts, "h").sortWithinPartitions("kind", "h", "sig", "d", "tag", "place").mapInArrow(gather, FOUND)
    found = cut(found, f"{units.kind}-found", ["rep"])
    settled, reps = found.where("not rep"), found.where("rep")
    crowded = reps.where(F.col("n") == hot).select("h")
    if crowded.isEmpty():
        reps = reps.withColumn("hot", F.lit(False))
    else:
        # what comes after the hot-th is hot for sure; the others of its bucket are told in groups, so no key is heavy
        groups = crowded.select("h", F.explode(F.sequence(F.lit(0), F.lit((hot - 1) // MARKED))).alias("g"), F.lit(True).alias("hot"))
        told = reps.where(F.col("n") < hot).withColumn("g", F.floor(F.col("n") / MARKED).cast("int")).join(groups, ["h", "g"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        reps = told.drop("g").unionByName(reps.where(F.col("n") >= hot).withColumn("hot", F.lit(True)))
    wanted = reps.where("hot or not second").groupBy("d", "tag").agg(F.collect_list(F.struct("place", "h", "sig", "hot")).alias("reps"))
    packed = texts.join(wanted, ["d", "tag"]).select("d", "tag", "text", "reps").mapInArrow(unpack(units), PACKED)
    beside = reps.where("second and not hot").select(F.lit(0).cast("byte").alias("kind"), "h", "sig", F.lit(None).cast("binary").alias("packed"), "d", "tag", "place")
    packed = packed.unionByName(beside).repartition(parts, "h").sortWithinPartitions("kind", "h", "sig", "d", "tag", "place")
    solved = cut(packed.mapInArrow(settle(units, mode, solve), RUNS), f"{units.kind}-runs")
    both = settled.select("d", "tag", "place").unionByName(solved)
    start = F.shiftright("place", COUNT_BITS).bitwiseAND(F.lit((1 << START_BITS) - 1))
    return both.groupBy("d", "tag").agg(F.collect_list(F.struct(start.alias("start"), F.col("place").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).alias("count"))).alias("runs"))


#: Of (texts, runs of each or None) the result's columns after the id.
Clean = Callable[[list[bytes], list[list[dict] | None]], list[pa.Array]]


def clean_texts(docs: DataFrame, units: Units, mode: str, solve: Solve, clean: Clean, schema: str, id_col: str, text_col: str, hot: int) -> DataFrame:
    """A row a document: its id and what ``clean`` makes of its text and runs.

    Equal texts without ids are documents of their own, but after the second all fare alike: they are counted,
    two take part, and the result of the second stands for the rest.
    """
    key = docs.schema[id_col].dataType.simpleString()
    named = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").withColumn("text", text_bytes("text"))
    texts, alone = named, None
    if not docs.where(F.col(id_col).isNull()).isEmpty():
        named = texts = named.where("id is not null")
        counted = docs.where(F.col(id_col).isNull()).select(text_bytes(text_col).alias("text"), text_hash(text_col).alias("x"), text_hash(text_col, 1).alias("y"))
        counted = cut(counted.groupBy("x", "y").agg(F.first("text").alias("text"), F.count("*").alias("n")), f"{units.kind}-nameless")
        each = F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(1).alias("copy"), (F.col("n") - 1).alias("n")))).alias("c")
        alone = counted.select("x", "y", "text", each).select(F.xxhash64("y", "c.copy").bitwiseOR(F.lit(NULL_ID)).alias("d"), F.col("x").alias("tag"), "text", "c.n").where("n > 0")
        texts = texts.select("d", "tag", "text").unionByName(alone.select("d", "tag", "text"))
    runs = find_runs(texts, units, mode, solve, hot)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch["id"], *clean(batch["text"].to_pylist(), batch["runs"].to_pylist())], names=["id", *names])

    done = named.join(runs, ["d", "tag"], "left").select("id", "text", "runs").mapInArrow(run, f"id {key}, {schema}")
    if alone is not None:
        more = alone.join(runs, ["d", "tag"], "left").select(F.col("n").alias("id"), "text", "runs").mapInArrow(run, f"id long, {schema}")
        blocks = more.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("id") - 1) / 10_000))).alias("block")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rest = F.least(F.lit(10_000).cast("long"), F.col("id") - 10_000 * F.col("block"))
        done = done.unionByName(blocks.select(F.explode(F.sequence(F.lit(1).cast("long"), rest)).alias("k"), *names).select(F.lit(None).cast(key).alias("id"), *names))
    return done.withColumnRenamed("id", id_col)


def covered(runs: list[dict], window: int, n: int) -> list[tuple[int, int]]:
    """Maximal ranges of units that the windows of the runs cover."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], min(n, r["start"] + r["count"] + window - 1)) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
