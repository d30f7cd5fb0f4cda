"""Suffix-array deduplication over bytes by longest-previous-factor (LPF) arrays.

Super-k-mer buckets bring together all strings that could match (see ``superkmers``).  Within whole
buckets a suffix array by prefix doubling orders the places, the previous and next smaller places in
suffix order give each place's earlier matches, and the longer of both is its LPF.  A place whose LPF
reaches the window repeats an earlier one.  ``later`` removes those copies and keeps the first; ``all``
also removes the earlier matches.  Of equal strings the first two take part, and those after them go as the second
does; windows of crowded buckets go by two 64-bit hashes.  Suffixes are ordered by as many bytes as the window has, equal
ones by place: matches beyond the window's length make no difference.

Null texts are empty; texts shorter than the window lose nothing; documents without an id come before the
ids from 0 on, and equal texts without ids are documents of their own; repeated rows (equal id and text) are one
document and get equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinbridge.llm.superkmers import Units, clean_texts, covered

WINDOW, GRAM = 400, 64
#: Places of a bucket that one worker solves in memory.
HOT = 6_000


def rank_levels(text: np.ndarray, left: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """(length, rank of each place's prefix of that length), by doubling; -1 where the string ends before.

    left: the bytes from each place to its string's end.  The last length is ``most``.  Where ranks are small three of
    them make a key, so that the length triples.
    """
    n = len(text)
    levels: list[tuple[int, np.ndarray]] = []
    size = min(8, most)
    at = np.flatnonzero(left >= size)
    key = np.zeros(len(at), np.uint64)
    for j in range(size):
        key = (key << np.uint64(8)) | text[at + j].astype(np.uint64)
    while True:
        rank = np.full(n, -1, np.int32)
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.ones(len(at), np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank[at[order]] = np.cumsum(fresh) - 1
        levels.append((size, rank))
        if size == most:
            return levels
        several = 3 if n < 1 << 21 and 2 * size < most else 2
        longer = min(several * size, most)
        at = np.flatnonzero(left >= longer)
        bits = np.uint64(64 // several)
        key = rank[at].astype(np.uint64)
        for k in range(1, several):
            key = (key << bits) | rank[at + (longer - size if k == several - 1 else size)].astype(np.uint64)
        size = longer


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each index the nearest index before it with a smaller value, -1 if none; by pointer jumping."""
    n = len(values)
    found = np.arange(n) - 1
    open_ = np.flatnonzero(found >= 0)
    open_ = open_[values[found[open_]] > values[open_]]
    jump = found.copy()
    while len(open_):
        # all indices between jump[i] and i have larger values, so what jump[i] has passed, i may pass too
        jump[open_] = jump[jump[open_]]
        ahead = jump[open_]
        open_ = open_[(ahead >= 0) & (values[np.maximum(ahead, 0)] > values[open_])]
    return jump


def common_length(a: np.ndarray, b: np.ndarray, left: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Bytes that the strings at places a and b share, at most the last level's length, in steps of the first level's."""
    most = levels[-1][0]
    total = np.zeros(len(a), np.int64)
    whole = levels[-1][1]
    same = (whole[a] >= 0) & (whole[a] == whole[b])
    total[same] = most
    rest = np.flatnonzero(~same)
    x, y = a[rest].copy(), b[rest].copy()
    for size, rank in reversed(levels[:-1]):
        ok = (left[x] >= size) & (left[y] >= size)
        ok &= rank[x] == rank[y]
        step = np.where(ok, size, 0)
        total[rest] += step
        x, y = np.minimum(x + step, len(left) - 1), np.minimum(y + step, len(left) - 1)
    total[rest] = np.minimum(total[rest], most - 1)
    return total


def longest_previous_factors(strings: list[bytes], most: int, lengths: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, LPF, its earlier match or -1, end of every string) of concatenated strings; LPFs count up to ``most``.

    Below ``most`` a figure is a lower bound in steps of eight bytes, or 0 without ``lengths``.  Matches never
    leave a string.  Equal strings have equal ranks, so ranks are made of each string once.
    """
    once: dict[bytes, int] = {}
    own = np.array([once.setdefault(s, len(once)) for s in strings], np.int64)
    text = np.frombuffer(b"".join(once), np.uint8)
    sizes = np.array([len(s) for s in once], np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    levels = rank_levels(text, left, most)
    # the places of all strings, copies too, and where their bytes are in the text of distinct strings
    all_sizes = sizes[own]
    ends = np.cumsum(all_sizes)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[own] - (ends - all_sizes), all_sizes)
    rank = levels[-1][1][at]
    places = np.flatnonzero(rank >= 0)
    suffixes = places[np.argsort(rank[places], kind="stable")]  # ties stay in order of place
    lpf, source = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), -1, np.int64)
    n = len(suffixes)
    for near in (smaller_before(suffixes), n - 1 - smaller_before(suffixes[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < n))
        a, b = suffixes[has], suffixes[near[has]]
        shared = common_length(at[a], at[b], left, levels) if lengths else np.where(rank[a] == rank[b], most, 0)
        better = shared > lpf[has]
        lpf[has[better]], source[has[better]] = shared[better], b[better]
    return suffixes, lpf, source, ends


def lpf_windows(window: int):
    def solve(strings: list[bytes], mode: str) -> tuple[np.ndarray, np.ndarray]:
        place, lpf, source, ends = longest_previous_factors(strings, window, lengths=False)
        hit = lpf >= window
        found = place[hit]
        if mode == "all":
            found = np.concatenate([found, source[hit]])
        found = np.unique(found)
        string = np.searchsorted(ends, found, side="right")
        return string, found - np.concatenate([[0], ends])[string]

    return solve


CLEANED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, mode: str = "later", id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row a document: its id, bytes, removed bytes and spans, and the bytes that stay, concatenated."""

    def clean(texts: list[bytes], runs: list) -> list[pa.Array]:
        rows = []
        for text, found in zip(texts, runs, strict=True):
            gone, kept, at = 0, [], 0
            cuts = covered(found or [], window, len(text))
            for a, b in cuts:
                kept.append(text[at:a])
                gone, at = gone + b - a, b
            out = b"".join([*kept, text[at:]])
            rows.append((len(text), gone, len(cuts), hashlib.sha256(out).hexdigest(), [{"start": a, "end": b} for a, b in cuts], out))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), SPANS, pa.binary()), strict=True)]

    return clean_texts(docs, Units("bytes", window, max(1, min(GRAM, window // 2))), mode, lpf_windows(window), clean, CLEANED, id_col, text_col, hot)
