"""Benchmark decontamination by pigeonhole edit matching.

Each item is split into its error budget plus one pieces, so a passage within the budget keeps one piece
untouched.  Pieces are found exactly, by one Aho-Corasick automaton a block of items, and around each
hit Myers' bit-parallel distance verifies growing groups of pieces and at last the whole item.  Letters
are lower-cased and runs of white space are one space, in items and in documents; spans are code points of
the original text.

Null, empty and blank texts and items match nothing; items too short for an error must occur exactly;
repeated items and repeated documents each get their own rows, ties go to the earliest end; a
passage that occurs often in a text gives one row with the best occurrence and their number; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import small_batches

#: One error for so many characters of an item.
CHARS_PER_ERROR = 10
#: Items of so many characters together make one block: the bound of what is broadcast at once.
BLOCK_CHARS = 4_000_000
FOUND = "distance int, budget int, start long, end long, n_places long"


def plain(text: str) -> str:
    """Lower case and plain spaces, code point for code point."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
    for c in "\n\t\r\x0b\x0c\xa0  　":
        if c in low:
            low = low.replace(c, " ")
    return low


def squeezed(text: str) -> tuple[str, np.ndarray | None]:
    """Runs of spaces as one, and where each character left was; None if there is no run."""
    if "  " not in text:
        return text, None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep].tobytes().decode("utf-32-le", "surrogatepass"), np.flatnonzero(keep)


def pieces(item: str, budget: int) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """budget + 1 pieces of near equal length: (offset, piece, the groups above it); they cover the item.

    A group of c neighbouring pieces may hold c - 1 errors.  Where a group keeps to that, one of its two
    halves does too, so some piece is untouched and every group above it keeps to its share.  Groups are
    (start, end, errors), from the smallest up, without the whole item.
    """
    n = budget + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    out = []
    for i in range(n):
        above, lo, hi = [], 0, n
        while hi - lo > 1:
            above.append((edges[lo], edges[hi], hi - lo - 1))
            middle = (lo + hi) // 2
            lo, hi = (lo, middle) if i < middle else (middle, hi)
        if edges[i + 1] > edges[i]:
            out.append((edges[i], item[edges[i] : edges[i + 1]], above[:0:-1]))
    return out


def letters(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> list[tuple[int, int]]:
    """(end, distance) of every place where a pattern of length m ends within the budget: Myers 1999."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, out = full, 0, m, []
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph <<= 1  # the first row is free: an occurrence may start anywhere
        mh <<= 1
        up = (mh & full) | (full & ~(xv | ph))
        down = ph & xv & full
        if score <= budget:
            out.append((j + 1, score))
    return out


def holds(masks: dict[str, int], start: int, m: int, text: str, budget: int) -> bool:
    """Whether the pattern's part [start, start + m) ends somewhere in the text within the budget."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        eq = (masks.get(c, 0) >> start) & full
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= budget:
                return True
        ph <<= 1
        up = ((mh << 1) & full) | (full & ~(xv | ph))
        down = ph & xv & full
    return False


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[object, str]], chars_per_error: int = CHARS_PER_ERROR):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple]] = {}
        for key, raw in items:
            text = " ".join(plain(raw or "").split())
            if not text:
                continue
            budget = len(text) // chars_per_error
            for at, piece, above in pieces(text, budget):
                where.setdefault(piece, []).append((len(self.items), at, above))
            self.items.append((key, text, budget, letters(text), letters(text[::-1])))
        self.machine = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.machine.add_word(piece, (len(piece), uses))
        if where:
            self.machine.make_automaton()
        self.empty = not where

    def find(self, raw: str) -> list[tuple]:
        """(item key, distance, budget, start, end, places) of each item that the text holds."""
        if self.empty or not raw:
            return []
        text, origin_of = squeezed(plain(raw))
        windows: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.machine.iter(text):
            begin = last + 1 - size
            for item, at, above in uses:
                _, pattern, budget, masks, _ = self.items[item]
                n, origin = len(pattern), begin - at
                if not all(holds(masks, s, e - s, text[max(0, origin + s - k) : origin + e + k], k) for s, e, k in above):
                    continue
                a, b = max(0, origin - budget), min(len(text), origin + n + budget)
                windows.setdefault(item, []).append([a, b])
        out = []
        for item, spans in windows.items():
            key, pattern, budget, masks, backward = self.items[item]
            if not budget:  # a piece is the whole item
                spans.sort()
                a, b = spans[0]
                out.append((key, 0, 0, a, b, len(spans)))
                continue
            spans.sort()
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best, places = None, 0
            for a, b in merged:
                hits = myers(masks, len(pattern), text[a:b], budget)
                if not hits:
                    continue
                run = -len(pattern)
                for end, _ in hits:  # ends closer than half an item are one place
                    if end - run > len(pattern) // 2:
                        places += 1
                    run = end
                end, distance = min(hits, key=lambda x: (x[1], x[0]))
                if best is None or distance < best[0]:
                    best = (distance, a, a + end)
            if best:
                distance, low, end = best
                low = max(low, end - len(pattern) - budget)
                tail = min(x for x in myers(backward, len(pattern), text[low:end][::-1], budget) if x[1] == distance)
                out.append((key, distance, budget, end - tail[0], end, places))
        if origin_of is not None:
            out = [(*row[:3], int(origin_of[row[3]]), int(origin_of[row[4] - 1]) + 1, row[5]) for row in out]
        return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of a bounded size, read one partition at a time."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end, n_places) for each item that a document holds.

    The items are the stated query set, matched against all documents in blocks; each block is one
    broadcast of at most block_chars characters and one item.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    item_key = items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item_key}, {FOUND}"
    source = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searcher(block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = None
            for part in small_batches(batches):
                matcher = matcher or Matcher(shared.value, chars_per_error)
                rows, own = [], []
                for i, text in enumerate(part["text"]):
                    for row in matcher.find(text.as_py()):
                        rows.append(row)
                        own.append(i)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    ids = part["doc_id"].take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(columns[0], pa.int64() if item_key == "bigint" else None), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=["doc_id", "item_id", "distance", "budget", "start", "end", "n_places"])

        return source.mapInArrow(run, schema)

    found = None
    for block in item_blocks(items, item_id, item_text, block_chars):
        part = searcher(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = source.sparkSession.createDataFrame([], schema)
    return found.withColumnsRenamed({"doc_id": id_col, "item_id": item_id})


def remove_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", chars_per_error: int = CHARS_PER_ERROR, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns; each row is judged by its own text, in place."""
    spark = docs.sparkSession

    def keeper(block):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in small_batches(batches, text_col):
                matcher = matcher or Matcher(shared.value, chars_per_error)
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch[text_col]], pa.bool_()))

        return run

    for block in item_blocks(items, item_id, item_text, block_chars):
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs
