"""Quality rules: gradient-boosted trees over document statistics.

Base rules and statistics count words ``[^\\x20\\x09-\\x0D]+`` of whole texts.  The trees are grown in
numpy on a bounded sample of labelled rows, with scores that never rise in the features of ``FALLING``,
flattened into node arrays and applied to whole batches at once.

Null and empty texts have no words and fail the base rules; rows without a label are only scored;
repeated rows get equal results; without any label of both classes the trees keep all that passes the base
rules; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinbridge.llm.common import cut, small_batches

MIN_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Labelled rows that the trees are grown on, by least hash of the id: the bound of what the driver gathers.
TRAIN_ROWS = 20_000
KEEP_AT = 0.3
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share", "distinct_share", "symbol_words", "line_words", "letterless_words")
#: Features in which the score never rises.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "symbol_words", "letterless_words")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"[0-9]+")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]+")
_LETTERLESS = re.compile(rb"(?<![^\x20\x09-\x0d])[\x21-\x40\x5b-\x60\x7b-\x7e]+(?![^\x20\x09-\x0d])")
_SYMBOL_WORDS = re.compile(rb"[#*$%&|<>]+(?![^\x20\x09-\x0d])")


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words inside three-word windows that occur twice or more, distinct words)."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(ids) < 4:
        return 0, len(number)
    d = len(number)
    # exact keys: pairs are numbered before the third word is added where three would not fit 63 bits
    pair = ids[:-1] * d + ids[1:]
    if d >= 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * d + ids[2:]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(len(ids), bool)
    for j in range(3):
        inside[j : j + len(key)] |= again
    return int(inside.sum()), d


def _size(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base counts of STATS and the values of FEATURES."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in data.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeat, distinct = repeated_words(words)
    most = max(1, chars)
    features = [
        float(np.log1p(n)), chars / max(1, n), symbols / most, dup / max(1, len(lines)), repeat / max(1, n), _size(_UPPER, text) / most, _size(_DIGITS, text) / most,
        _size(_PUNCTUATION, text) / most, distinct / max(1, n), len(_SYMBOL_WORDS.findall(data)) / max(1, n), n / max(1, len(lines)), len(_LETTERLESS.findall(data)) / max(1, n),
    ]
    return [n, chars, symbols, dup, repeat], features


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x))) if len(x) else np.empty(0)


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least_weight: float = 2.0) -> Trees:
    """Boosted trees for log loss on histograms.  signs: -1 where the score must not rise, 1 not fall, 0 free.

    A constrained split is taken only if its children's values are in order; their midpoint bounds what
    grows below, so whole trees, and so their sum, are monotone.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))

        def leaf(rows: np.ndarray, low: float, high: float, g=g, h=h) -> float:
            return float(np.clip(-g[rows].sum() / (h[rows].sum() + l2), low, high))

        def split(rows: np.ndarray, level: int, low: float, high: float, g=g, h=h) -> int:
            me = len(nodes)
            nodes.append([0, 0.0, me, me, 0.0])
            best, total_g, total_h = (1e-6, 0, 0, 0.0), g[rows].sum(), h[rows].sum()
            if level < depth and total_h >= 2 * least_weight:
                parent = total_g**2 / (total_h + l2)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                    ok = (hl >= least_weight) & (hr >= least_weight) & (signs[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gl**2 / (hl + l2) + gr**2 / (hr + l2) - parent, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f + 1, k, float((vl[k] + vr[k]) / 2))
            if not best[1]:
                nodes[me][4] = rate * leaf(rows, low, high)
                margin[rows] += nodes[me][4]
                return me
            _, f, k, middle = best
            f -= 1
            go = binned[rows, f] <= k
            bounds = ((low, high), (low, high)) if not signs[f] else ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle))
            a = split(rows[go], level + 1, *bounds[0])
            b = split(rows[~go], level + 1, *bounds[1])
            nodes[me] = [f, float(edges[f][k]), a, b, 0.0]
            return me

        split(np.arange(len(y)), 0, -np.inf, np.inf)
    table = np.array(nodes)
    return Trees(table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4], np.array(roots), depth, base)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the base counts, x: the features) of every row."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            counts, features = zip(*(statistics(t.as_py() or "") for t in part["text"]), strict=True)
            names = [c.split()[0] for c in STATS.split(", ")]
            yield pa.RecordBatch.from_arrays([part["id"], *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(features, pa.list_(pa.float64()))], names=["id", *names, "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {key}, {STATS}, x array<double>")


def is_held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, mod 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(labels: DataFrame, rows: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, y) of at most ``rows`` labelled rows that are not held out, by least hash of the id; a row an id."""
    known = labels.where(F.col(label_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    return known.orderBy(F.xxhash64("id"), "id").limit(rows)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """A row a document: id, the base counts, base_failed, score and kept."""
    measured = cut(measure(docs, id_col, text_col), "quality-stats")
    sample = labelled_sample(labels, train_rows, id_col, label_col)
    train = measured.select("id", "x").join(F.broadcast(sample), "id").groupBy("id").agg(F.first("x").alias("x"), F.first("y").alias("y")).orderBy("id").collect()
    y = np.array([r["y"] for r in train])
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    model = grow(np.array([r["x"] for r in train]), y, signs) if len(set(y)) == 2 else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(-1, len(FEATURES))
            score = shared.value.score(x) if shared.value else np.ones(len(x))
            names = [n for n in batch.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(score)], names=[*names, "score"])

    key = docs.schema[id_col].dataType.simpleString()
    scored = measured.mapInArrow(run, f"id {key}, {STATS}, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at)).withColumnRenamed("id", id_col)
