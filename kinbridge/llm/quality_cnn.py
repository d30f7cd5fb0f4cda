"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of four bytes slide over every byte of the document.  Their responses are max-pooled in
overlapping chunks that cover the whole document; the chunks' pooled vectors are combined by mean and
maximum, and a small dense layer gives one probability.  Training (Adam, gradients by hand; only the
places that won their pool get any) uses a bounded sample of labelled rows that are not held out.

Null texts are empty; a text is padded by zero bytes to one filter at least, so empty texts have a score
too; repeated rows get equal results; without labels of both classes every score is the share of
label 1, or one half; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinbridge.llm.common import small_batches, text_bytes
from kinbridge.llm.quality_rules import is_held_out, labelled_sample

WIDTH, FILTERS, HIDDEN = 4, 8, 12
#: A chunk is two halves; each half belongs to two chunks.
HALF = 256
#: The sample: so many labelled rows, whole texts of any length, until their bytes together reach the second figure.
TRAIN_ROWS, TRAIN_BYTES = 3_000, 1 << 26
PREDICT_AT = 0.3


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    w1: np.ndarray  # 2 FILTERS x HIDDEN
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Two taps at once, by pair of bytes."""
        a = (self.taps[0][:, None] + self.taps[1][None]).reshape(65536, -1) + self.bias
        b = (self.taps[2][:, None] + self.taps[3][None]).reshape(65536, -1)
        return a.astype(np.float32), b.astype(np.float32)


def _halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded to rows of HALF places, and rows of each text: no filter reads into the next text."""
    counts = np.array([-(-(len(t) + WIDTH - 1) // HALF) for t in texts])
    data = np.zeros(int(counts.sum()) * HALF + WIDTH, np.uint8)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * HALF
    return data, counts


def _live(texts: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Places of each half that belong to the text, one at least: the last half may be padding."""
    live = np.full(int(counts.sum()), HALF)
    live[np.cumsum(counts) - 1] = [max(1, len(t) - HALF * (int(n) - 1)) for t, n in zip(texts, counts, strict=True)]
    return live


def pool(net: Network, tables: tuple[np.ndarray, np.ndarray], texts: list[bytes], places: bool = False):
    """Each half's maximum response of each filter, rows of each text, and the winning places."""
    data, counts = _halves(texts)
    rows = int(counts.sum())
    pair = (data[:-1].astype(np.uint16) << 8) | data[1:]
    live = _live(texts, counts)
    best = np.empty((rows, FILTERS), np.float32)
    won = np.empty((rows, FILTERS), np.int64) if places else None
    step = 512  # halves at a time, so the responses stay in cache
    for lo in range(0, rows, step):
        hi = min(rows, lo + step)
        a, b = lo * HALF, hi * HALF
        r = tables[0].take(pair[a:b], axis=0)
        r += tables[1].take(pair[a + 2 : b + 2], axis=0)
        r = r.reshape(hi - lo, HALF, FILTERS)
        for i in np.flatnonzero(live[lo:hi] < HALF):
            r[i, live[lo + i] :] = -np.inf
        if places:
            won[lo:hi] = r.argmax(axis=1) + (np.arange(lo, hi) * HALF)[:, None]
        best[lo:hi] = r.max(axis=1)
    return best, counts, won, data


def chunk_pool(best: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves (one, if the text has one): their maxima, first halves and chunks a text."""
    ends = np.cumsum(counts)
    last = np.zeros(len(best), bool)
    last[ends - 1] = True
    chunk = np.where(last[:, None], -np.inf, np.maximum(best, np.roll(best, -1, axis=0)))
    single = counts == 1
    chunk[ends[single] - 1] = best[ends[single] - 1]
    keep = ~last
    keep[ends[single] - 1] = True
    return chunk[keep], np.flatnonzero(keep), np.maximum(1, counts - 1)


def forward(net: Network, chunk: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, ...]:
    act = np.maximum(chunk, 0)
    starts = np.cumsum(chunks) - chunks
    mean = np.add.reduceat(act, starts, axis=0) / chunks[:, None]
    top = np.maximum.reduceat(act, starts, axis=0)
    x = np.concatenate([mean, top], 1)
    hidden = np.maximum(x @ net.w1 + net.b1, 0)
    return act, x, hidden, 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, epochs: int = 24, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.4, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.4, HIDDEN), np.zeros(1))
    names = ("taps", "bias", "w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    # small samples see more epochs, so that the number of steps is alike
    epochs = int(np.clip(epochs * 1500 / max(1, len(texts)), epochs // 2, 6 * epochs))
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            pick = order[lo : lo + batch]
            part = [texts[i] for i in pick]
            best, counts, won, data = pool(net, net.pair_tables(), part, places=True)
            chunk, first, chunks = chunk_pool(best, counts)
            act, x, hidden, p = forward(net, chunk, chunks)
            d = (p - y[pick]) / len(pick)
            g = {"w2": hidden.T @ d, "b2": np.array([d.sum()])}
            dh = np.outer(d, net.w2) * (hidden > 0)
            g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
            dx = dh @ net.w1.T
            own = np.repeat(np.arange(len(pick)), chunks)
            da = dx[own, :FILTERS] / chunks[own, None]
            is_top = act == x[own, FILTERS:]
            starts = np.cumsum(chunks) - chunks
            ties = np.maximum(1, np.add.reduceat(is_top.astype(float), starts, axis=0))
            da += is_top * (dx[:, FILTERS:] / ties)[own]
            da *= chunk > 0
            # to the half that won its chunk, then to the place that won its half
            second = np.minimum(first + 1, len(best) - 1)
            half = np.where(best[first] >= np.where(chunk > best[first], np.inf, best[first]), first[:, None], second[:, None])
            where = won[half, np.arange(FILTERS)[None]]
            g["bias"] = da.sum(0)
            g["taps"] = np.zeros_like(net.taps)
            filters = np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(g["taps"][j], (data[where + j], filters), da)
            step += 1
            now = rate * min(1.0, 1.5 * (1 - step / total) + 0.02)
            for k in names:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                setattr(net, k, getattr(net, k) - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return net


def scores(net: Network, tables: tuple[np.ndarray, np.ndarray], texts: list[bytes]) -> np.ndarray:
    best, counts, _, _ = pool(net, tables, texts)
    chunk, _, chunks = chunk_pool(best, counts)
    return forward(net, chunk, chunks)[3]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Network | float:
    """A network, or the score of every text if the labels are of one class.

    The sample goes by least hash of the id, so what either bound leaves out does not depend on a text's length.
    """
    sample = labelled_sample(labels, train_rows, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")).join(F.broadcast(sample), "id")
    one = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    # at most train_rows rows meet in this window
    before = F.sum(F.length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    rows = one.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < train_bytes).orderBy("id").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    return train([bytes(r["text"]) for r in rows], y)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", predict_at: float = PREDICT_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents with columns held_out, score and predicted."""
    net = fit(docs, labels, id_col, text_col, label_col, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    out = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.pair_tables() if isinstance(model, Network) else None
        for part in small_batches(batches, text_col):
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part[text_col]]
            score = scores(model, tables, texts) if tables else np.full(len(texts), model)
            yield pa.RecordBatch.from_arrays([*(part[n] for n in out), pa.array(score, pa.float64())], names=[*out, "__kb_score"])

    scored = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__kb_score", T.DoubleType())]))
    scored = scored.withColumns({"held_out": is_held_out(id_col), "score": F.col("__kb_score"), "predicted": (F.col("__kb_score") >= predict_at).cast("int")})
    return scored.drop("__kb_score")
