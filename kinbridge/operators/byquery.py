"""All pairs of a query in one task: no pair is shuffled, so disk follows records, not pairs.

Target lists (part, channel, token) are written once to the shared folder; each task reads them and walks its
queries, adding up the idf of shared tokens in whole millionths, which no order of summation changes.  A worker
holds the lists of one part, four bytes a posting within the document-frequency caps, beside their tokens.
Results equal those of ``retrieve.retrieve`` and ``retrieve.merge_channels``.

A record must be one row: ids are 64-bit numbers that do not repeat (``can`` tells).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinbridge.operators.retrieve import Channel
from kinbridge.operators.tokens import tokenize
from kinbridge.session import spool

MICRO = 1e6
#: Tokens of queries that are looked up at once, and rows of a batch that is returned.
ASKED, ROWS = 1 << 22, 1 << 17
#: Folders of lists; a part is in one of them.
FOLDERS = 64
#: Tasks a core in which each target's best is looked for: each returns a row a target.
WAVES = 4
#: Pairs that are sorted together before they are returned.
SORTED = 1 << 21


@dataclass(frozen=True)
class Pairs:
    """The pairs of one query, targets ascending."""

    q: int
    #: All targets of the query's part, the same array for all its queries, and the places there of those of the pairs.
    ids: np.ndarray
    at: np.ndarray
    #: A row a channel of scores in millionths, 0 where it lacks the pair.
    scores: np.ndarray
    #: The query's true targets, ascending.
    true: np.ndarray
    #: Further columns of the records, if asked for: of all targets of the part, of all queries, and the place of this one there.
    known: dict[str, np.ndarray] | None = None
    asked: dict[str, np.ndarray] | None = None
    i: int = 0

    @property
    def t(self) -> np.ndarray:
        return self.ids[self.at]

    def label(self) -> np.ndarray:
        t, out = self.t, np.zeros(len(self.at), bool)
        at = np.searchsorted(t, self.true)
        inside = at < len(t)
        out[at[inside]] = t[at[inside]] == self.true[inside]
        return out

    def total(self) -> np.ndarray:
        """The union score in millionths."""
        return self.scores.sum(axis=0)

    def micro(self) -> np.ndarray:
        """The union score over the query's best, in millionths (halves away from zero, by whole numbers)."""
        s = self.total().astype(np.int64)
        best = int(s.max()) if len(s) else 1
        return (s * 2_000_000 + best) // (2 * best)

    def p(self) -> np.ndarray:
        """The union score over the query's best, to six places."""
        return self.micro() / MICRO

    def ranks(self, channel: int = 0) -> np.ndarray:
        """The rank of each true target in a channel, -1 if it lacks the pair."""
        mine, s, out = self.t, self.scores[channel], np.full(len(self.true), -1, np.int64)
        at = np.searchsorted(mine, self.true)
        for i, (k, t) in enumerate(zip(at.tolist(), self.true.tolist(), strict=True)):
            if k < len(mine) and mine[k] == t and s[k] > 0:
                out[i] = np.count_nonzero(s > s[k]) + np.count_nonzero(s[:k] == s[k])
        return out


Emit = Callable[[Iterator[Pairs]], Iterator[dict[str, np.ndarray]]]


def can(queries: DataFrame, targets: DataFrame, doc: str) -> bool:
    """Whether ids are longs, none null, none repeated."""
    if not isinstance(queries.schema[doc].dataType, T.LongType) or not isinstance(targets.schema[doc].dataType, T.LongType):
        return False
    ids = queries.select(doc).unionByName(targets.select(doc))
    return ids.groupBy(doc).agg(F.count("*").alias("n")).where(F.col(doc).isNull() | (F.col("n") > 1)).isEmpty()


def _tokens(field: str, mode: str):
    """Whole values go by their SHA-256."""
    return tokenize(F.col(field)) if mode == "tokens" else F.array(F.sha2(F.col(field), 256))


def _asks(df: DataFrame, part: str, doc: str, fields: list[tuple[str, str, bool]], more: tuple[str, ...] = ()) -> DataFrame:
    """(part, folder, doc, c0, c1, ..., more): the tokens of each channel; an empty value counts only where ``empty`` says so."""
    none = F.array().cast("array<string>")
    column = lambda f, mode, empty: F.coalesce(F.when(F.lit(empty) | (F.col(f) != ""), F.filter(_tokens(f, mode), lambda x: x.isNotNull())), none)
    return df.where(F.col(part).isNotNull()).select(F.col(part).cast("string").alias("part"), F.pmod(F.xxhash64(F.col(part).cast("string")), F.lit(FOLDERS)).cast("int").alias("folder"), F.col(doc).alias("doc"), *[column(*f).alias(f"c{i}") for i, f in enumerate(fields)], *[F.col(c).alias(f"_{c}") for c in more])


def _fields(channels: list[Channel], truth: str | None) -> list[tuple[str, str, bool]]:
    return [(c.field, c.mode, False) for c in channels] + ([(truth, "key", True)] if truth else [])


def lists(targets: DataFrame, channels: list[Channel], part: str, doc: str, truth: str | None = None, more: tuple[str, ...] = ()) -> tuple[str, str]:
    """Writes the target lists, and beside the ids the columns ``more``; their paths."""
    fields, caps = _fields(channels, truth), [c.df_cap for c in channels] + [None] * bool(truth)
    rows = _asks(targets, part, doc, fields)
    named = lambda i: F.transform(F.col(f"c{i}"), lambda x: F.struct(F.lit(i).alias("ch"), x.alias("token")))
    posts = rows.select("part", "folder", "doc", F.explode(F.concat(*map(named, range(len(fields))))).alias("x")).select("part", "folder", "x.ch", "x.token", "doc")
    sizes = F.broadcast(rows.groupBy("part").agg(F.count("*").alias("n")))  # a row a partition of the records
    found = posts.groupBy("part", "folder", "ch", "token").agg(F.collect_list("doc").alias("docs")).join(sizes, "part")
    df = F.size("docs")
    cap = F.element_at(F.array(*[F.lit(-1 if c is None else c) for c in caps]), F.col("ch") + 1)
    found = found.where((cap < 0) | (df <= cap)).withColumn("idf", F.round(F.log(F.col("n") / df), 6))
    return spool(_asks(targets, part, doc, [], more), "targets", ["folder"]), spool(found.select("part", "folder", "ch", "token", "idf", "docs"), "lists", ["folder"])


class Lists:
    """The lists of one part: ids ascending, and of each channel its tokens, their idf and the places of their targets."""

    def __init__(self, paths: tuple[str, str], part: str, folder: int, channels: int, more: tuple[str, ...] = ()):
        rows = list(_batches(paths[0], part, folder))
        ids = np.concatenate([b["doc"].to_numpy() for b in rows]) if rows else np.empty(0, np.int64)
        order = np.argsort(ids)
        self.ids, self.channels, self.more = ids[order], [], {}
        if not len(self.ids):
            return
        for c in more:
            self.more[c] = pa.concat_arrays([b[f"_{c}"] for b in rows]).take(pa.array(order))
        lo, width = int(self.ids[0]), int(self.ids[-1]) - int(self.ids[0]) + 1
        at = None
        if width <= 32 * len(self.ids) + 1024:
            at = np.zeros(width, np.int32)
            at[self.ids - lo] = np.arange(len(self.ids), dtype=np.int32)
        found: list[list[tuple]] = [[] for _ in range(channels)]
        for batch in _batches(paths[1], part, folder):
            for c in range(channels):
                b = batch.filter(pc.equal(batch["ch"], c))
                docs = b["docs"].flatten().to_numpy()
                places = at[docs - lo] if at is not None else np.searchsorted(self.ids, docs).astype(np.int32)
                found[c].append((b["token"], np.rint(b["idf"].to_numpy() * MICRO), pc.list_value_length(b["docs"]).to_numpy(), places))
        for rows in found:
            tokens, idf, sizes, places = zip(*rows, strict=True) if rows else ([pa.array([], pa.string())], [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int32)])
            rows.clear()
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            self.channels.append((pa.concat_arrays(tokens), np.concatenate(idf), starts, np.concatenate(places)))


def _batches(path: str, part: str | None = None, folder: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows that ``spool`` has written, of one part if it is given."""
    import pyarrow.dataset as ds
    from pyarrow.fs import FileSelector, FileSystem

    fs, inner = FileSystem.from_uri(path if folder is None else f"{path}/folder={folder}")
    files = [f.path for f in fs.get_file_info(FileSelector(inner, allow_not_found=True)) if f.path.endswith(".parquet")]
    if files:
        for f in ds.dataset(files, filesystem=fs, format="parquet").get_fragments():
            yield from f.to_batches(batch_size=1 << 14, use_threads=False, filter=None if part is None else pc.field("part") == part)


def _coded(known: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of targets as codes and the texts of the codes, those of queries likewise and as texts: -1 is null, -2 a text that no target has."""
    coded = known.dictionary_encode()
    of_asked = np.where(asked.is_null().to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.index_in(asked, value_set=coded.dictionary), -2).to_numpy())
    return pc.fill_null(coded.indices, -1).to_numpy(), np.array(coded.dictionary.to_pylist(), object), of_asked, np.array(asked.to_pylist(), object)


def _sides(at: Lists, own: pa.Table, more: tuple[str, ...]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The further columns of targets and queries; a text column x is there as codes, and as x_text what ``_coded`` says."""
    known, asked = {}, {}
    for c in more:
        t, q = at.more[c], own[f"_{c}"].combine_chunks()
        if pa.types.is_string(t.type):
            known[c], known[f"{c}_text"], asked[c], asked[f"{c}_text"] = _coded(t, q)
        else:
            known[c], asked[c] = t.to_numpy(zero_copy_only=False), q.to_numpy(zero_copy_only=False)
    return known, asked


def _walk(rows: pa.Table, paths: tuple[str, str], channels: int, known: bool, more: tuple[str, ...] = ()) -> Iterator[Pairs]:
    """Pairs of each query; the last channel names the true pairs if ``known``."""
    none = np.empty(0, np.int64)
    for part in rows["part"].unique():
        own = rows.filter(pc.equal(rows["part"], part)).combine_chunks()
        at = Lists(paths, part.as_py(), own["folder"][0].as_py(), channels, more)
        docs = own["doc"].to_numpy()
        if not len(at.ids):
            yield from (Pairs(q, none, none, np.zeros((channels - known, 0)), none) for q in docs.tolist())
            continue
        found = []
        for c, (tokens, idf, starts, places) in enumerate(at.channels):
            column = own[f"c{c}"].combine_chunks()
            hit = pc.fill_null(pc.index_in(column.flatten(), value_set=tokens), -1).to_numpy()
            ends = np.cumsum(pc.list_value_length(column).to_numpy(), dtype=np.int64)
            found.append((hit, np.concatenate([[0], ends]), idf, starts, places))
        sides = _sides(at, own, more) if more else (None, None)
        at.channels.clear()
        at.more.clear()
        del own, column, tokens
        pa.default_memory_pool().release_unused()
        n = len(at.ids)
        for i, q in enumerate(docs.tolist()):
            scores, true = np.zeros((channels - known, n)), none
            for c, (hit, ends, idf, starts, places) in enumerate(found):
                k = hit[ends[i] : ends[i + 1]]
                k = k[k >= 0]
                if not len(k):
                    continue
                lo, hi = starts[k], starts[k + 1]
                t = np.concatenate([places[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                if c == channels - 1 and known:
                    true = np.sort(at.ids[t])
                else:
                    scores[c] = np.bincount(t, weights=np.repeat(idf[k], hi - lo), minlength=n)
            has = np.flatnonzero(scores.any(axis=0) if len(scores) > 1 else scores[0])
            yield Pairs(q, at.ids, has, scores[:, has], true, *sides, i)


def by_query(queries: DataFrame, targets: DataFrame, channels: list[Channel], part: str, doc: str, emit: Emit, schema: str, truth: str | None = None, paths: tuple[str, str] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """What ``emit`` makes of the pairs of each query; truth: the column whose equal values make a true pair, null never.

    paths: what ``lists`` has written for the same targets, channels, truth and more.
    more: columns of both sides that ``emit`` needs.
    """
    fields = _fields(channels, truth)
    paths = paths or lists(targets, channels, part, doc, truth, more)
    kinds = to_arrow_schema(T._parse_datatype_string(schema))
    names, n, known, most = kinds.names, len(fields), truth is not None, ROWS * 8 // max(8, len(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[Pairs]:
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += len(batch["c0"].flatten())
                if size >= ASKED:
                    yield from _walk(pa.Table.from_batches(held), paths, n, known, more)
                    held, size = [], 0
            if held:
                yield from _walk(pa.Table.from_batches(held), paths, n, known, more)

        out, size = [], 0
        for columns in emit(pairs()):
            out.append(columns)
            size += len(columns[names[0]])
            if size >= most:
                yield _batch(out, kinds)
                out, size = [], 0
        if out:
            yield _batch(out, kinds)

    return _asks(queries, part, doc, fields, more).mapInArrow(run, schema)


def _batch(parts: list[dict[str, np.ndarray]], kinds: pa.Schema) -> pa.RecordBatch:
    """NaN is null."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k.name] for p in parts]), k.type, from_pandas=True) for k in kinds], schema=kinds)


# ---- what queries give: an emitter and its schema


def each(make: Callable[[Pairs], dict[str, np.ndarray]]) -> Emit:
    return lambda pairs: (make(x) for x in pairs)


def _row(x: Pairs, **columns) -> dict[str, np.ndarray]:
    return {"q": np.array([x.q], np.int64)} | {k: np.array([v]) for k, v in columns.items()}


def relative(least: float = 0.0) -> tuple[Emit, str]:
    """(q, t, p) of the pairs whose union score over the query's best is at least so much."""

    def make(x: Pairs) -> dict[str, np.ndarray]:
        p = x.p()
        keep = p >= least
        return {"q": np.full(keep.sum(), x.q), "t": x.t[keep], "p": p[keep]}

    return each(make), "q long, t long, p double"


def labelled() -> tuple[Emit, str]:
    """(q, t, label) of all pairs."""
    return each(lambda x: {"q": np.full(len(x.at), x.q), "t": x.t, "label": x.label().astype(np.int32)}), "q long, t long, label int"


def true_ranks() -> tuple[Emit, str]:
    """(q, t, rank) of all true pairs; rank is -1 where the first channel lacks the pair."""
    return each(lambda x: {"q": np.full(len(x.true), x.q), "t": x.true, "rank": x.ranks()}), "q long, t long, rank long"


def counts() -> tuple[Emit, str]:
    """(q, n_cand, n_hit, n_true) of every query."""
    return each(lambda x: _row(x, n_cand=len(x.at), n_hit=int(x.label().sum()), n_true=len(x.true))), "q long, n_cand long, n_hit long, n_true long"


def two_channels() -> tuple[Emit, str]:
    """Per query, pairs of the first channel and of the second, of both, beyond the second, and the true ones of each."""

    def make(x: Pairs) -> dict[str, np.ndarray]:
        c, b, y = x.scores[0] > 0, x.scores[1] > 0, x.label()
        n = lambda v: int(np.count_nonzero(v))
        return _row(x, n_channel=n(c), n_base=n(b), n_both=n(c & b), n_extra=n(c & ~b), true_channel=n(c & y), true_base=n(b & y), true_extra=n(c & ~b & y))

    return each(make), "q long, n_channel long, n_base long, n_both long, n_extra long, true_channel long, true_base long, true_extra long"


def best_of_task() -> tuple[Emit, str]:
    """(t, p, q): of each target of a task's pairs the greatest p, ties to the smaller query."""

    def emit(pairs: Iterator[Pairs]) -> Iterator[dict[str, np.ndarray]]:
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by the first target of a part, to which a task may come back
        ids = None
        for x in pairs:
            if not len(x.at):
                continue
            if ids is not x.ids:
                ids = x.ids
                _, p, q = found.setdefault(int(ids[0]), (ids, np.full(len(ids), -1.0), np.zeros(len(ids), np.int64)))
            own = x.p()
            some = np.flatnonzero(own >= p[x.at])
            own, at = own[some], x.at[some]
            better = (own > p[at]) | (x.q < q[at])
            p[at[better]], q[at[better]] = own[better], x.q
        for ids, p, q in found.values():
            yield {"t": ids[p >= 0], "p": p[p >= 0], "q": q[p >= 0]}

    return emit, "t long, p double, q long"


def best_per_target(queries: DataFrame, targets: DataFrame, channels: list[Channel], part: str, doc: str) -> DataFrame:
    """(q, t, p, best) of all pairs, as ``decide.best_per_target`` marks them: walked twice, first for each target's best.

    The tasks of the first walk follow the cores, not the input, so their rows follow the targets.
    """
    paths = lists(targets, channels, part, doc)
    few = queries.coalesce(WAVES * queries.sparkSession.sparkContext.defaultParallelism)
    found = by_query(few, targets, channels, part, doc, *best_of_task(), paths=paths)
    best = found.groupBy("t").agg(F.max(F.struct("p", (-F.col("q")).alias("q"))).alias("b")).select("t", (-F.col("b.q")).alias("q"))
    return by_query(queries, targets, channels, part, doc, *owned(spool(best, "owners")), paths=paths)


def best_with_truth(least: float) -> tuple[Emit, str]:
    """Of each target of a task's pairs the greatest p, if at least so much, ties to the smaller query, and n = 1 if the pair is true; of each query (not target) n = its true targets."""

    def emit(pairs: Iterator[Pairs]) -> Iterator[dict[str, np.ndarray]]:
        ids, p, q, n = None, np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)
        found = lambda: {"target": np.ones(np.count_nonzero(p >= 0), bool), "t": ids[p >= 0], "p": p[p >= 0], "q": q[p >= 0], "n": n[p >= 0]}
        for x in pairs:
            yield {"target": np.zeros(1, bool), "t": np.zeros(1, np.int64), "p": np.zeros(1), "q": np.array([x.q], np.int64), "n": np.array([len(x.true)], np.int64)}
            if ids is not x.ids:
                if ids is not None:
                    yield found()
                ids, p, q, n = x.ids, np.full(len(x.ids), -1.0), np.zeros(len(x.ids), np.int64), np.zeros(len(x.ids), np.int64)
            own = x.p()
            keep = np.flatnonzero(own >= least)
            own, at = own[keep], x.at[keep]
            better = (own > p[at]) | ((own == p[at]) & (x.q < q[at]))
            own, at = own[better], at[better]
            p[at], q[at], n[at] = own, x.q, np.isin(ids[at], x.true)
        if ids is not None:
            yield found()

    return emit, "target boolean, t long, p double, q long, n long"


def entity_counts(queries: DataFrame, targets: DataFrame, channels: list[Channel], part: str, doc: str, truth: str, threshold: float) -> DataFrame:
    """(q, n_pred, n_true, n_hit) of every query: ``decide.decide`` against the truth, of which each task gives a row a target and a query."""
    found = by_query(queries, targets, channels, part, doc, *best_with_truth(threshold), truth=truth)
    # a target's rows meet in its best, a query's own row goes on by itself
    best = found.groupBy("target", "t", F.when(~F.col("target"), F.col("q")).alias("own")).agg(F.max(F.struct("p", (-F.col("q")).alias("q"), "n")).alias("b"))
    one = lambda x: F.sum(F.when(x, 1).otherwise(0))
    counts = best.select("target", (-F.col("b.q")).alias("q"), F.col("b.n").alias("n")).groupBy("q").agg(
        one(F.col("target")).alias("n_pred"), F.sum(F.when(~F.col("target"), F.col("n")).otherwise(0)).alias("n_true"), F.sum(F.when(F.col("target"), F.col("n")).otherwise(0)).alias("n_hit")
    )
    return queries.select(F.col(doc).alias("q")).join(counts, "q", "left").na.fill(0)


def p_counts() -> tuple[Emit, str]:
    """(p, n): a task's pairs by their p."""

    def emit(pairs: Iterator[Pairs]) -> Iterator[dict[str, np.ndarray]]:
        n = np.zeros(int(MICRO) + 1, np.int64)
        for x in pairs:
            np.add.at(n, np.rint(x.p() * MICRO).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield {"p": at / MICRO, "n": n[at]}

    return emit, "p double, n long"


def score_sums(channel: int) -> tuple[Emit, str]:
    """Per query and label: pairs, the sum of the union scores, pairs of one channel and the sum of its scores, in millionths."""

    def make(x: Pairs) -> dict[str, np.ndarray]:
        total, one, y = x.total(), x.scores[channel], x.label()
        of = lambda v: np.array([v[~y].sum(), v[y].sum()]).astype(np.int64)
        return {"label": np.array([0, 1], np.int32), "n": of(np.ones(len(y))), "n_sum": of(total > 0), "sum": of(total), "n_one": of(one > 0), "one": of(one)}

    return each(make), "label int, n long, n_sum long, sum long, n_one long, one long"


def owned(path: str) -> tuple[Emit, str]:
    """(q, t, p, best) of all pairs; path: (t, q) of each target's best pair.

    Up to SORTED pairs at a time are returned by p, as equal values in a row take less space in Parquet.
    """

    def emit(pairs: Iterator[Pairs]) -> Iterator[dict[str, np.ndarray]]:
        found = [(b["t"].to_numpy(), b["q"].to_numpy()) for b in _batches(path)]
        t, q = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(t)
        t, q = t[order], q[order]
        ids = own = None
        keys, n = np.empty(SORTED, np.int64), 0  # p in millionths (20 bits), the place of the query in asked, that of the target
        asked: list[int] = []
        wide = most = 0

        def held() -> Iterator[dict[str, np.ndarray]]:
            keys[:n].sort()
            names = np.array(asked, np.int64)
            for a in range(0, n, ROWS):
                key = keys[a : min(a + ROWS, n)]
                q, at = names[(key >> wide) & (most - 1)], key & ((1 << wide) - 1)
                yield {"q": q, "t": ids[at], "p": (key >> 43) / MICRO, "best": own[at] == q}

        for x in pairs:
            if ids is not x.ids:  # targets without a pair get any owner
                yield from held()
                n = 0
                asked.clear()
                ids, own = x.ids, q[np.minimum(np.searchsorted(t, x.ids), max(len(q) - 1, 0))] if len(q) else q
                wide = len(ids).bit_length()
                most = 1 << (43 - wide)
            of_all, start = (x.micro() << 43) | x.at, 0
            while start < len(of_all):
                if n == len(keys) or len(asked) == most:
                    yield from held()
                    n = 0
                    asked.clear()
                k = min(len(keys) - n, len(of_all) - start)
                np.bitwise_or(of_all[start : start + k], len(asked) << wide, out=keys[n : n + k])
                asked.append(x.q)
                n, start = n + k, start + k
        yield from held()

    return emit, "q long, t long, p double, best boolean"
