"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new capacities.

Rows belong to old shards; each is cut into blocks by a hash of the id.  From the old shards' sizes and
the new capacities a minimum-cost flow (a byte that stays costs nothing, any other 1) tells how many bytes
go from each old shard to each new one.  Within an old shard, in order of blocks, bytes stay first
and then fill the flows in turn, so blocks move whole; rows of the few blocks in which a flow ends are
dealt one by one, some to other shards than their flow's, so that sizes come close to the capacities.  Rows are ordered only within their
blocks.  Affected shards are written anew.

A null text is empty; null ids are hashed as a value; repeated rows are rows of their own, counted where single
rows are dealt; a row's size
is the bytes of its text plus one, so empty texts are placed too; an empty table gives empty shards; extra
columns are kept in the written files.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinbridge.llm.common import cut, shared_path

#: Rows that a block holds on average.
BLOCK_ROWS = 1_000


def capacities(total: int, shards: int) -> list[int]:
    """Near equal: they differ by one byte at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows of least cost from supplies to demands of the same total: successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    source, sink, nodes = n + m, n + m + 1, n + m + 2
    graph: list[list[list[int]]] = [[] for _ in range(nodes)]  # to, capacity, cost, index of the reverse

    def edge(a: int, b: int, most: int, price: int) -> None:
        graph[a].append([b, most, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, d in enumerate(demand):
        edge(n + j, sink, d, 0)
    height, left = [0] * nodes, min(sum(supply), sum(demand))
    while left:
        far, came = [float("inf")] * nodes, [(-1, -1)] * nodes
        far[source], queue = 0, [(0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for k, (v, most, price, _) in enumerate(graph[u]):
                if most and d + price + height[u] - height[v] < far[v]:
                    far[v], came[v] = d + price + height[u] - height[v], (u, k)
                    heapq.heappush(queue, (far[v], v))
        height = [h + d if d < float("inf") else h for h, d in zip(height, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(came[v])
            v = came[v][0]
        push = min(left, *(graph[u][k][1] for u, k in path))
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
        left -= push
    return [[supply[i] - next(e[1] for e in graph[i] if e[0] == n + j) if supply[i] else 0 for j in range(m)] for i in range(n)]


def solve(old_sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old shard, first byte, end byte, new shard): what stays comes first, then flows by new shard."""
    old = sorted(old_sizes)
    flow = min_cost_flow([old_sizes[o] for o in old], capacities(sum(old_sizes.values()), shards), [[int(o != j) for j in range(shards)] for o in old])
    out = []
    for o, row in zip(old, flow, strict=True):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != o, j)):
            if row[j]:
                out.append((o, at, at + row[j], j))
                at += row[j]
    return out


def _level(sizes: list[int], shard: list[int], need: list[int]) -> None:
    """Single rows go from the fullest shard to the emptiest while that brings the two closer."""
    for _ in range(16 * len(need)):
        to = max(range(len(need)), key=lambda j: (need[j], -j))
        moves = ((abs(need[to] - need[s] - 2 * size), i) for i, (s, size) in enumerate(zip(shard, sizes, strict=True)) if need[s] < 0 and size < need[to] - need[s])
        best = min(moves, default=None)
        if best is None or need[to] <= 0:
            return
        i = best[1]
        need[shard[i]] += sizes[i]
        need[to] -= sizes[i]
        shard[i] = to


def _share(count: int, size: int, allowed: list[int], need: list[int]) -> dict[int, int]:
    """How many of ``count`` equal rows each allowed shard gets, so that their needs end near level."""
    if count == 1:
        return {max(allowed, key=lambda j: (need[j], -j)): 1}
    taking = sorted(allowed, key=lambda j: (-need[j], j))
    while len(taking) > 1 and need[taking[-1]] <= (sum(need[j] for j in taking) - count * size) / len(taking):
        taking.pop()
    level = (sum(need[j] for j in taking) - count * size) / len(taking)
    got, left = {}, count
    for j in taking:
        got[j] = min(left, max(0, int((need[j] - level) / size)))
        left -= got[j]
    for k in range(left):
        got[taking[k % len(taking)]] += 1
    return {j: n for j, n in got.items() if n}


def _deal(rows: list[tuple], moves: list[tuple[int, int, int, int]], need: list[int], slots: list[int]) -> list[tuple]:
    """(old, block, [(first row, shard, slot of it)] in row order) of blocks in which flows end.

    rows: (old, block, first byte, size, equal rows) in order of old, block and row.  The largest rows go first,
    each to that of its block's shards that still needs most; equal rows are dealt as one.
    """
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][3], i))
    low: dict[tuple[int, int], int] = {}
    high: dict[tuple[int, int], int] = {}
    for old, block, at, size, count in rows:
        low.setdefault((old, block), at)
        high[old, block] = at + size * count
    allowed = {k: [j for o, a, b, j in moves if o == k[0] and a < high[k] and b > low[k]] for k in low}
    dealt: list[dict[int, int]] = [{}] * len(rows)
    for i in order:
        old, block, _, size, count = rows[i]
        dealt[i] = _share(count, size, allowed[old, block], need)
        for j, n in dealt[i].items():
            need[j] -= n * size
    single = [i for i in range(len(rows)) if rows[i][4] == 1]
    shard = [next(iter(dealt[i])) for i in single]
    _level([rows[i][3] for i in single], shard, need)
    for i, j in zip(single, shard, strict=True):
        dealt[i] = {j: 1}
    out: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    place: dict[tuple[int, int], int] = {}
    for i, (old, block, _, _, _) in enumerate(rows):
        for j, n in sorted(dealt[i].items()):
            at = place.get((old, block), 0)
            out.setdefault((old, block), []).append((at, j, slots[j]))
            place[old, block] = at + n
            slots[j] += n
    return [(old, block, pieces) for (old, block), pieces in out.items()]


#: Added columns; a document's own columns of these names are replaced.
ADDED = ("_old", "_shard", "_slot")
#: Prefix of columns that exist only inside.
_P = "__kb_"


def assign(docs: DataFrame, shards: int, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[int]]:
    """The documents with columns _old, _shard and _slot (gapless from 0 in each shard); the shards that stay as they are.

    A null old shard is shard -1.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED]
    old, block, size, key, at, n = (f"{_P}{x}" for x in ("old", "block", "size", "hash", "at", "n"))
    own_size = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + 1).cast("long")
    keyed = docs.withColumns({old: F.coalesce(old_shard.cast("int"), F.lit(-1)), size: own_size, key: F.xxhash64(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    # a block is a range of hashes in an old shard, which has as many ranges as its rows ask for
    sizes = {r[0]: r["count"] for r in keyed.groupBy(old).count().collect()}
    ranges = F.element_at(F.create_map(*[F.lit(x) for o, n_rows in sorted(sizes.items()) for x in (o, max(1, n_rows // block_rows))]), F.col(old)) if sizes else F.lit(1)
    keyed = keyed.withColumn(block, F.floor(F.shiftrightunsigned(key, 33).cast("double") / float(1 << 31) * ranges).cast("long"))
    by_block = cut(keyed.groupBy(old, block).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")), "reshard-blocks")
    by_old = {r[old]: r["bytes"] for r in by_block.groupBy(old).agg(F.sum("bytes").alias("bytes")).collect()}
    plan = solve(by_old, shards) if by_old else []
    moves = spark.createDataFrame(plan, f"{old} int, from long, to long, {_P}shard int")
    before = Window.partitionBy(old).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_block.withColumn(at, F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    # at most old shards + new shards moves: a fixed bound
    inside = starts.join(F.broadcast(moves), old).where(f"from <= {at} and {at} + bytes <= to").select(old, block, "bytes", "rows", f"{_P}shard")
    above = Window.partitionBy(f"{_P}shard").orderBy(old, block).rowsBetween(Window.unboundedPreceding, -1)
    whole = cut(inside.withColumn(f"{_P}start", F.coalesce(F.sum("rows").over(above), F.lit(0))), "reshard-whole")
    # the few blocks in which a flow ends: a bounded number of distinct rows, dealt so that the capacities are met closely
    ending = starts.join(whole.select(old, block), [old, block], "left_anti").select(old, block, at)
    split = keyed.select(old, block, key, F.col(id_col).alias("id"), size).join(ending, [old, block])
    split = split.groupBy(old, block, at, key, "id", size).agg(F.count("*").alias("equal"))
    own = Window.partitionBy(old, block).orderBy(key, "id", size).rowsBetween(Window.unboundedPreceding, -1)
    rows = split.withColumn(at, F.col(at) + F.coalesce(F.sum(F.col(size) * F.col("equal")).over(own), F.lit(0))).orderBy(old, block, key, "id", size).select(old, block, at, size, "equal").collect()
    need, slots = capacities(sum(by_old.values()), shards), [0] * shards
    for r in whole.groupBy(f"{_P}shard").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
        need[r[0]] -= r["bytes"]
        slots[r[0]] = r["rows"]
    piece_type = "array<struct<first:long,shard:int,slot:long>>"
    dealt = spark.createDataFrame(_deal([tuple(r) for r in rows], plan, need, slots), f"{old} int, {block} long, {_P}pieces {piece_type}")
    meta = whole.select(old, block, f"{_P}shard", f"{_P}start", F.lit(None).cast(piece_type).alias(f"{_P}pieces"))
    meta = meta.unionByName(dealt.withColumns({f"{_P}shard": F.lit(None).cast("int"), f"{_P}start": F.lit(None).cast("long")}))
    place = F.row_number().over(Window.partitionBy(old, block).orderBy(key, id_col, size)) - 1
    placed = keyed.join(meta, [old, block]).withColumn(n, place)
    piece = F.try_element_at(F.filter(f"{_P}pieces", lambda p: p["first"] <= F.col(n)), F.lit(-1))
    shard, slot = F.coalesce(F.col(f"{_P}shard"), piece["shard"]), F.coalesce(F.col(f"{_P}start") + F.col(n), piece["slot"] + F.col(n) - piece["first"])
    moving = {s for o, _, _, j in plan if o != j for s in (o, j)}
    return placed.select(*names, F.col(old).alias("_old"), shard.alias("_shard"), slot.alias("_slot")), [o for o in by_old if 0 <= o < shards and o not in moving]


def reshard(docs: DataFrame, shards: int, old_shard: Column, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, str]:
    """Write the affected shards as ``path/_shard=i``; all documents with _old, _shard and _slot, and the path.

    A shard that keeps all its rows and gains none is not written; its rows are read from docs.
    """
    spark: SparkSession = docs.sparkSession
    path = path or shared_path(spark, "shards")
    placed, still = assign(docs, shards, old_shard, id_col, text_col, block_rows)
    moved = placed.where(~F.col("_shard").isin(still)) if still else placed
    moved.write.option("compression", "zstd").partitionBy("_shard").parquet(path)
    written = spark.read.schema(placed.drop("_shard").schema.add("_shard", T.IntegerType())).parquet(path)
    if still:
        written = written.unionByName(placed.where(F.col("_shard").isin(still)))
    return written, path
