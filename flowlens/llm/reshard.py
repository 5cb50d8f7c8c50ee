"""Resharding that moves the fewest bytes: a minimum-cost flow from old to new shards.

Rows lie in blocks (old shard, hash of the text), so equal texts lie together. A heavy block is cut
into units by another hash of the text; only a text that is itself larger than a new shard is cut by
row. From the units' sizes the driver solves a transport problem between old and new shards, in which a
byte that stays costs nothing and a byte that moves costs one, and picks the blocks that
carry the flow. Only then are rows given their shard, a gapless slot, and rewritten where
their shard has changed its content.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowlens.llm.shared import scratch_path

#: Blocks of one old shard; their number, not the input, bounds what the driver sees.
BLOCKS = 2048
#: A block over twice this part of all bytes or rows is cut into units of about this part, text by text;
#: rows of a larger unit are numbered in pieces of about this part.
PIECE = 1 / 1024
#: A block over a shard's capacity divided by this is placed before the flow.
LARGE = 64


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def transport(supply: list[int], demand: list[int]) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard, so that the fewest bytes change their number.

    Successive cheapest paths over the bipartite residual network; equal totals are expected.
    Shard numbers present on both sides are the same place.
    """
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    room: dict[int, dict[int, int]] = defaultdict(dict)
    cost: dict[tuple[int, int], int] = {}

    def arc(a: int, b: int, most: int, price: int) -> None:
        room[a][b], cost[a, b] = most, price
        room[b].setdefault(a, 0)
        cost[b, a] = -price

    for i, have in enumerate(supply):
        arc(source, i, have, 0)
        for j in range(m):
            arc(i, n + j, have, int(i != j))
    for j, want in enumerate(demand):
        arc(n + j, sink, want, 0)
    price = [0] * (n + m + 2)
    while True:
        far, before, heap = {source: 0}, {}, [(0, source)]
        while heap:  # Dijkstra on reduced costs, which stay non-negative
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for b, left in room[a].items():
                new = d + cost[a, b] + price[a] - price[b]
                if left > 0 and new < far.get(b, new + 1):
                    far[b], before[b] = new, a
                    heapq.heappush(heap, (new, b))
        if sink not in far:
            break
        for a in range(len(price)):
            price[a] += far.get(a, far[sink])
        path, a = [], sink
        while a != source:
            path.append((before[a], a))
            a = before[a]
        sent = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= sent
            room[b][a] += sent
    return {(i, j): room[n + j][i] for i in range(n) for j in range(m) if room[n + j].get(i, 0)}


def place_blocks(blocks: list[tuple], old: int, new: int) -> dict[tuple, int]:
    """The new shard of every block (old shard, block, piece, bytes), sizes near equal.

    Blocks too large to fill gaps with come first: each stays where it has room, or goes where most room
    is not needed by what lies there. For the others the flow says how many bytes each old shard keeps and
    gives. Blocks stay while the kept amount has room for them, largest first; the others go to the
    target with the most room left.
    """
    supply = [0] * old
    for shard, _, _, size in blocks:
        supply[shard] += size
    total = sum(supply)
    free = [total * (j + 1) // new - total * j // new for j in range(new)]
    placed: dict[tuple, int] = {}
    ordered = sorted(blocks, key=lambda b: (-b[3], b))
    large = sum(b[3] * LARGE * new > total for b in ordered)
    for shard, block, piece, size in ordered[:large]:
        spare = [f - (supply[j] if j < old else 0) for j, f in enumerate(free)]
        stays = shard < new and free[shard] >= size
        j = shard if stays else max(range(new), key=lambda j: (free[j] >= size, spare[j] if free[j] >= size else free[j], -j))
        free[j] -= size
        supply[shard] -= size
        placed[shard, block, piece] = j
    left: dict[tuple[int, int], int] = defaultdict(int, transport(supply, [max(0, f) for f in free]))
    rest = []
    for shard, block, piece, size in ordered[large:]:
        open_to = [j for j in range(new) if left[shard, j] >= size]
        if not open_to:
            rest.append((shard, block, piece, size))
            continue
        j = shard if shard in open_to else max(open_to, key=lambda j: (left[shard, j], -j))
        left[shard, j] -= size
        free[j] -= size
        placed[shard, block, piece] = j
    for shard, block, piece, size in rest:  # what whole blocks can't fill exactly
        j = max(range(new), key=lambda j: (free[j] >= size and j == shard, free[j], -j))
        free[j] -= size
        placed[shard, block, piece] = j
    return placed


@dataclass(frozen=True)
class Resharded:
    """Rows with their new place, and the shard numbers whose content changes."""

    rows: DataFrame
    touched: list[int]
    used: list[int]


def _lookup(spark: SparkSession, names: str, table: list[tuple]) -> DataFrame:
    """A table for the executors; callers bound its rows by BLOCKS and PIECE, whatever the input."""
    return F.broadcast(spark.createDataFrame(table, names))


def reshard(docs: DataFrame, new_shards: int = 8, old_shards: int = 6, old_shard: Column | None = None) -> Resharded:
    """All columns of ``docs`` with ``shard``, ``slot`` (gapless from 0 in its shard) and ``old_shard``.

    ``old_shard`` says where a row lies now (0 to ``old_shards`` - 1); by default a hash of the text.
    New capacities are equal parts of all bytes (``text_bytes``); sizes differ from them by about one
    block or the largest texts. Equal texts of one old shard, by default all, share a shard unless they
    fill a new shard's capacity with a row to spare: only such a text is cut by row. Null and empty texts
    have size 1. Repeated rows are rows of their own; null ids sort first. An empty table gives an
    empty one. Earlier columns of the added names are replaced.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("shard", "slot", "old_shard")]
    now = F.pmod(F.xxhash64("text"), F.lit(old_shards)) if old_shard is None else old_shard
    block, unit = ["old_shard", "__block"], ["old_shard", "__block", "__unit"]
    cut = [*unit, "__piece"]
    rows = docs.select(
        *others, now.cast("int").alias("old_shard"),
        F.pmod(F.xxhash64("text", F.lit("block")), F.lit(BLOCKS)).cast("int").alias("__block"),
        text_bytes(F.col("text")).alias("__size"), F.xxhash64("text", F.lit("unit")).alias("__text"),
        F.xxhash64("doc_id", "text").alias("__row"))
    total = [F.sum("__size").alias("s"), F.count("*").alias("n")]
    whole = rows.groupBy(*block).agg(*total).collect()  # old_shards * BLOCKS rows at most
    size, count = sum(b.s for b in whole), sum(b.n for b in whole)

    def parts_of(b) -> int:
        return max(1, int(b.s / (size * PIECE)), int(b.n / (count * PIECE)))

    # A block that is cut has over PIECE of the bytes or rows: 2 / PIECE blocks and twice as many units at most.
    heavy = [(b[0], b[1], parts_of(b)) for b in whole if parts_of(b) > 1]
    rows = rows.join(_lookup(spark, "old_shard int, __block int, __units int", heavy), block, "left").withColumn(
        "__unit", F.pmod("__text", F.coalesce("__units", F.lit(1))).cast("int"))
    units = rows.where("__units is not null").groupBy(*unit).agg(*total).collect() if heavy else []
    # Texts that fill a new shard by all rows but one: at most new_shards of them have two rows or more.
    # They are units of their own.
    full = F.col("s") - F.col("s") / F.col("n") >= F.lit(size / new_shards)
    texts = []
    if any(u.s - u.s / u.n >= size / new_shards for u in units):
        texts = rows.where("__units is not null").groupBy(*unit, "__text").agg(*total).where((F.col("n") > 1) & full).collect()
    own = [(t[0], t[1], t["__text"], -1 - n) for n, t in enumerate(texts)]
    rows = rows.join(_lookup(spark, "old_shard int, __block int, __text long, __own int", own), [*block, "__text"], "left")
    rows = rows.withColumn("__unit", F.coalesce("__own", "__unit"))
    if own:
        units = rows.where("__units is not null").groupBy(*unit).agg(*total).collect()
    large = [(u[0], u[1], u[2], parts_of(u)) for u in units if parts_of(u) > 1]
    rows = rows.join(_lookup(spark, "old_shard int, __block int, __unit int, __pieces int", large), unit, "left").withColumn(
        "__piece", F.pmod("__row", F.coalesce("__pieces", F.lit(1))).cast("int"))
    exact = rows.where("__pieces is not null").groupBy(*cut).agg(*total).collect() if large else []
    cut_blocks, cut_units = {h[:2] for h in heavy}, {x[:3] for x in large}
    parts = [(b[0], b[1], 0, 0, b.s, b.n) for b in whole if (b[0], b[1]) not in cut_blocks]
    parts += [(*u[:3], 0, u.s, u.n) for u in units if tuple(u[:3]) not in cut_units] + [tuple(b) for b in exact]
    # Pieces of a unit go together, unless it is a text that is cut by row.
    together: dict[tuple, int] = defaultdict(int)
    for *key, piece, bytes_, _ in parts:
        together[(*key[:2], (key[2], piece if key[2] < 0 else 0))] += bytes_
    placed = place_blocks([(*key, bytes_) for key, bytes_ in together.items()], old_shards, new_shards)
    begin, plan = [0] * new_shards, []
    for *key, piece, _, n in sorted(parts):
        shard = placed[(*key[:2], (key[2], piece if key[2] < 0 else 0))]
        plan.append((*key, piece, shard, begin[shard]))
        begin[shard] += n
    plan_table = _lookup(spark, "old_shard int, __block int, __unit int, __piece int, shard int, __begin long", plan)
    nth = F.row_number().over(Window.partitionBy(*cut).orderBy("doc_id", "__row"))
    placed_rows = rows.withColumn("__nth", nth).join(plan_table, cut).select(
        *others, "shard", (F.col("__begin") + F.col("__nth") - 1).alias("slot"), "old_shard")
    moved = {x for s, _, _, _, shard, _ in plan if s != shard for x in (s, shard)}
    return Resharded(placed_rows, sorted(moved), sorted({p[4] for p in plan}))


def rewrite_shards(resharded: Resharded, path: str) -> DataFrame:
    """Write the files of every shard that gives or takes rows, one folder a shard; return all rows.

    Rows of affected shards are read back from the new files, the others from where they are.
    """
    rows, affected = resharded.rows, F.col("shard").isin(resharded.touched)
    if not resharded.touched:
        return rows
    rows.where(affected).write.partitionBy("shard").parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*rows.columns)
    return written.union(rows.where(~affected)) if set(resharded.used) - set(resharded.touched) else written


def resharded_files(docs: DataFrame, **how) -> DataFrame:
    """``reshard`` with its files in a folder of their own in the shared folder, as read back."""
    return rewrite_shards(reshard(docs, **how), scratch_path(docs.sparkSession, "shards"))
