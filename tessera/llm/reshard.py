"""Resharding by minimum-cost flow.

Documents lie in old shards of uneven sizes; new shards have capacities. Which
bytes go where is a transport problem: old shard i supplies its bytes, new shard
j takes its capacity, keeping a byte where it is costs nothing and moving it
costs one (or what ``cost`` says). It is solved over the shards, of which there
are few, by successive cheapest paths; the flow moves the fewest bytes.

Rows then follow the flow in blocks: every old shard is cut into blocks by a
hash of doc_id, checksum and size (so that rows without an id spread, too), block sizes summed, and the shard's bytes laid out block by
block on a line that the flow divides into stretches, one per new shard. A block
inside a stretch moves whole; where a stretch ends inside a block, the row in
whose middle it ends decides. So a new shard misses its capacity by half a row
for each stretch at most. Slots number a shard's rows by old shard, block and
doc_id, from sums per block. No step needs a shard's rows in one task: ``blocks``
grows with the rows, and an old shard that holds a third of them has as many
blocks as any. Texts aren't shuffled for the plan; ``rewrite`` moves those of the shards
that change, once.

Defined cases: a null text has size 1 (no bytes plus one) and a null checksum.
Rows with null or repeated doc_ids are placed like any, in order of checksum and
size; which of two equal rows gets which slot makes no difference. An empty
table gives an empty result. Extra columns are ignored by ``plan`` and kept by
``rewrite``, which refuses a table with a ``shard`` or ``slot`` of its own.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settled, small_side


def cheapest_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts moved from each old to each new shard at the least total cost;
    ``sum(supply) <= sum(room)``. Successive cheapest paths with potentials."""
    n, m = len(supply), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    potential = [0] * (n + m)
    while any(left):
        # from every old shard with bytes left; old 0..n-1, new n..n+m-1
        reach: list[float] = [float("inf")] * (n + m)
        via = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                reach[i] = -potential[i]
                heap.append((reach[i], i))
        heapq.heapify(heap)
        while heap:
            d, x = heapq.heappop(heap)
            if d > reach[x]:
                continue
            if x < n:
                steps = ((n + j, cost[x][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][x - n]) for i in range(n) if flow[i][x - n])
            for y, c in steps:
                through = d + c + potential[x] - potential[y]
                if through < reach[y]:
                    reach[y], via[y] = through, x
                    heapq.heappush(heap, (through, y))
        end = min((j for j in range(m) if free[j]), key=lambda j: reach[n + j] + potential[n + j])
        path, x = [], n + end
        while via[x] >= 0:
            path.append((via[x], x))
            x = via[x]
        amount = min(left[x], free[end], *[flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[x] -= amount
        free[end] -= amount
        for v in range(n + m):
            if reach[v] < float("inf"):
                potential[v] += reach[v]
    return flow


def even_room(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def _checksum() -> Column:
    return F.crc32(F.col("text").cast("binary"))


def sized(docs: DataFrame, old_shard: Column, *more: str) -> DataFrame:
    return docs.select("doc_id", _size().alias("size"), _checksum().alias("text_crc32"),
                       old_shard.cast("int").alias("old_shard"), *more)


def _place(rows: DataFrame, n_old: int, shards: int, blocks: int, room: list[int] | None,
           cost: list[list[int]] | None) -> DataFrame:
    """``rows``: doc_id, size, text_crc32, old_shard, settled. Adds block and shard."""
    spark = rows.sparkSession
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    sums = settled(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")))
    supply = [0] * n_old
    for r in sums.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect():  # one row per old shard
        supply[r.old_shard] = r.bytes
    room = room or even_room(sum(supply), shards)
    if cost is None:
        cost = [[int(i != j) for j in range(shards)] for i in range(n_old)]
    stretches = []
    for i, amounts in enumerate(cheapest_flow(supply, room, cost)):
        ends, at = [], 0
        # what stays comes first
        for j in sorted(range(shards), key=lambda j: (cost[i][j], j)):
            if amounts[j]:
                at += amounts[j]
                ends.append((at, j))
        stretches.append((i, ends))
    ends = spark.createDataFrame(stretches, "old_shard int, ends array<struct<upto:long,shard:int>>")
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    starts = small_side(settled(
        starts.join(F.broadcast(ends), "old_shard").select("old_shard", "block", "start", "ends")))  # a row per block
    inside = Window.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    return (rows.join(starts, ["old_shard", "block"]).withColumn("at", middle)
            .withColumn("shard", F.element_at(F.filter("ends", lambda e: F.col("at") <= e["upto"]), 1)["shard"])
            .drop("start", "ends", "at"))


def plan(docs: DataFrame, old_shard: Column, n_old: int, shards: int, room: list[int] | None = None,
         cost: list[list[int]] | None = None, rows_per_block: int = 100_000) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` for every row.
    ``room``: bytes each new shard takes (by default equal, to the byte)."""
    rows = settled(sized(docs, old_shard))
    blocks = max(256, -(-rows.count() // (n_old * rows_per_block)))
    placed = settled(_place(rows, n_old, shards, blocks, room, cost))
    counts = placed.groupBy("shard", "old_shard", "block").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    # a row per block, and one more where a stretch ends inside it
    first = small_side(settled(counts.select(
        "shard", "old_shard", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))))
    inside = Window.partitionBy("old_shard", "block", "shard").orderBy("doc_id", "text_crc32", "size")
    return (placed.withColumn("nth", F.row_number().over(inside))
            .join(first, ["shard", "old_shard", "block"])
            .select("doc_id", "size", "text_crc32", "old_shard", "shard",
                    (F.col("first") + F.col("nth") - 1).cast("long").alias("slot")))


def moved_bytes(planned: DataFrame) -> DataFrame:
    """Bytes and rows by old and new shard."""
    return planned.groupBy("old_shard", "shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def rewrite(docs: DataFrame, planned: DataFrame, n_old: int, shards: int, out: str,
            old_shard: Column | None = None) -> list[int]:
    """Write the files of the shards that change: those that lose or gain rows.
    Returns the shards written, each in its own folder ``shard=<n>`` of ``out``,
    with the columns of ``docs``, ``slot`` and the shard each row came from; the other
    shards' files stay as they are, and with ``old_shard`` (as given to ``plan``) their rows
    aren't shuffled. ``planned`` (settled) is the plan of ``docs``. Its entries and the
    rows meet by doc_id, size and checksum, the n-th of equal entries with the n-th
    of equal rows, so null and repeated doc_ids arrive once for each row. A shard
    has a file from each task, sorted by ``slot``, which numbers its rows across them."""
    moves = moved_bytes(planned).where("old_shard <> shard").select("old_shard", "shard").collect()  # n_old * shards
    changed = sorted({r.shard for r in moves} | {r.old_shard for r in moves if r.old_shard < shards})
    if not changed:
        return changed
    if old_shard is not None:  # who leaves or enters a shard changes it: all others stay where they are
        docs = docs.where(old_shard.isin(changed) | (old_shard >= shards))
        planned = planned.where(F.col("old_shard").isin(changed) | (F.col("old_shard") >= shards))
    columns = [F.col(f"`{c}`").alias(free_name(docs, c.lower()) if c.lower() in ("shard", "slot") else c)
               for c in docs.columns]
    wide = docs.select(
        F.col("doc_id").alias("__id"), _size().alias("__size"), _checksum().alias("__crc"),
        F.lit(1).alias("__side"), F.xxhash64(*columns).alias("__order"),
        F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("from"), F.struct(*columns).alias("__row"))
    narrow = planned.select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"),
        F.lit(0).alias("__side"),
        (F.col("shard").cast("long") * (1 << 40) + F.col("slot")).alias("__order"), "shard", "slot",
        F.col("old_shard").alias("from"), F.lit(None).cast(wide.schema["__row"].dataType).alias("__row"))
    equal = ["__id", "__size", "__crc"]
    nth = F.row_number().over(Window.partitionBy(*equal, "__side").orderBy("__order"))
    # one exchange of texts for both windows and the write: an entry stands right before its row
    met = Window.partitionBy(*equal).orderBy("__nth", "__side")
    both = narrow.unionByName(wide).repartition(*equal).withColumn("__nth", nth)
    (both.select("__side", "__row", *[F.lag(c).over(met).alias(c) for c in ("shard", "slot", "from")])
     .where((F.col("__side") == 1) & F.col("shard").isin(changed))
     .select("__row.*", "shard", "slot", F.col("from").alias(free_name(docs, "from")))
     .sortWithinPartitions("shard", "slot")
     .write.mode("overwrite").partitionBy("shard").parquet(out))
    return changed


def resharded(docs: DataFrame, old_shard: Column, n_old: int, shards: int, out: str, **options) -> DataFrame:
    """Plan, rewrite into ``out``, and read back: the columns of ``plan``, from the
    texts in the rewritten shards and, for shards whose files stay, from the plan."""
    planned = settled(plan(docs, old_shard, n_old, shards, **options))
    changed = rewrite(docs, planned, n_old, shards, out, old_shard)
    if not changed:
        return planned
    kept = planned.where(~F.col("shard").isin(changed))
    written = docs.sparkSession.read.parquet(out)
    return sized(written, F.col(free_name(docs, "from")), "shard", "slot").unionByName(kept)
