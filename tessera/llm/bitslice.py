"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to whole numbers (floor of ``scale`` times a component).
The index of a block of rows holds, for every attribute and bit, a bitmap over
the block's rows. A query's inner product with all rows is a sum of shifted
slices: attribute j enters once for each bit of the query's component j, its
complement where that component is negative. The slices of one weight are added
by carry-save adders, three bitmaps to a sum and a carry, until every weight has
one bitmap left: the bit slices of all scores.

The top k are then read from the most significant slice downward: rows with the
bit set are taken while they are k or fewer in all, else they stay in the race and
the others leave. Rows still in the race after the last slice have equal scores;
they are on the boundary, and the smallest ids fill the remaining places. All
steps are exact integer arithmetic.

Blocks hold rows by a hash of their id, so their sizes are even whatever the
vectors are. Every chunk of queries meets every block (the query set is fixed,
blocks and chunks are packed rows of bounded size joined on the block's number);
blocks' results are merged in groups.

Defined cases: vectors that are null, empty, or hold null or non-finite
components take no part, nor do those whose length isn't the table's usual one
or rows without an id. A row that repeats both id and vector counts once. Vectors with
a component too large for 64-bit sums stand in blocks and chunks of their own, whose
scores are whole-number products of any length; a score that a long can't hold is its end
(2^63 - 1, or its negative), and such rows rank as ties. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, merge_best, settled
from .vectors import matrix, sound, usual_length

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


MOST = 2 ** 63 - 1


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * vectors.astype(np.float64)).astype(np.int64)


def component_limit(dims: int, scale: float) -> float:
    """Components below it have products whose sums, and the slices' complements, fit in 62 bits."""
    return 2.0 ** ((56 - dims.bit_length()) // 2) / scale


def whole_numbers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """``quantised`` for components of any size: Python integers."""
    by = Fraction(scale)
    return np.array([[math.floor(Fraction(x) * by) for x in row] for row in vectors.tolist()],
                    object).reshape(vectors.shape)


class LargeBlock:
    """A block with large components: its scores are computed number by number."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values

    def best(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        score = np.array([max(-MOST, min(MOST, int(s))) for s in self.values.dot(query.astype(object))], np.int64)
        order = np.lexsort([self.ids, -score])
        order = order[self.ids[order] != own][:k]
        return self.ids[order], score[order]


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For whole numbers (rows, attributes): each attribute's least value, and
    bitmaps (attributes, bits, words) of what lies above it."""
    low = values.min(axis=0)
    above = (values - low).astype(np.uint64)
    bits, words = max(int(above.max()).bit_length(), 1), -(-len(values) // 64)
    out = np.zeros((values.shape[1], bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, b, :packed.shape[1]] = packed
    return low, out.view(np.uint64)


class BlockIndex:
    """The index of one block; ``ids`` ascend."""

    def __init__(self, ids: np.ndarray, low: np.ndarray, slices: np.ndarray):
        self.ids, self.low = ids, low
        self.slices = np.stack([slices, slices ^ ONES])  # plain, complement
        self.bits, self.words = slices.shape[1:]
        self.rows = np.zeros(self.words * 64, np.uint8)
        self.rows[:len(ids)] = 1
        self.rows = np.packbits(self.rows, bitorder="little").view(np.uint64)

    def values(self) -> np.ndarray:
        """The rows' whole numbers, read back from the slices."""
        out = np.repeat(self.low[None], len(self.ids), axis=0)
        for b in range(self.bits):
            plain = np.unpackbits(self.slices[0, :, b].copy().view(np.uint8), axis=-1, bitorder="little")
            out += plain[:, :len(self.ids)].T.astype(np.int64) << b
        return out

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Bit slices (weights, words) of all rows' scores less a constant, and that constant."""
        negative, size = query < 0, np.abs(query)
        top = (1 << self.bits) - 1
        most = sum(int(s) for s in size) * top
        constant = (sum(int(q) * int(x) for q, x in zip(query, self.low))
                    - sum(int(s) for s in size[negative]) * top)
        if most >> 62 or abs(constant) >> 62:
            raise ValueError("an inner product has more than 62 bits")
        weights = max(most.bit_length(), 1)
        by_bit = [np.flatnonzero((size >> c) & 1) for c in range(int(size.max()).bit_length())]
        sums, carried = np.zeros((weights, self.words), np.uint64), [[] for _ in range(weights + 2)]
        for w in range(weights):
            terms = [(at, np.full(len(at), w - c)) for c, at in enumerate(by_bit) if 0 <= w - c < self.bits]
            if terms:
                at, bit = np.concatenate([t[0] for t in terms]), np.concatenate([t[1] for t in terms])
                carried[w].append(self.slices[negative[at].astype(np.intp), at, bit])
            if not carried[w]:
                continue
            maps = np.concatenate(carried[w]) if len(carried[w]) > 1 else carried[w][0]
            while len(maps) > 2:
                n = len(maps) // 3
                a, b, c = maps[:n], maps[n:2 * n], maps[2 * n:3 * n]
                either = a ^ b
                carried[w + 1].append((a & b) | (either & c))
                maps = np.concatenate([either ^ c, maps[3 * n:]])
            if len(maps) == 2:
                carried[w + 1].append((maps[0] & maps[1])[None])
                maps = (maps[0] ^ maps[1])[None]
            if len(maps):
                sums[w] = maps[0]
            carried[w] = []
        return sums, constant

    def best(self, query: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the top k rows but ``own``, ties to smaller ids."""
        race = self.rows.copy()
        if own is not None:
            for i in range(*np.searchsorted(self.ids, [own, own + 1])):
                race[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        sums, constant = self.scores(query)
        taken, n_taken = np.zeros_like(race), 0
        for bits in sums[::-1]:
            ahead = race & bits
            n = int(np.bitwise_count(ahead).sum())
            if n_taken + n > k:
                race = ahead
            else:
                taken |= ahead
                n_taken += n
                race = race & ~bits
                if n_taken == k:
                    break
        at = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        if len(at) < k:
            ties = np.flatnonzero(np.unpackbits(race.view(np.uint8), bitorder="little"))
            at = np.concatenate([at, ties[:k - len(at)]])
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        score = np.full(len(at), constant, np.int64)
        for w, bits in enumerate(sums):
            score += ((bits[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        order = np.lexsort([self.ids[at], -score])
        return self.ids[at][order], score[order]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
           k: int = 20, scale: float = 64.0, block_rows: int = 1 << 15, chunk_rows: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` holds
    for, its ``k`` largest scores among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(sound(F.col("vec")) & F.col("id").isNotNull())
    dims, n = usual_length(rows, "vec")
    result = "query_id long, best array<struct<less:long,id:long>>"
    if not n:
        return _ranked(spark.createDataFrame([], result), k)
    limit = component_limit(dims, scale)
    rows = rows.where(F.size("vec") == dims).withColumn("large", F.exists("vec", lambda x: F.abs(x) >= limit))
    n_large = rows.where("large").count()
    # blocks of large vectors are numbered after the others
    n_plain = -(-(n - n_large) // block_rows)
    n_blocks = n_plain + -(-n_large // block_rows)

    def distinct(t: pa.Table, large: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and quantised (or, of large ones, original) vectors without repeated rows."""
        ids, x = t["id"].to_numpy(), matrix(t["vec"], dims).astype(np.float64)
        x = x.view(np.int64) if large else quantised(x, scale)
        keyed = np.unique(np.column_stack([ids, x]), axis=0)
        return keyed[:, 0].copy(), np.ascontiguousarray(keyed[:, 1:])

    def pack_block(t: pa.Table) -> pa.Table:
        large = t["block"][0].as_py() >= n_plain
        ids, x = distinct(t, large)
        low, slices = (np.zeros(0, np.int64), x) if large else slices_of(x)
        return pa.table({"block": t["block"][:1], "ids": [ids.tobytes()], "low": [low.tobytes()],
                         "bits": pa.array([0 if large else slices.shape[1]], pa.int32()), "slices": [slices.tobytes()]})

    def pack_chunk(t: pa.Table) -> pa.Table:
        large = t["large"][0].as_py()
        ids, x = distinct(t, large)
        return pa.table({"chunk": t["chunk"][:1], "large": t["large"][:1],
                         "queries": [np.column_stack([ids, x]).tobytes()]})

    def raw(values: np.ndarray) -> np.ndarray:
        return whole_numbers(np.ascontiguousarray(values).view(np.float64), scale)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, exact = None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != held:
                    held, exact = r["block"], None
                    ids = np.frombuffer(r["ids"], np.int64)
                    index = LargeBlock(ids, raw(np.frombuffer(r["slices"], np.int64).reshape(-1, dims))) if not r[
                        "bits"] else BlockIndex(ids, np.frombuffer(r["low"], np.int64),
                                                np.frombuffer(r["slices"], np.uint64).reshape(dims, r["bits"], -1))
                queries = np.frombuffer(r["queries"], np.int64).reshape(-1, dims + 1)
                vectors, here = queries[:, 1:], index
                if r["large"]:
                    vectors = raw(vectors)
                    if r["bits"]:
                        here = exact = exact or LargeBlock(ids, index.values().astype(object))
                found = [here.best(v, k, int(q)) for q, v in zip(queries[:, 0].tolist(), vectors)]
                yield pa.RecordBatch.from_pydict(
                    {"query_id": queries[:, 0], "block": np.full(len(queries), held, np.int32),
                     "best": [[{"less": -s, "id": i} for i, s in zip(ids.tolist(), score.tolist())]
                              for ids, score in found]},
                    schema=pa.schema([("query_id", pa.int64()), ("block", pa.int32()),
                                      ("best", pa.list_(pa.struct([("less", pa.int64()), ("id", pa.int64())])))]))

    def dealt(frame: DataFrame, name: str, plain: int, parts: int) -> DataFrame:
        """Plain vectors to the first ``plain`` numbers, large ones to the others."""
        def at(n: int) -> Column:
            return F.pmod(F.xxhash64("id"), F.lit(max(n, 1)))
        return frame.withColumn(name, F.when(F.col("large"), plain + at(parts - plain)).otherwise(at(plain)).cast("int"))

    index = settled(dealt(rows.select("id", "vec", "large"), "block", n_plain, n_blocks).groupBy("block")
                    .applyInArrow(pack_block, "block int, ids binary, low binary, bits int, slices binary"))
    asked = rows.where("asks")
    n_asked, n_large_asked = asked.agg(F.count(F.lit(1)), F.count_if("large")).first()
    plain_chunks = max(1, -(-(n_asked - n_large_asked) // chunk_rows))
    n_chunks = plain_chunks + -(-n_large_asked // chunk_rows)
    chunks = settled(dealt(asked.select("id", "vec", "large"), "chunk", plain_chunks, n_chunks).groupBy("chunk")
                     .applyInArrow(pack_chunk, "chunk int, large boolean, queries binary"))
    # few blocks are repeated, so that enough tasks share the chunks
    lanes = max(1, min(n_chunks, 2 * spark.sparkContext.defaultParallelism // n_blocks))
    left = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = chunks.select(F.pmod("chunk", F.lit(lanes)).alias("lane"), "large", "queries",
                          F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    with arrow_rows(spark, 4):  # these rows are megabytes each
        found = settled(left.join(right.hint("shuffle_merge"), ["block", "lane"])
                        .mapInArrow(answer, "query_id long, block int, best array<struct<less:long,id:long>>"))
    return _ranked(merge_best(found, ["query_id"], "block", "best", k, n_blocks), k)


def _ranked(merged: DataFrame, k: int) -> DataFrame:
    return merged.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
        (-F.col("hit.less")).alias("score"))
