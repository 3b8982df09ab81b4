"""Approximate nearest neighbours by largest inner product: balanced posting
lists, boundary vectors in several lists, a graph over the lists' centroids.

Fitting: a bounded sample (``sample_rows``, by a hash of the id) is halved again
and again, each time at the median along the line between the centres of two
clusters, until the parts have the size of a list; so the lists are balanced.
Their means are the centroids, at most ``max_lists``, linked to their nearest
neighbours and, in tree order, to the next one: a connected graph that every
worker holds in memory and searches from a few entry points.

Inner products become distances by one more component, which brings every row to
the largest norm (queries have zero there); for unit vectors nothing changes.

Index: every row enters its nearest list and, being near a boundary, up to
``replicas`` - 1 others not further than ``1 + boundary`` times that distance; a list whose
centroid lies close to that of a chosen one (``thin`` times as far as from the row, at most) is
left out, as a search that reads the one will hardly need the other.
Search: the graph finds the lists whose centroid is within ``1 + reach`` times the
distance of the nearest; these are read. So easy queries read few lists and hard
ones many, without a fixed number. ``reach`` is fitted: for a bounded sample of the queries
(``tuning_queries``, by a hash) the exact neighbours are found in one pass, and the least
ratio is taken at which the lists read would have held the share ``recall`` of them.

Equal vectors are one entry with their k + 1 smallest ids, which is all a result
can hold of them, gathered in salted steps; a vector that makes up a third of the
table costs no more than any. Lists are packed into cells of about ``cell_rows``
entries, a list larger than that is spread over several; each cell and each chunk
of the queries that reach it is one packed row. Cells' results are merged in
groups. Scores are computed in double precision on the original vectors, one
component order for all, so equal vectors have equal scores.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do those whose length isn't the table's usual one
or rows without an id; as queries they return nothing. Ties go to the smaller id.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, hash_share, merge_best, settled
from .vectors import matrix, sound, usual_length

_BEST = "array<struct<less:double,id:long>>"
_BEST_ARROW = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Means of the leaves of a tree of even halvings, in tree order."""
    rng = np.random.default_rng(seed)
    leaf, out, todo = max(1, -(-len(x) // max(lists, 1))), [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(x[at].mean(axis=0))
            continue
        part = x[at]
        a = part[np.argmax(((part - part[rng.integers(len(part))]) ** 2).sum(1))]
        b = part[np.argmax(((part - a) ** 2).sum(1))]
        for _ in range(6):
            near_b = part @ (b - a) > ((b ** 2).sum() - (a ** 2).sum()) / 2
            if near_b.all() or not near_b.any():
                break
            a, b = part[~near_b].mean(axis=0), part[near_b].mean(axis=0)
        order = np.argsort(part @ (b - a), kind="stable")
        half = len(at) // 2
        todo += [at[order[half:]], at[order[:half]]]
    return np.array(out)


class CentroidGraph:
    """Centroids linked to near ones; searched for all queries of a batch at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.c, self.c2 = centroids, (centroids ** 2).sum(1)
        n = len(centroids)
        links: list[set[int]] = [{i - 1, i + 1} & set(range(n)) for i in range(n)]
        for s in range(0, n, 1024):
            d = self.c2[None] - 2 * centroids[s:s + 1024] @ centroids.T
            near = np.argsort(d, axis=1)[:, :degree + 1]
            for i, row in enumerate(near.tolist(), s):
                links[i].update(j for j in row if j != i)
                for j in row:
                    if j != i:
                        links[j].add(i)
        self.links = np.full((n, max(map(len, links), default=0)), -1, np.int32)
        for i, row in enumerate(links):
            self.links[i, :len(row)] = sorted(row)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))

    def distances(self, q: np.ndarray, reach: float, beam: int) -> np.ndarray:
        """Distances (queries, lists); infinite for lists that the search didn't
        come to. It goes on from every list among the ``beam`` nearest seen, or
        within ``1 + reach`` times the nearest."""
        n, m = len(q), len(self.c)
        q2 = (q ** 2).sum(1)
        dist, spent = np.full((n, m), np.inf), np.zeros((n, m), bool)

        def measure(at: np.ndarray, to: np.ndarray) -> None:
            for s in range(0, len(at), 1 << 15):
                i, j = at[s:s + (1 << 15)], to[s:s + (1 << 15)]
                dist[i, j] = np.sqrt(np.maximum(q2[i] + self.c2[j] - 2 * np.einsum("ij,ij->i", q[i], self.c[j]), 0))

        measure(np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n))
        beam = min(beam, m)
        while True:
            near = np.maximum((1 + reach) * dist.min(axis=1), np.partition(dist, beam - 1, axis=1)[:, beam - 1])
            fresh = ~spent & (dist <= near[:, None]) & np.isfinite(dist)
            if not fresh.any():
                return dist
            spent |= fresh
            i, j = np.nonzero(fresh)
            to = self.links[j]
            at = np.repeat(i, to.shape[1])
            to = to.ravel()
            new = to >= 0
            at, to = at[new], to[new]
            new = np.isinf(dist[at, to])
            pairs = np.unique(at[new] * np.int64(m) + to[new])
            measure(pairs // m, pairs % m)


def _raised(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x ** 2).sum(1), 0))])


def _asked(q: np.ndarray, most: float) -> np.ndarray:
    q = q.astype(np.float64)
    return np.column_stack([q * (np.sqrt(most) / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))])


def _entries(rows: DataFrame, k: int, n: int) -> DataFrame:
    """One row per distinct vector: ``rep`` (its least id), ``vec``, ``ids`` (its
    k + 1 smallest) and whether a query has it."""
    salts = max(8, n // 50_000)
    some = rows.groupBy("vec", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(
        F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asks").alias("asks"))
    return some.groupBy("vec").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"),
        F.max("asks").alias("asks")).select(F.col("ids")[0].alias("rep"), "vec", "ids", "asks")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20,
           list_rows: int = 512, replicas: int = 4, boundary: float = 0.1, thin: float = 0.4, reach: float | None = None,
           recall: float = 0.98, tuning_queries: int = 128, beam: int = 8,
           sample_rows: int = 32_768, max_lists: int = 4_096, cell_rows: int = 1 << 14,
           chunk_rows: int = 1_024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` holds
    for, the ``k`` nearest found among all other rows. ``reach``: given, it isn't fitted."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"),
                          F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(sound(F.col("vec")) & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull())
    dims, n = usual_length(rows, "vec")
    if not n:
        return _ranked(spark.createDataFrame([], f"query_id long, best {_BEST}"), k)
    rows = rows.where(F.size("vec") == dims)
    entries = settled(_entries(rows, k, n))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n_entries, n_asking, most = entries.agg(
        F.count(F.lit(1)), F.sum(F.col("asks").cast("int")), F.max(norm)).first()

    sample = entries.where(hash_share(F.lit("lists"), F.col("rep")) < sample_rows / n_entries).select("rep", "vec")
    sample = sample.toArrow()
    x = _raised(matrix(sample["vec"], dims), most)[np.argsort(sample["rep"].to_numpy(), kind="stable")]
    if not len(x):  # a handful of rows, none of them drawn
        first = entries.select("vec").limit(1).toArrow()
        x = _raised(matrix(first["vec"], dims), most)
    lists = min(max_lists, max(1, -(-n_entries // list_rows)), len(x))
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(x, lists)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                dist = graph.value.distances(_raised(matrix(part["vec"], dims), most), boundary, beam)
                order = np.argsort(dist, axis=1, kind="stable")[:, :replicas]
                near = np.take_along_axis(dist, order, axis=1)
                chosen = np.isfinite(near) & (near <= near[:, :1] * (1 + boundary))
                for b in range(1, chosen.shape[1]):
                    for a in range(b):
                        apart = np.linalg.norm(graph.value.c[order[:, a]] - graph.value.c[order[:, b]], axis=1)
                        chosen[:, b] &= ~(chosen[:, a] & (apart <= thin * near[:, b]))
                row, nth = np.nonzero(chosen)
                out = part.select(["rep", "vec", "ids"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[row, nth].astype(np.int32)), *out.columns], ["list", *out.schema.names])

    kind = entries.schema["vec"].dataType.simpleString()
    posted = settled(entries.select("rep", "vec", "ids").mapInArrow(
        post, f"list int, rep long, vec {kind}, ids array<bigint>"))

    if reach is None:
        reach = _fitted_reach(entries, posted, graph.value.c, dims, most, k, recall, tuning_queries)

    # lists into cells; at most max_lists numbers on the driver
    sizes = sorted((r["list"], r["count"]) for r in posted.groupBy("list").count().collect())
    cell_of, n_cells, room = {}, 0, 0
    for number, size in sizes:
        if size > cell_rows:
            cell_of[number] = (n_cells, -(-size // cell_rows))
            n_cells, room = n_cells + cell_of[number][1], 0
        else:
            if size > room:
                n_cells, room = n_cells + 1, cell_rows
            cell_of[number] = (n_cells - 1, 1)
            room -= size
    places = spark.createDataFrame([(a, *b) for a, b in cell_of.items()], "list int, first int, parts int")
    celled = posted.join(F.broadcast(places), "list").withColumn(
        "cell", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def pack_cell(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort([t["rep"].to_numpy(), t["list"].to_numpy()])))
        ids = t["ids"].combine_chunks()
        ends = np.cumsum(ids.value_lengths().to_numpy())
        return pa.table({"cell": t["cell"][:1], "lists": [t["list"].to_numpy().tobytes()],
                         "vectors": [matrix(t["vec"], dims).astype(np.float64).tobytes()],
                         "ids": [ids.flatten().to_numpy().tobytes()], "ends": [ends.astype(np.int64).tobytes()]})

    cells = settled(celled.drop("first", "parts").groupBy("cell").applyInArrow(
        pack_cell, "cell int, lists binary, vectors binary, ids binary, ends binary"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 128):
                part = batch.slice(s, 128)
                dist = graph.value.distances(_asked(matrix(part["vec"], dims), most), reach, beam)
                rows_out, cells_out, lists_out = [], [], []
                for i, d in enumerate(dist):
                    by_cell: dict[int, list[int]] = {}
                    for j in np.flatnonzero(d <= d.min() * (1 + reach)).tolist():
                        first, parts = cell_of.get(j, (0, 0))
                        for c in range(first, first + parts):
                            by_cell.setdefault(c, []).append(j)
                    rows_out += [i] * len(by_cell)
                    cells_out += by_cell.keys()
                    lists_out += by_cell.values()
                out = part.select(["rep", "vec"]).take(pa.array(rows_out, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(cells_out, pa.int32()), pa.array(lists_out, pa.list_(pa.int32()))],
                    ["rep", "vec", "cell", "lists"])

    def pack_chunk(t: pa.Table) -> pa.Table:
        lists = t["lists"].combine_chunks()
        ends = np.cumsum(lists.value_lengths().to_numpy())
        return pa.table({"cell": t["cell"][:1], "chunk": t["chunk"][:1], "reps": [t["rep"].to_numpy().tobytes()],
                         "queries": [matrix(t["vec"], dims).astype(np.float64).tobytes()],
                         "probed": [lists.flatten().to_numpy().tobytes()],
                         "stops": [ends.astype(np.int64).tobytes()]})

    n_chunks = max(1, -(-n_asking // chunk_rows))
    chunks = (entries.where("asks").select("rep", "vec").mapInArrow(
        probe, f"rep long, vec {kind}, cell int, lists array<int>")
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(n_chunks)).cast("int"))
        .groupBy("cell", "chunk").applyInArrow(
            pack_chunk, "cell int, chunk int, reps binary, queries binary, probed binary, stops binary"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                cell = _Cell(r, dims, replicas)
                reps = np.frombuffer(r["reps"], np.int64)
                queries = np.frombuffer(r["queries"]).reshape(-1, dims)
                probed = np.split(np.frombuffer(r["probed"], np.int32), np.frombuffer(r["stops"], np.int64)[:-1])
                yield pa.RecordBatch.from_pydict(
                    {"rep": reps, "cell": np.full(len(reps), r["cell"], np.int32),
                     "best": cell.nearest(queries, probed, k + 1)},
                    schema=pa.schema([("rep", pa.int64()), ("cell", pa.int32()), ("best", _BEST_ARROW)]))

    with arrow_rows(spark, 2):  # these rows are megabytes each
        found = settled(cells.join(settled(chunks).hint("shuffle_merge"), "cell")
                        .mapInArrow(answer, f"rep long, cell int, best {_BEST}"))
    merged = settled(merge_best(found, ["rep"], "cell", "best", k + 1, max(n_cells, 1)))
    askers = rows.where("asks").select(F.col("id").alias("query_id"), "vec").distinct()
    return _ranked(askers.join(entries.where("asks").select("vec", "rep"), "vec").join(merged, "rep").select(
        "query_id", F.filter("best", lambda b: b["id"] != F.col("query_id")).alias("best")), k)


def _fitted_reach(entries: DataFrame, posted: DataFrame, centroids: np.ndarray, dims: int, most: float, k: int,
                  recall: float, tuning_queries: int) -> float:
    """The least ratio at which the lists read hold ``recall`` of the exact neighbours
    of some queries. The driver gets these queries, their neighbours and the neighbours' lists."""
    some = (entries.where("asks").select("rep", "vec").orderBy(F.xxhash64(F.lit("tuning"), F.col("rep")), "rep")
            .limit(tuning_queries).toArrow())
    if not some.num_rows:
        return 0.0
    asking, q = some["rep"].to_numpy(), matrix(some["vec"], dims).astype(np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
        for batch in batches:
            ids = np.column_stack([ids, np.tile(batch["rep"].to_numpy(), (len(q), 1))])
            scores = np.column_stack([scores, q @ matrix(batch["vec"], dims).astype(np.float64).T])
            if scores.shape[1] > k + 1:
                top = np.argpartition(-scores, k, axis=1)[:, :k + 1]
                ids, scores = np.take_along_axis(ids, top, axis=1), np.take_along_axis(scores, top, axis=1)
        if scores.shape[1]:
            yield pa.RecordBatch.from_pydict(
                {"q": np.arange(len(q), dtype=np.int32),
                 "best": [sorted(({"less": -x, "id": i} for x, i in zip(a, b)), key=lambda e: (e["less"], e["id"]))
                          for a, b in zip(scores.tolist(), ids.tolist())]},
                schema=pa.schema([("q", pa.int32()), ("best", _BEST_ARROW)]))

    parts = 4096
    found = (entries.select("rep", "vec").mapInArrow(nearest, f"q int, best {_BEST}")
             .withColumn("part", F.spark_partition_id() % parts))
    near = {r.q: [b.id for b in r.best] for r in merge_best(found, ["q"], "part", "best", k + 1, parts).collect()}
    wanted = sorted({i for held in near.values() for i in held})
    lists: dict[int, list[int]] = {}
    reps = entries.sparkSession.createDataFrame([(i,) for i in wanted], "rep long")  # tuning_queries * (k + 1) at most
    for r in posted.join(F.broadcast(reps), "rep").select("rep", "list").collect():
        lists.setdefault(r.rep, []).append(r.list)
    needed = []
    for i, (own, raised) in enumerate(zip(asking.tolist(), _asked(q, most))):
        d = np.linalg.norm(centroids - raised, axis=1)
        # rounding leaves nothing that stands at the limit itself outside
        ratio = d / max(float(d.min()), 1e-12) * (1 + 1e-9)
        needed += [float(ratio[lists[x]].min()) - 1 for x in near[i] if x != own]
    needed.sort()
    return max(0.0, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if needed else 0.0


class _Cell:
    """Entries of one packed row, by list."""

    def __init__(self, r: dict, dims: int, copies: int):
        self.copies = copies
        self.lists = np.frombuffer(r["lists"], np.int32)
        self.x = np.frombuffer(r["vectors"]).reshape(-1, dims)
        self.ids = np.split(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ends"], np.int64)[:-1])
        self.least = np.array([i[0] for i in self.ids])
        self.numbers, self.place = np.unique(self.lists, return_inverse=True)

    def nearest(self, queries: np.ndarray, probed: list[np.ndarray], k: int) -> list[list[dict]]:
        out = []
        for s in range(0, len(queries), 128):
            q = queries[s:s + 128]
            score = q @ self.x.T
            read = np.array([np.isin(self.numbers, p) for p in probed[s:s + 128]])
            score[~read[:, self.place]] = -np.inf
            kept = k * self.copies  # an entry can stand in as many lists
            if score.shape[1] > kept:
                least = np.partition(score, score.shape[1] - kept, axis=1)[:, -kept]
            else:
                least = np.full(len(q), -np.inf)
            slack = 1e-12 * np.abs(q).sum(axis=1) * (np.abs(self.x).max() if self.x.size else 0)
            for i in range(len(q)):
                at = np.flatnonzero((score[i] >= least[i] - slack[i]) & (score[i] > -np.inf))
                exact = (self.x[at] * q[i]).sum(axis=1)
                order = np.lexsort([self.least[at], -exact])
                _, first = np.unique(self.least[at[order]], return_index=True)
                order = order[np.sort(first)][:k]
                hits = [(e, int(v)) for j, e in zip(at[order].tolist(), (-exact[order]).tolist())
                        for v in self.ids[j]]
                out.append([{"less": e, "id": v} for e, v in sorted(hits)[:k]])
        return out


def _ranked(merged: DataFrame, k: int) -> DataFrame:
    return merged.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
        (-F.col("hit.less")).alias("score"))
