"""Prefix trie of conversations by double arrays.

A node stands for the conversations that begin with the same turns. Tries are
packed per prefix shard; what lies above the shards is merged globally.

1. Turns are put in order within their conversation; from here on a turn is the
   digest of its role and text, and its bytes. Running exclusive-ors over digests
   of (position, turn) give every prefix a 128-bit key.
2. Conversations with the same turns collapse to one sequence, named by the least
   conv_id, with their number. The hash of their ids is taken once per sequence: long
   lists are sorted over range partitions, cut into texts of some thousand ids and
   hashed by a task that streams these.
3. A prefix with more than ``shard_rows`` turns of distinct sequences below it is an
   upper node. The prefixes under these are shard roots: a hot first turn is split at
   its second, third, ... turn until the parts fit. Shards are dealt over tasks of about
   ``task_rows`` rows.
4. A task numbers its turns densely in the order in which they are first needed,
   packs BASE and CHECK level by level (a child of state s by turn t sits at BASE[s] + t,
   and CHECK there names s; single children take any free cell, siblings the first place
   where all their cells are free) and traverses it with all sequences at once. Members,
   children, leaves and tokens are summed from the deepest level upward.
5. Upper nodes get their members by one grouped sum. Each node's own share of leaves and
   tokens, and each shard root's total, is booked on the path of its least member;
   sums from below along those paths, grouped by prefix, give the subtree sums.

The driver sees counts only. Tables that are broadcast (upper nodes) are counted first.
A task that orders turns holds no conversation: the window streams and spills.

Defined cases: turns with a null conv_id belong to no conversation and are left out. Null
roles and texts are empty. Turns come by turn number, nulls first; those of one number by
digest of role and text, so repeated rows stay repeated turns and ties have a fixed
order. A table without conversations has no root and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled, small_side

SHARD_ROWS, TASK_ROWS = 20_000, 100_000
#: Ids whose list is joined in one piece.
PIECE = 8_192
KEY = ["depth", "k1", "k2"]


# -- turns --------------------------------------------------------------------
def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), t1, t2 (the turn's digest), bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))

    def half(at: int) -> Column:
        return F.conv(F.substring("digest", at, 16), 16, -10).cast("long")

    rows = (conversations.where("conv_id is not null")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                    F.octet_length(text).cast("long").alias("bytes")))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", (F.row_number().over(by) - 1).cast("long").alias("pos"),
                       half(1).alias("t1"), half(17).alias("t2"), "bytes")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c begins with the first h turns of c - c % 5, h = crc32(c) % 9,
    and goes on after its own first h. Returns the rebuilt turns and the ids."""
    turns = settled(turns)
    c = F.col("conv_id")
    ids = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))
           .select("conv_id", (F.crc32(c.cast("string")) % 9).alias("h"), (c - c % 5).alias("base")))
    # the lender's first turns, at most eight; few rows of a few figures for each conversation
    lent = ids.where("h > 0").join(
        turns.where("pos < 8 and conv_id % 5 = 0").withColumnRenamed("conv_id", "lender"),
        (F.col("base") == F.col("lender")) & (F.col("pos") < F.col("h"))
    ).select("conv_id", "pos", "t1", "t2", "bytes")
    lent = settled(lent)
    n = lent.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lent"))
    own = (turns.join(ids.join(n, "conv_id", "left"), "conv_id").where("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.coalesce("n_lent", F.lit(0))).alias("pos"),
                   "t1", "t2", "bytes"))
    return lent.unionByName(own), ids.select("conv_id")


# -- sequences ------------------------------------------------------------------
def _hash_long_lists(ids: DataFrame) -> DataFrame:
    """``ids``: rep, conv_id. The hash of each rep's ids in order, comma-joined,
    without holding a list: pieces are joined in parallel, then streamed."""
    def pieces(batches):
        rep, held = None, []
        for pdf in batches:
            for r, c in zip(pdf["rep"].tolist(), pdf["conv_id"].tolist()):
                if held and (r != rep or len(held) >= PIECE):
                    yield pd.DataFrame({"rep": [rep], "first": [held[0]], "text": [",".join(map(str, held))]})
                    held = []
                rep = r
                held.append(c)
        if held:
            yield pd.DataFrame({"rep": [rep], "first": [held[0]], "text": [",".join(map(str, held))]})

    def hashes(batches):
        rep, sha = None, None
        for pdf in batches:
            for r, t in zip(pdf["rep"].tolist(), pdf["text"].tolist()):
                if r != rep:
                    if rep is not None:
                        yield pd.DataFrame({"rep": [rep], "sha": [sha.hexdigest()]})
                    rep, sha = r, hashlib.sha256(t.encode())
                else:
                    sha.update(b"," + t.encode())
        if rep is not None:
            yield pd.DataFrame({"rep": [rep], "sha": [sha.hexdigest()]})

    parted = (ids.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
              .mapInPandas(pieces, "rep long, first long, text string"))
    return (parted.repartition("rep").sortWithinPartitions("rep", "first")
            .mapInPandas(hashes, "rep long, sha string"))


def sequences(turns: DataFrame, ids: DataFrame, long_list: int) -> DataFrame:
    """One row per distinct sequence: rep (least conv_id), n conversations, len, sha."""
    whole = (turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.bit_xor("x1").alias("s1"),
                                          F.bit_xor("x2").alias("s2")))
    zero = F.lit(0).cast("long")
    each = settled(ids.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("len", "s1", "s2")]))
    same = ["len", "s1", "s2"]
    groups = settled(each.groupBy(*same).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    most = groups.agg(F.max("n")).first()[0] or 0
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    if most <= long_list:
        return each.groupBy(*same).agg(
            F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.sha2(listed, 256).alias("sha")
        ).select("rep", "n", "len", "sha")
    big = small_side(settled(groups.where(F.col("n") > long_list)))
    short = (each.join(big, same, "left_anti").groupBy(*same)
             .agg(F.min("conv_id").alias("rep"), F.sha2(listed, 256).alias("sha")))
    long = _hash_long_lists(each.join(big, same).select("rep", "conv_id"))
    shas = short.select("rep", "sha").unionByName(long)
    return groups.join(shas, "rep").select("rep", "n", "len", "sha")


# -- double arrays ----------------------------------------------------------------
class DoubleArray:
    """BASE and CHECK over states and dense turn ids; state 0 is the root."""

    def __init__(self):
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.end, self.hint = 1, 1  # behind the last used cell; below it nothing is free

    def _reach(self, size: int):
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self) -> np.ndarray:
        free = np.flatnonzero(self.check[self.hint:self.end] < 0) + self.hint
        self.hint = int(free[0]) if len(free) else self.end
        return free

    def single(self, parents: np.ndarray, turns: np.ndarray):
        """One child each: any free cells, each BASE follows from its cell."""
        cells = self._free()[:len(parents)]
        beyond = len(parents) - len(cells)
        self._reach(self.end + beyond)
        cells = np.concatenate([cells, np.arange(self.end, self.end + beyond)])
        self.end += beyond
        self.check[cells] = parents
        self.base[parents] = cells - turns

    def siblings(self, parent: int, turns: np.ndarray):
        """The first place where the cells of all children are free."""
        offsets, span = turns - turns[0], int(turns[-1] - turns[0])
        self._reach(self.end + span + 1)
        free, at = self._free(), self.end
        for i in range(0, len(free), 256):
            firsts = free[i:i + 256]
            self._reach(int(firsts[-1]) + span + 1)
            ok = np.ones(len(firsts), bool)
            for o in offsets[1:].tolist():
                ok &= self.check[firsts + o] < 0
                if not ok.any():
                    break
            if ok.any():
                at = int(firsts[np.argmax(ok)])
                break
        cells = at + offsets
        self.check[cells] = parent
        self.base[parent] = at - int(turns[0])
        self.end = max(self.end, at + span + 1)

    def walk(self, states: np.ndarray, turns: np.ndarray) -> np.ndarray:
        cells = self.base[states] + turns
        if not np.array_equal(self.check[cells], states):
            raise AssertionError("a sequence left its trie")
        return cells


def build(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Pack sequences of turn codes; returns the array and, for each level, the
    sequences that reach it and their states there."""
    da, levels = DoubleArray(), []
    dense = np.full(int(codes.max()) + 1 if len(codes) else 0, -1, np.int64)
    known = 0
    state = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    for level in range(int(lengths.max()) if len(lengths) else 0):
        live = live[lengths[live] > level]
        raw, at = codes[starts[live] + level], state[live]
        order = np.lexsort([raw, at])
        first = np.ones(len(order), bool)
        first[1:] = (raw[order][1:] != raw[order][:-1]) | (at[order][1:] != at[order][:-1])
        edges = order[first]
        parents, turn = at[edges], raw[edges]
        new, where = np.unique(turn[dense[turn] < 0], return_index=True)
        dense[new[np.argsort(where)]] = known + np.arange(len(new))
        known += len(new)
        turn = dense[turn]
        cut = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        counts = np.diff(np.append(cut, len(parents)))
        for c, k in zip(cut[counts > 1].tolist(), counts[counts > 1].tolist()):
            da.siblings(int(parents[c]), np.sort(turn[c:c + k]))
        lone = cut[counts == 1]
        if len(lone):
            da.single(parents[lone], turn[lone])
        state[live] = da.walk(at, dense[raw])
        levels.append((live, state[live]))
    return da, levels


_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, sha string, p1 long, p2 long, top boolean")


def shard_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a task's shards. Rows: rep, n, depth, top (the shard root's row), the
    turn's digest, the prefix's key and its parent's, bytes, sha on a sequence's last row."""
    pdf = pdf.sort_values(["rep", "depth"], kind="stable", ignore_index=True)
    top = pdf["top"].to_numpy(bool)
    starts = np.flatnonzero(top)
    lengths = np.diff(np.append(starts, len(pdf)))
    # a shard's root is told apart by its whole prefix, a turn below it by itself
    names = np.empty(len(pdf), [("top", "?"), ("a", "<i8"), ("b", "<i8")])
    names["top"] = top
    names["a"] = np.where(top, pdf["k1"], pdf["t1"])
    names["b"] = np.where(top, pdf["k2"], pdf["t2"])
    codes = np.unique(names, return_inverse=True)[1].reshape(-1)
    da, levels = build(starts, lengths, codes)
    size = da.end
    rep, n = pdf["rep"].to_numpy(np.int64)[starts], pdf["n"].to_numpy(np.int64)[starts]
    least = np.full(size, np.iinfo(np.int64).max)
    members, row_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    depth = pdf["depth"].to_numpy(np.int64)
    for i, (live, at) in enumerate(levels):
        np.minimum.at(least, at, rep[live])
        np.add.at(members, at, n[live])
        row_of[at] = starts[live] + i
    nodes = np.flatnonzero(da.check[:size] >= 0)[1:]  # all but state 0
    parent = da.check[nodes]
    children = np.bincount(parent, minlength=size)
    leaves = np.zeros(size, np.int64)
    leaves[nodes] = children[nodes] == 0
    saved = np.zeros(size, np.int64)
    saved[nodes] = (members[nodes] - 1) * pdf["bytes"].to_numpy(np.int64)[row_of[nodes]]
    for live, at in reversed(levels[1:]):
        at = np.unique(at)
        np.add.at(leaves, da.check[at], leaves[at])
        np.add.at(saved, da.check[at], saved[at])
    sha = np.full(size, None, object)
    last = pdf["sha"].to_numpy(object)
    final = starts + lengths - 1
    ends = np.zeros(len(starts), np.int64)
    for live, at in levels:
        ends[live] = at
    sha[ends] = last[final]
    where = row_of[nodes]
    is_top = parent == 0
    up = pd.array(np.where(is_top, 0, least[parent]), "Int64")
    up[is_top] = pd.NA
    return pd.DataFrame({
        "conv_id": least[nodes], "depth": depth[where], "parent_conv_id": up, "n_convs": members[nodes],
        "n_children": children[nodes], "n_leaves": leaves[nodes], "saved_tokens": saved[nodes], "sha": sha[nodes],
        "p1": pdf["p1"].to_numpy(np.int64)[where], "p2": pdf["p2"].to_numpy(np.int64)[where], "top": is_top})


# -- the whole trie -----------------------------------------------------------------
def trie(turns: DataFrame, ids: DataFrame, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS,
         long_list: int = PIECE) -> DataFrame:
    """``turns``: conv_id, pos, t1, t2, bytes; ``ids``: every conv_id, also those without
    turns. One row per node: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    def lane(i: int) -> Column:
        return F.xxhash64(F.lit(i), "pos", "t1", "t2").alias(f"x{i}")

    turns = settled(turns.select("conv_id", "pos", "t1", "t2", "bytes", lane(1), lane(2)))
    seqs = settled(sequences(turns, ids, long_list))
    path = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = (turns.join(seqs, F.col("conv_id") == F.col("rep"))
            .select("rep", "n", "len", (F.col("pos") + 1).alias("depth"), "t1", "t2", "bytes", "x1", "x2",
                    F.bit_xor("x1").over(path).alias("k1"), F.bit_xor("x2").over(path).alias("k2"),
                    F.when(F.col("pos") + 1 == F.col("len"), F.col("sha")).alias("sha"))
            .withColumns({"p1": F.col("k1").bitwiseXOR(F.col("x1")), "p2": F.col("k2").bitwiseXOR(F.col("x2"))})
            .drop("x1", "x2"))
    rows = settled(rows)
    hot = small_side(settled(rows.groupBy(*KEY).agg(F.sum(F.col("len") - F.col("depth") + 1).alias("below"))
                             .where(F.col("below") > shard_rows).select(*KEY, F.lit(True).alias("upper"))))
    marked = rows.join(hot, KEY, "left").withColumn("upper", F.coalesce("upper", F.lit(False)))
    # the first prefix of a sequence that isn't an upper node is its shard's root
    mine = Window.partitionBy("rep")
    marked = settled(marked.withColumn("top_depth", F.count_if("upper").over(mine) + 1)
                     .withColumn("top", F.col("depth") == F.col("top_depth"))
                     .withColumn("shard", F.max(F.when(F.col("top"), F.xxhash64("depth", "k1", "k2"))).over(mine)))
    lower = marked.where("not upper")
    tasks = max(1, -(-lower.count() // task_rows))
    nodes = settled(lower.select("rep", "n", "depth", "top", "t1", "t2", "k1", "k2", "p1", "p2", "bytes", "sha",
                                 F.pmod("shard", F.lit(tasks)).alias("task"))
                    .groupBy("task").applyInPandas(lambda pdf: shard_nodes(pdf), _NODE))
    above = _upper(marked.where("upper"), nodes, seqs)
    known = small_side(settled(above.select(
        (F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("above"))))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")]
    inner = nodes.where("not top").select(*cols)
    heads = (nodes.where("top").drop("parent_conv_id")
             .unionByName(above.withColumn("top", F.lit(True)).drop("k1", "k2"))
             .join(known, ["depth", "p1", "p2"], "left").withColumnRenamed("above", "parent_conv_id").select(*cols))
    return inner.unionByName(heads)


def _upper(rows: DataFrame, nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """The root and the nodes above the shards, merged over all shards."""
    zero = F.lit(0).cast("long")
    own = (rows.groupBy(*KEY).agg(
        F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("bytes").alias("bytes"),
        F.max("sha").alias("sha"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    root = (seqs.agg(F.sum("n").alias("n_convs"), F.min("rep").alias("conv_id"), F.lit(0).cast("long").alias("bytes"),
                     F.max(F.when(F.col("len") == 0, F.col("sha"))).alias("sha"))
            .where("conv_id is not null")
            .select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", "bytes", "sha",
                    zero.alias("p1"), zero.alias("p2")))
    heads = nodes.where("top")
    below = (heads.select("depth", "p1", "p2").unionByName(own.select("depth", "p1", "p2"))
             .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
             .agg(F.count(F.lit(1)).alias("n_children")))
    own = settled(own.unionByName(root).join(below, KEY, "left").withColumn(
        "n_children", F.coalesce("n_children", zero)))
    # what each node adds to the sums of the nodes above it, on its least member's path
    share = (heads.select(F.col("conv_id").alias("rep"), "depth", F.col("n_leaves").alias("leaves"),
                          F.col("saved_tokens").alias("saved"))
             .unionByName(own.select(
                 F.col("conv_id").alias("rep"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"),
                 ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))))
    paths = rows.select("rep", "depth", "k1", "k2", zero.alias("leaves"), zero.alias("saved"), F.lit(True).alias("node"))
    booked = share.select("rep", "depth", zero.alias("k1"), zero.alias("k2"), "leaves", "saved", F.lit(False).alias("node"))
    upward = Window.partitionBy("rep").orderBy(F.col("depth").desc()).rangeBetween(Window.unboundedPreceding, 0)
    sums = (paths.unionByName(booked)
            .select(*KEY, "node", F.sum("leaves").over(upward).alias("leaves"), F.sum("saved").over(upward).alias("saved"))
            .where("node").groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    total = share.agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")).select(
        zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "n_leaves", "saved_tokens")
    return settled(own.join(sums.unionByName(total), KEY).drop("bytes"))


def rebuilt_trie(conversations: DataFrame, **sizes) -> DataFrame:
    return trie(*rebuild(ordered(conversations)), **sizes)
