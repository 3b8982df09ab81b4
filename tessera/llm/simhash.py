"""SimHash fingerprints and near-duplicate groups by pigeonring filtering.

A fingerprint has 64 bits, each the majority over the hashes of a text's word
shingles. Fingerprints that differ in at most ``max_distance`` (t) bits link.

Search: the 64 bits lie on a ring of m = 4t segments. If two fingerprints
differ in at most t bits, some segment starts a chain in which, for every
length l up to m, the first l segments differ in at most l*t/m bits together
(otherwise the parts cut where the budget breaks would sum to more than t).
The budgets are whole numbers, so the first three segments must agree, and the
chain of seven may hold one difference; that one difference lies in one half of
segments four to seven, so the other half agrees as well. Three segments plus
such a half form the join key (40 of 64 bits for t = 2; 2m keys a fingerprint).
Pairs that share a key then pass the chain's budgets, and only those that do get
the full Hamming check.

A key that more than ``big_bucket`` distinct fingerprints share is not paired
off: its fingerprints are dealt out to all their one-bit variants instead. Two
fingerprints with a common variant are at most two bits apart, and any two bits
apart have one, so for t = 2 linking each variant's few members (65 at most) to
their least loses no group and emits no pairs. For other t big buckets are
paired like the rest.

Equal fingerprints collapse to one row first, so copies, however many, cost one
row. Nothing but counters reaches the driver.

Defined cases: a null or empty text, or one without words, has fingerprint zero
and links like any other; a text of fewer words than a shingle is one shingle of
all its words. Rows with a null doc_id link like any other; a component's id is the
least doc_id in it, null if none of its rows has one.
Repeated rows are repeated in the result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, free_name, settled, small_side
from .components import smallest_reachable

_LANES = np.uint64(0x0101010101010101)
_CHUNK = 1 << 16


def majority_bits(hashes: np.ndarray) -> int:
    """Bits set in over half of the 64-bit ``hashes``. Bit b of every byte is
    counted in eight byte-wide lanes at a time, 255 hashes to a lane."""
    n, counts = len(hashes), np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    for at in range(0, n, 255 * 256):
        part = hashes[at:at + 255 * 256]
        rows = -(-len(part) // 255)
        if rows > 1 and len(part) % 255:
            part = np.concatenate([part, np.zeros(rows * 255 - len(part), np.uint64)])
        part = part.reshape(rows, -1)
        for b in range(8):
            lanes = ((part >> np.uint64(b)) & _LANES).sum(axis=1, dtype=np.uint64)
            counts[b] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    b, byte = np.nonzero(counts * 2 > n)
    return sum(1 << int(x) for x in byte * 8 + b)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """bytes.lower() and bytes.split() know ASCII only: A-Z, and \\x20 \\x09-\\x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(line, 42)], np.uint64)
    else:
        after = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], after[:-1]])[: len(words) - shingle + 1].tolist()
        ends = (after[shingle - 1:] - 1).tolist()
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends)), np.uint64, len(starts))
    return majority_bits(hashes)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return prints(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring(max_distance: int) -> list[tuple[int, list[int], int]]:
    """For each start: bits to rotate, the key masks, the mask of the chain of seven."""
    m = max(4 * max_distance, 4)
    cuts = [64 * i // m for i in range(m + 1)]
    out = []
    for i in range(m):
        ends = [(cuts[(i + n) % m] - cuts[i]) % 64 or 64 for n in range(1, min(m, 7) + 1)]
        low = lambda bits: (1 << bits) - 1
        first = low(ends[2])
        if m < 8:
            out.append((cuts[i], [first], low(ends[-1])))
        else:
            out.append((cuts[i], [low(ends[4]), first | (low(ends[6]) ^ low(ends[4]))], low(ends[6])))
    return out


def _rotated(bits: Column, by: int) -> Column:
    return F.shiftrightunsigned(bits, by).bitwiseOR(F.shiftleft(bits, 64 - by)) if by else bits


def near_links(prints: DataFrame, max_distance: int = 2, big_bucket: int = 256) -> DataFrame:
    """``prints``: distinct fingerprints ``fp`` (long) with an id ``node``.
    Returns links ``a, b`` between nodes; every pair within ``max_distance``
    bits is linked or reachable."""
    if max_distance == 0:
        return prints.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    ring = _ring(max_distance)
    keys = [F.struct(F.lit(2 * s + h).cast("int").alias("part"),
                     _rotated(F.col("fp"), by).bitwiseAND(F.lit(_signed(mask))).alias("bits"))
            for s, (by, masks, _) in enumerate(ring) for h, mask in enumerate(masks)]
    dealt = prints.select("fp", "node", F.explode(F.array(*keys)).alias("k")).select("fp", "node", "k.*")
    shared = dealt.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the few fingerprints that share a key with another one
    met = settled(dealt.join(shared, ["part", "bits"]))
    big = F.col("n") > big_bucket if max_distance == 2 else F.lit(False)
    few = met.where(~big)
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    chain = F.lit(True)
    if max_distance >= 2:
        chain = F.coalesce(*[F.when(F.floor(F.col("part") / 2) == s,
                                    F.bit_count(_rotated(x, by).bitwiseAND(F.lit(_signed(seven)))) <= 1)
                             for s, (by, _, seven) in enumerate(ring)])
    other = few.select("part", "bits", F.col("fp").alias("fp2"), F.col("node").alias("node2"))
    pairs = (few.join(other, ["part", "bits"])
             .where((F.col("fp") < F.col("fp2")) & chain & (F.bit_count(x) <= max_distance))
             .select(F.col("node").alias("a"), F.col("node2").alias("b")))
    variants = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    stars = (met.where(big).select("fp", "node").distinct()
             .select("node", F.explode(variants).alias("variant"))
             .groupBy("variant").agg(F.collect_set("node").alias("nodes"))
             .where(F.size("nodes") > 1)
             .select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2, big_bucket: int = 256) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    with arrow_rows(docs.sparkSession, 1_000):  # bounds what a worker holds of long texts
        prints = settled(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    nodes = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # fingerprints link, whoever holds them; a component is named by its least doc_id
    roots = smallest_reachable(near_links(nodes.select("fp", F.col("fp").alias("node")), max_distance, big_bucket))
    linked = settled(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    alone = nodes.join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    groups = linked.join(named, "root").select("fp", "component_id").unionByName(alone)
    return prints.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the document with the
    smallest doc_id; rows without a doc_id, which can't be named, stay. Rows
    that share a doc_id are one document, of which one row stays."""
    found = settled(near_duplicates(docs, shingle, max_distance).where("doc_id is not null"))
    own = free_name(docs, "id")
    per_id = found.groupBy("doc_id").agg(
        F.max(F.when(F.col("doc_id") == F.col("component_id"), 1).otherwise(0)).alias("stays"),
        F.count(F.lit(1)).alias("rows"))
    named = settled(per_id.where("stays = 0 or rows > 1")).withColumnRenamed("doc_id", own)
    gone = small_side(named.where("stays = 0").select(own))
    left = docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
    repeated = small_side(named.where("stays = 1").select(own))
    if not repeated.count():
        return left
    once = left.join(repeated, F.col("doc_id") == F.col(own), "left_semi").dropDuplicates(["doc_id"])
    return left.join(repeated, F.col("doc_id") == F.col(own), "left_anti").unionByName(once)
