"""Exact, reproducible stratified train/test split.

Per class, the test set is the rows with the smallest ``md5(seed ‖ id)``.
The test size is ``ceil(test_size · n)``, shared over classes by largest
remainder (ties: smaller class label first).

The k-th smallest hash of each class is found by an exact cut on hash
prefixes: md5 is uniform, so counting rows per (class, 4-hex-digit prefix)
gives 65,536 evenly filled buckets whatever the data or its skew. The
bucket holding the k-th row is narrowed by the next 4 digits until it holds
few rows, which are then ranked exactly. Each step is one aggregate whose
result is bounded by the bucket count, never by the data. The outcome is a
per-class threshold on ``(hash, id)``: assigning rows to a side is a filter
on the original frame, so full rows are never shuffled for the split.

Unlike ``randomSplit``/``sampleBy`` the outcome does not depend on the
partitioning, and md5 text is identical in other engines, which makes the
split checkable by SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S


def split_hash(id_col: str, seed: int) -> Column:
    """A row without an id hashes like one with an empty id."""
    return F.md5(F.concat(F.lit(str(seed)), _id(id_col)))


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def allocate(class_counts: dict, test_size: float) -> dict:
    """Test rows per class: floor shares plus largest remainders."""
    n = sum(class_counts.values())
    n_test = math.ceil(test_size * n)
    base = {c: (n_test * k) // n for c, k in class_counts.items()}
    rem = {c: (n_test * k) % n for c, k in class_counts.items()}
    left = n_test - sum(base.values())
    for c in sorted(class_counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


_DIGITS = 4                  # hex digits per narrowing step (65,536 buckets)
_FINAL_ROWS = 20_000         # rank exactly once a boundary bucket is this small


def _kth(keyed, k: int):
    """(hash, id) of the k-th smallest row (1-based) of ``keyed`` (_h, _id)."""
    prefix, rows, start = "", keyed, 1
    while True:
        rows_here = rows.where(F.substring("_h", 1, len(prefix)) == prefix) if prefix else rows
        n_here = None
        if prefix:
            n_here = rows_here.count()
        if n_here is not None and n_here <= _FINAL_ROWS:
            last = rows_here.orderBy("_h", "_id").offset(k - 1).limit(1).first()
            return last["_h"], last["_id"]
        bucket = F.substring("_h", start, _DIGITS)
        counts = sorted((r["b"], r["n"]) for r in
                        rows_here.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
        before = 0
        for b, n in counts:
            if before + n >= k:
                break
            before += n
        prefix, k, start = prefix + b, k - before, start + _DIGITS
        if start > 32:  # whole hash fixed: rank the (tiny) set of equal hashes
            last = rows.where(F.col("_h") == prefix).orderBy("_h", "_id").offset(k - 1).limit(1).first()
            return last["_h"], last["_id"]


def split_column(df: DataFrame, id_col: str = S.ID_COL, label_col: str = "label",
                 test_size: float = S.TEST_SIZE, seed: int = S.SEED) -> Column:
    """Column expression 'train'/'test' for ``df`` (an id must be unique)."""
    keyed = df.select(_id(id_col).alias("_id"), F.col(label_col).alias("_y"),
                      split_hash(id_col, seed).alias("_h"))
    first = F.substring("_h", 1, _DIGITS)
    level1 = keyed.groupBy("_y", first.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict = {}
    for r in level1:
        counts[r["_y"]] = counts.get(r["_y"], 0) + r["n"]
    if not counts:
        return F.lit("train")
    quota = allocate(counts, test_size)
    h = split_hash(id_col, seed)
    cuts, small = {}, {}
    for c, k in quota.items():
        if k <= 0:
            continue
        buckets = sorted((r["b"], r["n"]) for r in level1 if r["_y"] == c)
        before = 0
        for b, n in buckets:
            if before + n >= k:
                break
            before += n
        if n <= _FINAL_ROWS:
            small[c] = (b, k - before)
        else:
            cuts[c] = _kth(keyed.where(F.col("_y") == F.lit(c)), k)
    if small:
        # every class's boundary bucket (≤ _FINAL_ROWS rows each) ranked in
        # one job, partitioned by class
        in_bucket = None
        for c, (b, _) in small.items():
            cond = (F.col("_y") == F.lit(c)) & (F.substring("_h", 1, _DIGITS) == F.lit(b))
            in_bucket = cond if in_bucket is None else in_bucket | cond
        ranked = keyed.where(in_bucket).withColumn(
            "_r", F.row_number().over(Window.partitionBy("_y").orderBy("_h", "_id")))
        at = None
        for c, (_, r) in small.items():
            cond = (F.col("_y") == F.lit(c)) & (F.col("_r") == F.lit(r))
            at = cond if at is None else at | cond
        for row in ranked.where(at).select("_y", "_h", "_id").collect():
            cuts[row["_y"]] = (row["_h"], row["_id"])
    expr = None
    for c, (ch, cid) in cuts.items():
        in_test = (F.col(label_col) == F.lit(c)) & (
            (h < F.lit(ch)) | ((h == F.lit(ch)) & (_id(id_col) <= F.lit(cid))))
        expr = in_test if expr is None else expr | in_test
    if expr is None:
        return F.lit("train")
    return F.when(expr, F.lit("test")).otherwise(F.lit("train"))


def stratified_split(df: DataFrame, id_col: str = S.ID_COL, label_col: str = "label",
                     test_size: float = S.TEST_SIZE, seed: int = S.SEED) -> DataFrame:
    return df.withColumn("split", split_column(df, id_col, label_col, test_size, seed))
