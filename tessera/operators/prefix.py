"""Global ranks and running sums without a single-task window.

A window with ``orderBy`` but no ``partitionBy`` runs in one task. Here
the rows are range-partitioned into buckets instead (``repartitionByRange``
samples the key distribution, so buckets are balanced even for skewed keys),
per-bucket totals are turned into bucket offsets over a table that has one
row per bucket, and the window runs inside each bucket only.

The bucketed key table is checkpointed to the shared checkpoint folder:
that freezes the bucket assignment (the totals and the rows must see the
same one) and cuts the lineage, so a lost executor does not force a
recomputation of everything upstream.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


_BUCKET_ROWS = 1_000_000    # rows of narrow keys a task ranks


_BROADCAST_OFFSETS = 200_000  # rows of the offset table (buckets x groups) that may be broadcast


def _sizes(df: DataFrame, partition_cols: list[str], n_buckets: int | None) -> tuple[int, int]:
    """Buckets for the counted rows, at least one per shuffle partition, and about
    how many rows the table of bucket offsets has at most."""
    if n_buckets and not partition_cols:
        return n_buckets, n_buckets
    groups = F.approx_count_distinct(F.struct(*partition_cols)) if partition_cols else F.lit(1)
    rows, groups = df.agg(F.count(F.lit(1)), groups).first()
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = n_buckets or max(shuffle, 1, -(-rows // _BUCKET_ROWS))
    return n, n * max(groups, 1)


def running_totals(df: DataFrame, order_cols: list[str], value_cols: list[str] = (),
                   partition_cols: list[str] = (), n_buckets: int | None = None) -> DataFrame:
    """Add ``_rank`` (1-based position within the partition group, in
    ``order_cols`` order) and ``<v>_cum`` (inclusive running sum) for each
    value column.

    ``order_cols`` must order rows totally within a group (add a unique
    tie-breaker). ``partition_cols`` should have few distinct values (for
    example a label); each group is ranked on its own.
    """
    partition_cols, value_cols = list(partition_cols), list(value_cols)
    keys = partition_cols + list(order_cols)
    ensure_checkpoint_dir(df.sparkSession)
    # the range bounds are sampled in one job and the rows written in
    # another: keep the narrow projection so the input is computed once
    narrow = df.select(*keys, *value_cols).persist(StorageLevel.MEMORY_AND_DISK)
    n_buckets, n_offsets = _sizes(narrow, partition_cols, n_buckets)
    ranged = (narrow.repartitionByRange(n_buckets, *keys)
              .withColumn("_bucket", F.spark_partition_id())
              .checkpoint(eager=True))
    narrow.unpersist()
    grp = partition_cols + ["_bucket"]
    totals = ranged.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.sum(v).alias(f"__tot_{v}") for v in value_cols])
    before = Window.partitionBy(*partition_cols).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(
        *grp, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__off_rows"),
        *[F.coalesce(F.sum(f"__tot_{v}").over(before), F.lit(0)).alias(f"__offv_{v}") for v in value_cols])
    inside = Window.partitionBy(*grp).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # one row per bucket and group
    offsets = F.broadcast(offsets) if n_offsets <= _BROADCAST_OFFSETS else offsets
    return (ranged.join(offsets, grp)
            .select(*keys, *value_cols,
                    (F.col("__off_rows") + F.row_number().over(Window.partitionBy(*grp).orderBy(*order_cols))).alias("_rank"),
                    *[(F.col(f"__offv_{v}") + F.sum(v).over(inside)).alias(f"{v}_cum") for v in value_cols]))


_SAMPLE_KEYS = 20_000       # keys sampled to place the two pivots
_WINDOW_ROWS = 200_000      # largest pivot window ranked directly


def _nth_by_pivots(keys: DataFrame, n: int, total: int, rounds: int = 4):
    """Exact n-th key by sampled pivots; ``(key, True)``, or ``(None, False)``
    when the pivots missed.

    A sample of the candidate keys places pivots ``lo``/``hi`` a few standard
    errors on either side of rank ``n``; one aggregate counts the keys below
    ``lo`` and up to ``hi``. When rank ``n`` falls between them and the window
    is small, only the window is ranked; a large window is narrowed the same
    way. The same aggregate tests the sampled key at the estimated rank
    (``count(k < v) < n ≤ count(k ≤ v)`` means ``v`` is the answer), which
    settles a hot key holding any share of the rows without ranking it. The
    sample only decides where to look, the counts make the answer exact.
    """
    cand, k_in, size = keys, n, total
    for _ in range(rounds):
        frac = min(1.0, _SAMPLE_KEYS / max(size, 1))
        sample = sorted(r[0] for r in cand.sample(False, frac, seed=17).limit(4 * _SAMPLE_KEYS).collect())
        if not sample:
            return None, False
        m = len(sample)
        pos = k_in / size * m
        margin = 4.0 * (pos * max(0.0, 1 - k_in / size)) ** 0.5 + 2
        i_lo, i_hi = int(pos - margin) - 1, int(pos + margin)
        lo = sample[i_lo] if i_lo >= 0 else None
        hi = sample[i_hi] if i_hi < m else None
        mid = sample[min(m - 1, int(pos))]
        k = F.col("k")
        below_c = (k < F.lit(lo)) if lo is not None else F.lit(False)
        upto_c = (k <= F.lit(hi)) if hi is not None else F.lit(True)
        cnt = cand.agg(F.count_if(below_c).alias("below"), F.count_if(upto_c).alias("upto"),
                       F.count_if(k < F.lit(mid)).alias("below_mid"),
                       F.count_if(k <= F.lit(mid)).alias("upto_mid")).first()
        if cnt["below_mid"] < k_in <= cnt["upto_mid"]:
            return mid, True  # the sampled key at the estimated rank is it
        below, upto = cnt["below"], cnt["upto"]
        if not (below < k_in <= upto):
            return None, False
        window = cand.where(~below_c & upto_c)
        if upto - below <= _WINDOW_ROWS:
            row = window.orderBy("k").offset(k_in - below - 1).limit(1).first()
            return (row["k"] if row else None), True
        cand, k_in, size = window, k_in - below, upto - below
    return None, False


def nth_key(df: DataFrame, order_col: str, n: int, n_buckets: int | None = None,
            total: int | None = None):
    """Value of ``order_col`` at position ``n`` (1-based) among its non-null
    values in ascending order; None when there are fewer than ``n``.

    Exact. First a sampled-pivot select (a handful of single-stage jobs over
    the key column, nothing proportional to the data on the driver); if the
    pivots miss, the bucketed global rank below. ``total`` (count of non-null
    keys) saves a pass when the caller knows it.
    """
    if n <= 0:
        return None
    keys = df.select(F.col(order_col).alias("k")).where(F.col("k").isNotNull())
    if total is None:
        total = keys.count()
    if n > total:
        return None
    key, found = _nth_by_pivots(keys, n, total)
    if found:
        return key
    ranked = running_totals(keys.withColumnRenamed("k", order_col), [order_col], n_buckets=n_buckets)
    row = ranked.where(F.col("_rank") == n).select(order_col).first()
    return row[0] if row else None


def first_n(df: DataFrame, order_col: str, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` rows with the smallest ``order_col`` (a unique key; rows tied
    with the n-th all stay), as a filter on the original frame: no shuffle of
    full rows."""
    total = df.count() if total is None else total
    if n >= total:
        return df
    cut = nth_key(df, order_col, n, total=total)
    return df.where(F.col(order_col) <= F.lit(cut))
