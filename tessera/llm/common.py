"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a small table that may be broadcast once they have been counted.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, for a helper column."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While open, Python workers get at most ``rows`` rows a batch. Only for
    jobs that run inside the block; the session's value is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def modest_batches(spark: SparkSession, rows: int = 400) -> None:
    """For results that are computed later: where nobody chose how many rows a
    Python worker gets at a time, make it ``rows`` for this session, so that
    long texts don't pile up in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already settled, narrow) marked for broadcast when its counted
    rows are at most ``limit``; otherwise as it is, for a shuffled join in
    which AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= limit else df


def hash_share(*cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def merge_best(parts: DataFrame, keys: list[str], part: str, best: str, k: int, n_parts: int,
               fan: int = 64) -> DataFrame:
    """Merge sorted arrays ``best`` (smallest first, distinct) into one array
    of the ``k`` smallest per key. ``part`` numbers the pieces from 0 to
    ``n_parts`` - 1; pieces meet in groups of ``fan``, so no task gathers more
    than ``fan`` arrays of ``k`` entries for a key, however many pieces there are."""
    out = parts
    while True:
        last = n_parts <= fan
        by = [F.col(c) for c in keys] + ([] if last else [F.floor(F.col(part) / fan).alias(part)])
        out = out.groupBy(*by).agg(
            F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(best)))), 1, k).alias(best))
        if last:
            return out.select(*keys, best)
        n_parts = -(-n_parts // fan)
