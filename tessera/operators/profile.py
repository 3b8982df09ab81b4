"""Whole-table profiles: shape, nulls per column, moments (one pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _missing(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    cond = F.col(c).isNull()
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        cond = cond | F.isnan(F.col(c))
    return cond


def null_profile(df: DataFrame, columns=None) -> DataFrame:
    """Long table (column, position, null_count, rows): one aggregate over the
    table, then an unpivot of its single row."""
    columns = columns or df.columns
    wide = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(_missing(df, c)).alias(f"__n{i}") for i, c in enumerate(columns)])
    stacked = F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                 F.col(f"__n{i}").alias("null_count"))
        for i, c in enumerate(columns)]))
    return wide.select(stacked, F.col("__rows").alias("rows"))


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """``null_profile`` with each column's type, as Spark names it."""
    columns = columns or df.columns
    types = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    return null_profile(df, columns).select(
        "position", "column", types[F.col("column")].alias("dtype"), "null_count", "rows")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def moments(df: DataFrame, columns) -> DataFrame:
    """Long table of count, mean, sample stddev, min, max per numeric column,
    all in one aggregate."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                 F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(columns)])))
