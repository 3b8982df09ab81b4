"""Mergeable profiles: quantile and distinct sketches per period and feature.

A period's rows are read once and leave one row per feature: counts, least and
largest value, a KLL sketch of the numbers and a HyperLogLog sketch of the values.
Any stretch of periods, features or partitions is then answered from these rows
by merging sketches; the data are never read again. The table is partitioned by period, and
new or corrected periods replace their own partition only.

Bounds: a KLL sketch of size ``k`` has a rank error of about ``2.296 / k ** 0.9723`` (99 %
confidence), a HyperLogLog sketch of ``2 ** lg`` registers a relative standard error of
``1.04 / sqrt(2 ** lg)``; merging keeps both. An answer carries its bound, so a rule on a
sketched figure can say that it holds, that it fails, or that only an exact count can tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.drift import feature_rows

K, LG = 800, 14
#: How many times its error a figure may be off before it counts as wrong.
SAFETY = 3.0


def rank_error(k: int = K) -> float:
    """Normalized rank error of a KLL sketch."""
    return 2.296 / k ** 0.9723


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of a HyperLogLog sketch."""
    return 1.04 / 2 ** (lg / 2)


def sketch_rows(df: DataFrame, period: Column, numeric: list[str], categorical: list[str],
                k: int = K, lg: int = LG) -> DataFrame:
    """period, feature, kind, n, n_null, least, most, quantiles, distincts: one
    aggregate over the unpivoted features. Numbers that aren't numbers (NaN) are null."""
    named = df.select(period.alias("period"), *numeric, *categorical)
    rows = feature_rows(named, numeric, categorical, "period")
    value = F.coalesce("category", F.col("x").cast("string"))
    return rows.groupBy("period", "feature", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("n_null"),
        F.min("x").alias("least"), F.max("x").alias("most"),
        F.when(F.count("x") > 0, F.kll_sketch_agg_double("x", F.lit(k))).alias("quantiles"),
        F.hll_sketch_agg(value, F.lit(lg)).alias("distincts"))


def write_sketches(rows: DataFrame, path: str) -> None:
    """Add periods to the table; a period that is there is replaced."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("period", F.col("period").cast("string"))


def merge(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """Sketches of several periods as one, for each feature (and group of ``by``)."""
    return sketches.groupBy(*by, "feature", "kind").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.when(F.count("quantiles") > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
        F.hll_union_agg("distincts").alias("distincts"))


def estimates(merged: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), k: int = K,
              lg: int = LG) -> DataFrame:
    """The figures of merged sketches: ``distinct`` with its bounds, and for numeric
    features ``q25``, ``q50``, ... whose rank is right to within ``rank_error``."""
    told = F.hll_sketch_estimate("distincts")
    off = SAFETY * distinct_error(lg)
    some = F.col("quantiles").isNotNull()
    return merged.select(
        *[c for c in merged.columns if c not in ("quantiles", "distincts")], told.alias("distinct"),
        F.floor(told / (1 + off)).cast("long").alias("distinct_low"),
        F.ceil(told / (1 - off)).cast("long").alias("distinct_high"),
        *[F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"q{round(100 * q)}")
          for q in quantiles],
        F.when(some, F.lit(SAFETY * rank_error(k))).alias("rank_error"))


def medians(sketches: DataFrame, k: int = K) -> DataFrame:
    """(feature, median) from sketches, for imputation on tables too large for
    the exact one (``preprocess.medians``)."""
    return estimates(merge(sketches.where("kind = 'numeric'")), (0.5,), k).select(
        "feature", F.col("q50").alias("median"))


def distinct_between(sketches: DataFrame, feature: str, least: int, most: int, lg: int = LG) -> DataFrame:
    """The rule "number of distinct values between" on sketches. ``success`` is
    null where the bounds reach over a limit, so that only an exact count can decide."""
    told = estimates(merge(sketches.where(F.col("feature") == feature)), (), lg=lg)
    inside = (F.col("distinct_low") >= least) & (F.col("distinct_high") <= most)
    outside = (F.col("distinct_high") < least) | (F.col("distinct_low") > most)
    return told.select("feature", "distinct", "distinct_low", "distinct_high",
                       F.when(inside, True).when(outside, False).alias("success"))


def audit(df: DataFrame, merged: DataFrame, numeric: list[str], categorical: list[str], k: int = K,
          lg: int = LG) -> DataFrame:
    """Sketched figures beside exact ones of the same rows: whether the exact number of
    distinct values lies within the bounds, and the sketched median's rank within its error."""
    told = estimates(merged, (0.5,), k, lg).select("feature", "distinct_low", "distinct_high", "q50")
    value = F.coalesce("category", F.col("x").cast("string"))
    rows = feature_rows(df, numeric, categorical)
    distinct = rows.where(value.isNotNull()).select("feature", value.alias("value")).distinct().groupBy("feature").agg(
        F.count(F.lit(1)).alias("exact_distinct"))
    # one row per feature on the right
    ranks = (rows.where("x is not null").join(F.broadcast(told.select("feature", "q50")), "feature")
             .groupBy("feature").agg(F.count_if(F.col("x") < F.col("q50")).alias("below"),
                                     F.count_if(F.col("x") <= F.col("q50")).alias("upto"), F.count("x").alias("n_x")))
    off = F.lit(SAFETY * rank_error(k))
    close = ((F.col("below") / F.col("n_x") <= 0.5 + off) & (F.col("upto") / F.col("n_x") >= 0.5 - off))
    counts = merged.select("feature", "kind", "n", "n_null", "least", "most")
    return (counts.join(told, "feature").join(distinct, "feature", "left").join(ranks, "feature", "left")
            .select("feature", "kind", "n", "n_null", "least", "most",
                    F.coalesce("exact_distinct", F.lit(0)).alias("exact_distinct"),
                    (F.coalesce("exact_distinct", F.lit(0)).between(F.col("distinct_low"), F.col("distinct_high")))
                    .alias("distinct_within"), close.alias("median_within")))
