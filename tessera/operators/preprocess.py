"""Preprocessing statistics and transforms, fitted on the training rows.

* median imputation — exact, from per-(feature, value) counts prefix-summed
  in buckets (no value list per feature is ever held by one task);
* mode imputation — ``min_by(value, (−count, value))`` per feature, ties go
  to the smallest value;
* standard scaling with the population deviation (zero deviation → 1);
* one-hot vocabulary in alphabetical order, unknown levels → all zeros.

Fitting produces one small row per feature; applying it is a projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..session import ensure_checkpoint_dir
from . import prefix

NUM_FEATURES = S.NUMERICAL_FEATURES + S.ENGINEERED_FEATURES


def _unpivot(df: DataFrame, cols, cast: str, keep=()) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(cast).alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs))


def medians(df: DataFrame, cols=None) -> DataFrame:
    """(feature, median) — exact, interpolated between the two middle values."""
    cols = cols or NUM_FEATURES
    counts = (_unpivot(df, cols, "double").where(F.col("value").isNotNull() & ~F.isnan("value"))
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    cum = prefix.running_totals(counts, ["value"], ["n"], partition_cols=["feature"])
    totals = cum.groupBy("feature").agg(F.sum("n").alias("total"))
    lo_pos = F.floor((F.col("total") + 1) / 2)
    hi_pos = F.ceil((F.col("total") + 1) / 2)
    # one row per feature (bounded by the column list): broadcast, so the
    # value table is never shuffled by feature into one task per column
    return (cum.join(F.broadcast(totals), "feature")
            .groupBy("feature")
            .agg(((F.min(F.when(F.col("n_cum") >= lo_pos, F.col("value")))
                   + F.min(F.when(F.col("n_cum") >= hi_pos, F.col("value")))) / 2).alias("median")))


def modes(df: DataFrame, cols=None) -> DataFrame:
    """(feature, mode) — most frequent non-null value, smallest on ties."""
    cols = cols or S.CATEGORICAL_FEATURES
    counts = (_unpivot(df, cols, "string").where(F.col("value").isNotNull())
              .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("feature").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))


def moments(df: DataFrame, cols=None, med: dict | None = None) -> dict:
    """Mean and population deviation of the imputed columns (one aggregate,
    one row back to the driver)."""
    cols = cols or NUM_FEATURES
    med = med or {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.coalesce(E.nan_to_null(F.col(c).cast("double")), F.lit(med.get(c)).cast("double"))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def scale_columns(stats: dict, med: dict, prefix_name: str = "numerical__") -> dict:
    out = {}
    for c, (m, s) in stats.items():
        x = F.coalesce(E.nan_to_null(F.col(c).cast("double")), F.lit(med.get(c)).cast("double"))
        sd = 1.0 if not s else s
        out[f"{prefix_name}{c}"] = (x - F.lit(m)) / F.lit(sd)
    return out


def vocabulary(df: DataFrame, cols=None) -> DataFrame:
    """(feature, value, slot, name): sorted distinct levels per feature."""
    cols = cols or S.CATEGORICAL_FEATURES
    levels = _unpivot(df, cols, "string").where(F.col("value").isNotNull()).distinct()
    ranked = prefix.running_totals(levels, ["value"], partition_cols=["feature"])
    return ranked.select("feature", "value", (F.col("_rank") - 1).cast("int").alias("slot"),
                         F.concat(F.lit("categorical__"), F.col("feature"), F.lit("_"), F.col("value")).alias("name"))


# Vocabulary rows copied to every task by a broadcast join (about 100 bytes
# each, so the copy stays near Spark's default broadcast size).
BROADCAST_LEVELS = 100_000


def one_hot_long(df: DataFrame, vocab: DataFrame, id_col: str = S.ID_COL, cols=None,
                 salt_buckets: int = 64) -> DataFrame:
    """(id, feature, name) for each active one-hot slot; unknown levels get
    no row (all zeros). The vocabulary has one row per level.

    One level can hold a large share of all rows (a two-valued column holds
    half), so the join never shuffles the rows by level: the vocabulary is
    materialised, its size checked, and broadcast when it is within
    ``BROADCAST_LEVELS``; a larger vocabulary is replicated over
    ``salt_buckets`` salts and each row goes to the salt of its id hash,
    which spreads a hot level over that many tasks.
    """
    cols = cols or S.CATEGORICAL_FEATURES
    long = _unpivot(df, cols, "string", keep=[id_col])
    ensure_checkpoint_dir(df.sparkSession)
    v = vocab.select("feature", "value", "name").checkpoint(eager=True)
    if v.count() <= BROADCAST_LEVELS:
        joined = long.join(F.broadcast(v), ["feature", "value"])
    else:
        salts = v.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))))
        salted = long.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(salt_buckets)).cast("int"))
        joined = salted.join(salts, ["feature", "value", "_salt"])
    return joined.select(id_col, "feature", "name")


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (k · n_class)`` per class (k = number of classes)."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    tot = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")).first()
    return counts.select(label_col, "n", E.rnd(F.lit(tot["t"]) / (F.lit(tot["k"]) * F.col("n")), 6).alias("weight"))


def feature_metadata(split: DataFrame, num=None, cat=None, label_col: str = "label") -> DataFrame:
    """One row about a split table: the input columns by kind, the output features by
    name in vector order, rows and label share of either part, and how many labels could
    not be mapped (where ``<label>_unmapped`` is there)."""
    num, cat = list(num or NUM_FEATURES), list(cat or S.CATEGORICAL_FEATURES)
    train, test = F.col("split") == "train", F.col("split") == "test"
    label = F.col(label_col).cast("double")
    flag = f"{label_col}_unmapped"
    stats = split.agg(
        F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
        F.avg(F.when(train, label)).alias("train_label_rate"), F.avg(F.when(test, label)).alias("test_label_rate"),
        (F.count_if(flag) if flag in split.columns else F.lit(None).cast("bigint")).alias("labels_unmapped"))
    # names of the vocabulary's levels: bounded by what fits in a feature vector
    levels = vocabulary(split.where("split = 'train'"), cat).select(
        F.array_position(F.array(*map(F.lit, cat)), F.col("feature")).alias("f"), "slot", "name")
    named = levels.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "slot", "name"))), lambda x: x["name"])
                       .alias("levels"))
    text = lambda cols: F.array(*map(F.lit, cols)).cast("array<string>")
    both = stats.withColumn("levels", F.lit(None).cast("array<string>")).unionByName(
        named.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stats.schema.fields], "levels"))
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    outputs = F.concat(text([f"numerical__{c}" for c in num]), "levels")
    return one.select(
        text(num).alias("numerical_features"), text(cat).alias("categorical_features"), outputs.alias("output_features"),
        F.size(outputs).alias("n_output_features"), "train_rows", "test_rows",
        E.rnd("train_label_rate", 6).alias("train_label_rate"), E.rnd("test_label_rate", 6).alias("test_label_rate"),
        "labels_unmapped")
