"""Typed cleaning of a raw customer table: coerce, fill, strip, remap,
deduplicate (keep first), cast — plus the cleaning report.

Everything is one narrow projection followed by one aggregate keyed on the
id. It keeps, per id, the smallest row (``min`` over one struct that starts with
the order columns, so each column is carried once); the choice is deterministic
whatever the partitioning. A struct has no fixed width, so Spark aggregates by
sorting: a partial phase sorts each task's rows by id and collapses hot ids before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import expressions as E
from ..session import ensure_checkpoint_dir

_INT_COLS = ["SeniorCitizen", "tenure"]
_DOUBLE_COLS = ["MonthlyCharges", "TotalCharges"]


def _prepared(raw: DataFrame, order_cols: list[str], id_col: str,
              charges_col: str, label_col: str) -> DataFrame:
    """Row-wise steps P1–P4, keeping helper columns for the report."""
    data_cols = [c for c in raw.columns if c not in order_cols]
    string_cols = [f.name for f in raw.schema.fields
                   if isinstance(f.dataType, T.StringType) and f.name in data_cols
                   and f.name != charges_col]
    has_charges = charges_col in data_cols
    charges = E.to_number(charges_col) if has_charges else F.lit(None).cast("double")
    # "+ 0.0" turns a product of -0.0 into 0.0, so both engines print it alike
    fill = (F.col("tenure").cast("double") * F.col("MonthlyCharges").cast("double") + F.lit(0.0)
            if {"tenure", "MonthlyCharges"} <= set(data_cols) else F.lit(None).cast("double"))
    exprs = {}
    for c in data_cols:
        if c == charges_col:
            exprs[c] = F.coalesce(charges, fill)
        elif c in string_cols:
            exprs[c] = E.strip(c)
        else:
            exprs[c] = F.col(c)
    out = raw.select(
        *[e.alias(c) for c, e in exprs.items()],
        (charges.isNull() if has_charges else F.lit(False)).alias("_charges_missing"),
        *order_cols,
    )
    if label_col in out.columns:
        out = out.withColumn(
            label_col, F.when(F.col(label_col).isin("Yes", "1"), "Yes").otherwise("No"))
    return out


def _deduplicated(prepared: DataFrame, data_cols: list[str], order_cols: list[str],
                  id_col: str) -> DataFrame:
    """One row per id: the first by (order_cols, then all values), plus the
    number of copies and of missing charges seen for that id."""
    row = F.struct(*[F.col(c) for c in order_cols], *[F.col(c) for c in data_cols])
    return (prepared.groupBy(id_col)
            .agg(F.min(row).alias("_row"),
                 F.count(F.lit(1)).alias("_copies"),
                 F.count_if(F.col("_charges_missing")).alias("_missing")))


def _final_casts(df: DataFrame, strict: bool) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in _INT_COLS:
            v = F.col(c).cast("int")
            if strict:
                v = F.when(v.isNull(), F.raise_error(F.lit(f"null value in integer column {c}"))).otherwise(v)
            cols.append(v.alias(c))
        elif c in _DOUBLE_COLS:
            cols.append(F.col(c).cast("double").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def clean_customers(raw: DataFrame, order_cols: list[str] | None = None,
                    id_col: str = S.ID_COL, charges_col: str = "TotalCharges",
                    label_col: str = S.TARGET_COL, strict: bool = False,
                    keep_order: bool = False) -> DataFrame:
    """Clean a raw customer table.

    ``order_cols`` name the columns that carry the original row order (for
    example ``load_order``); the first row per id in that order is kept. They
    must be there, and are dropped from the output unless ``keep_order`` is
    set. With no order column the kept row is the smallest by value, which is
    still deterministic.
    """
    order_cols = _order(raw, order_cols)
    data_cols = [c for c in raw.columns if c not in order_cols]
    prepared = _prepared(raw, order_cols, id_col, charges_col, label_col)
    dedup = _deduplicated(prepared, data_cols, order_cols, id_col)
    kept = data_cols + (order_cols if keep_order else [])
    return _final_casts(dedup.select(*[F.col("_row")[c].alias(c) for c in kept]), strict)


def _order(raw: DataFrame, order_cols: list[str] | None) -> list[str]:
    absent = [c for c in order_cols or [] if c not in raw.columns]
    if absent:
        raise ValueError(f"no order column {', '.join(absent)}: pass order_cols=[] for tables without a row order")
    return list(order_cols or [])


def cleaning_report(raw: DataFrame, order_cols: list[str] | None = None,
                    id_col: str = S.ID_COL, charges_col: str = "TotalCharges",
                    label_col: str = S.TARGET_COL) -> DataFrame:
    """One-row report: rows before/after, duplicates removed, charges missing
    before and imputed, label distribution, column count and remaining nulls.

    Computed from the same single aggregate as the cleaning itself, so the
    raw side and the clean side cost one shuffle together.
    """
    order_cols = _order(raw, order_cols)
    data_cols = [c for c in raw.columns if c not in order_cols]
    prepared = _prepared(raw, order_cols, id_col, charges_col, label_col)
    dedup = _deduplicated(prepared, data_cols, order_cols, id_col)
    return dedup.agg(*_report(data_cols, label_col))


def _report(data_cols: list[str], label_col: str) -> list[Column]:
    """The report's columns as aggregates over the deduplicated rows."""
    kept = F.col("_row")
    null_cells = None
    for c in data_cols:
        term = kept[c].isNull().cast("int")
        null_cells = term if null_cells is None else null_cells + term
    return [
        F.sum("_copies").cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.sum("_copies") - F.count(F.lit(1))).cast("bigint").alias("duplicates_removed"),
        F.sum("_missing").cast("bigint").alias("missing_total_charges_before"),
        F.sum("_missing").cast("bigint").alias("missing_total_charges_imputed"),
        F.count_if(kept[label_col] == "Yes").alias("churn_yes"),
        F.count_if(kept[label_col] == "No").alias("churn_no"),
        F.lit(len(data_cols)).alias("n_columns"),
        F.coalesce(F.sum(null_cells), F.lit(0)).cast("bigint").alias("null_cells_after"),
        F.concat_ws(",", *[F.when(F.count_if(kept[c].isNull()) > 0,
                                  F.concat(F.lit(f"{c}="), F.count_if(kept[c].isNull()).cast("string")))
                           for c in data_cols]).alias("nulls_by_column")]


REPORT_SCHEMA = ("rows_before bigint, rows_after bigint, duplicates_removed bigint, missing_total_charges_before bigint, "
                 "missing_total_charges_imputed bigint, churn_yes bigint, churn_no bigint, n_columns int, "
                 "null_cells_after bigint, nulls_by_column string")


def clean_with_report(raw: DataFrame, order_cols: list[str] | None = None, id_col: str = S.ID_COL,
                      charges_col: str = "TotalCharges", label_col: str = S.TARGET_COL, strict: bool = False,
                      keep_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """``clean_customers`` and ``cleaning_report`` from one pass: the deduplicated rows are
    materialised in the shared checkpoint folder, and the report's figures are observed on
    the way.

    The metrics are named ones, read from the plan that was run: an ``Observation`` object would
    make the session keep a manager that can't be sent to executors with a fitted model."""
    order_cols = _order(raw, order_cols)
    spark, data_cols = raw.sparkSession, [c for c in raw.columns if c not in order_cols]
    ensure_checkpoint_dir(spark)
    prepared = _prepared(raw, order_cols, id_col, charges_col, label_col)
    dedup = _deduplicated(prepared, data_cols, order_cols, id_col).observe(
        "cleaning_report", *_report(data_cols, label_col))
    rows = dedup.checkpoint(eager=True)
    seen = dedup._jdf.queryExecution().observedMetrics().apply("cleaning_report")
    report = spark.createDataFrame([tuple(seen.get(i) for i in range(seen.length()))], REPORT_SCHEMA)
    kept = data_cols + (order_cols if keep_order else [])
    return _final_casts(rows.select(*[F.col("_row")[c].alias(c) for c in kept]), strict), report


def check_required_columns(df: DataFrame, required=None) -> None:
    """Raise ``ValueError`` naming the missing columns; extras are allowed."""
    required = required or S.CUSTOMER_COLUMNS
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {len(missing)} required columns: {', '.join(missing)}")


def label_distribution(clean: DataFrame, label_col: str = S.TARGET_COL) -> DataFrame:
    return clean.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
