"""Row-level rules: scoring-request validation with quarantine, and the
listing of values outside their allowed sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

# Rules of a scoring request as (name, SQL predicate that marks a violation).
# The same predicate text runs in Spark (``F.expr``) and in the SQL oracle.
# Bounds: SeniorCitizen in [0, 1], tenure >= 0, MonthlyCharges > 0,
# TotalCharges >= 0, gender and Contract in their sets, every field present.


def _request_rules() -> list[tuple[str, str]]:
    g = ", ".join(f"'{v}'" for v in S.GENDER_VALUES)
    k = ", ".join(f"'{v}'" for v in S.CONTRACT_VALUES)
    rules = [
        ("SeniorCitizen_out_of_range", "(SeniorCitizen < 0 or SeniorCitizen > 1)"),
        ("tenure_negative", "tenure < 0"),
        ("MonthlyCharges_not_positive", "(MonthlyCharges <= 0 or isnan(MonthlyCharges))"),
        ("TotalCharges_negative", "(TotalCharges < 0 or isnan(TotalCharges))"),
        ("gender_invalid", f"gender not in ({g})"),
        ("Contract_invalid", f"Contract not in ({k})"),
    ]
    rules += [(f"{f.name}_missing", f"{f.name} is null") for f in S.REQUEST_SCHEMA.fields]
    return rules


def _sql_parts():
    rules = _request_rules()
    flags = [f"coalesce({sql}, false)" for _, sql in rules]
    names = ", ".join(f"case when {fl} then '{name}' end" for (name, _), fl in zip(rules, flags))
    count = " + ".join(f"cast({fl} as int)" for fl in flags)
    return names, count


def apply_request_rules(df: DataFrame) -> DataFrame:
    """Add ``violations`` (comma list of broken rules, in rule order),
    ``n_violations`` and ``is_valid``. Pure projection: no shuffle."""
    names, count = _sql_parts()
    return df.withColumns({
        "violations": F.expr(f"concat_ws(',', {names})"),
        "n_violations": F.expr(count),
    }).withColumn("is_valid", F.col("n_violations") == 0)


def request_rules_sql(src: str) -> str:
    names, count = _sql_parts()
    return (f"select customerID, concat_ws(',', {names}) as violations, ({count}) as n_violations, "
            f"({count}) = 0 as is_valid from {src}")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows) of a frame with rules applied."""
    checked = apply_request_rules(df)
    return checked.where("is_valid"), checked.where("not is_valid")


def listed_values(df: DataFrame, rules) -> DataFrame:
    """(column, value, expected, n) for every non-null value of the columns of
    in-set rules: the whole of what a report prints the first values of."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 F.col(c).cast("string").isin([str(v) for v in vals]).alias("expected"))
        for c, vals in rules])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("column", "value", "expected").agg(F.count(F.lit(1)).alias("n")))


def unexpected_values(df: DataFrame, rules) -> DataFrame:
    """(column, value, n) for every value outside the allowed set of its
    column. All columns are unpivoted into one stream and filtered before
    the single aggregate, so only offending rows are shuffled."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 F.coalesce(~F.col(c).isin(list(vals)), F.lit(False)).alias("bad"))
        for c, vals in rules])
    return (df.select(F.inline(pairs))
            .where("bad")
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n")))


def not_in_table(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str | None = None) -> DataFrame:
    """(column, value, n) for every non-null value of ``column`` that the table of
    allowed values doesn't hold, however many values that is.

    Values are counted first, so a hot value crosses the network once per task; the
    anti-join then meets distinct values on both sides. Null is neither allowed nor unexpected."""
    values = (df.select(F.col(column).alias("value")).where(F.col("value").isNotNull())
              .groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    known = allowed.select(F.col(allowed_column or column).alias("value")).where(F.col("value").isNotNull()).distinct()
    return values.join(known, "value", "left_anti").select(
        F.lit(column).alias("column"), F.col("value").cast("string").alias("value"), "n")


def in_table_rule(df: DataFrame, column: str, allowed: DataFrame, allowed_column: str | None = None) -> DataFrame:
    """The in-set rule against a table of allowed values, as one row: success, the rows
    and the distinct values that are unexpected, and the commonest of them (least first of
    equally common ones)."""
    bad = not_in_table(df, column, allowed, allowed_column)
    first = F.min_by("value", F.struct((-F.col("n")).alias("often"), F.col("value")))
    return bad.agg(F.count(F.lit(1)).alias("unexpected_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("unexpected_rows"),
                   first.alias("commonest")).select(
        F.lit("expect_column_values_to_be_in_table").alias("expectation_type"), F.lit(column).alias("column"),
        (F.col("unexpected_values") == 0).alias("success"), "unexpected_values", "unexpected_rows", "commonest")
