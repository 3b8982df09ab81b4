"""Sketches per period, merged, against exact figures."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import sketches as SK
from tessera.sources import tables as TB
from tests.conftest import SF_MEDIUM


@pytest.fixture(scope="module")
def numbers(spark):
    """30,000 rows over six periods: skewed numbers, nulls, NaN, a hot value."""
    return spark.range(30_000, numPartitions=7).select(
        F.concat(F.lit("p"), (F.col("id") % 6).cast("string")).alias("p"),
        F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, float("nan"))
        .when(F.col("id") % 3 == 0, 1.0).otherwise(F.pow(F.col("id") / 1000, 2)).alias("x"),
        F.when(F.col("id") % 10 < 9, F.concat(F.lit("k"), (F.col("id") * 7919 % 4000).cast("string"))).alias("c"),
        F.lit(None).cast("double").alias("empty"))


def _stored(df, path, where="true"):
    SK.write_sketches(SK.sketch_rows(df.where(where), F.col("p"), ["x", "empty"], ["c"]), path)
    return SK.read_sketches(df.sparkSession, path)


def test_merged_figures_are_within_their_bounds(numbers, tmp_path):
    stored = _stored(numbers, str(tmp_path / "s"))
    assert stored.count() == 18
    rows = {r.feature: r for r in SK.audit(numbers, SK.merge(stored), ["x", "empty"], ["c"]).collect()}
    x = numbers.where("x is not null and not isnan(x)")
    assert rows["x"].n == 30_000 and rows["x"].n_null == 30_000 - x.count()
    assert rows["x"].least == x.agg(F.min("x")).first()[0] and rows["x"].most == x.agg(F.max("x")).first()[0]
    assert rows["x"].median_within and rows["x"].distinct_within and rows["c"].distinct_within
    assert rows["c"].exact_distinct == numbers.where("c is not null").select("c").distinct().count()
    assert rows["empty"].exact_distinct == 0 and rows["empty"].median_within is None and rows["empty"].least is None


def test_quantiles_of_a_stretch_of_periods(numbers, tmp_path):
    stored = _stored(numbers, str(tmp_path / "s"))
    some = SK.merge(stored.where("period in ('p1', 'p2')"))
    told = {r.feature: r for r in SK.estimates(some).collect()}["x"]
    values = sorted(r.x for r in numbers.where("p in ('p1', 'p2') and x is not null and not isnan(x)").collect())
    for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        below, upto = sum(v < told[name] for v in values), sum(v <= told[name] for v in values)
        assert below / len(values) <= q + told.rank_error and upto / len(values) >= q - told.rank_error


def test_a_period_is_replaced_and_the_others_are_not_read(spark, numbers, tmp_path):
    path = str(tmp_path / "s")
    first = {(r.period, r.feature): r.n for r in _stored(numbers, path).collect()}
    again = numbers.where("p = 'p3'").limit(10)
    stored = _stored(again, path)
    now = {(r.period, r.feature): r.n for r in stored.collect()}
    assert now["p3", "x"] == 10 and {k: v for k, v in now.items() if k[0] != "p3"} == {
        k: v for k, v in first.items() if k[0] != "p3"}
    assert SK.merge(stored).where("feature = 'x'").first().n == 25_010


def test_rule_on_sketched_distinct_counts(numbers, tmp_path):
    stored = _stored(numbers, str(tmp_path / "s"))
    exact = numbers.where("c is not null").select("c").distinct().count()

    def rule(least, most):
        return SK.distinct_between(stored, "c", least, most).first().success

    assert rule(1, 2 * exact) is True and rule(2 * exact, 9 * exact) is False
    assert rule(exact, exact) is None  # too close to call


def test_medians_near_the_exact_ones(spark, tmp_path):
    ev = TB.table(spark, SF_MEDIUM, "events")
    path = str(tmp_path / "s")
    SK.write_sketches(SK.sketch_rows(ev, F.lit("all"), ["value"], []), path)
    told = SK.medians(SK.read_sketches(spark, path)).first().median
    below = ev.agg(F.avg((F.col("value") <= told).cast("double"))).first()[0]
    assert abs(below - 0.5) <= SK.SAFETY * SK.rank_error()
