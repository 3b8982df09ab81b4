"""Profiles of the events feed from daily sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sketches as SK
from ..session import scratch_path
from ..sources import tables as TB
from .catalog import register

_NUMERIC, _CATEGORICAL = ["value", "user_id"], ["event_type", "props"]


def _daily(spark, sf):
    """One sketch row per day and feature, stored; each day's rows are read once."""
    path = scratch_path(spark, f"sketches-{uuid.uuid4().hex}")
    day = F.date_format(F.col("ts").cast("timestamp"), "'d'yyyy-MM-dd")
    SK.write_sketches(SK.sketch_rows(TB.table(spark, sf, "events"), day, _NUMERIC, _CATEGORICAL), path)
    return SK.read_sketches(spark, path)


_CELLS = """
cells as (
  select ts, 'value' as feature, 'numeric' as kind, cast(value as double) as x, cast(value as varchar) as v from events
  union all select ts, 'user_id', 'numeric', cast(user_id as double), cast(user_id as varchar) from events
  union all select ts, 'event_type', 'categorical', null, event_type from events
  union all select ts, 'props', 'categorical', null, props from events)"""


@register("sketch_daily", oracle=f"""
with {_CELLS}
select 'd' || strftime(ts, '%Y-%m-%d') as period, feature, kind, count(*) as n, count(*) - count(v) as n_null,
       min(x) as least, max(x) as most, count(x) as sketched
from cells group by 1, 2, 3""")
def sketch_daily(spark, sf):
    """The daily table: counts and extremes, and how many numbers each stored
    quantile sketch has taken in."""
    return _daily(spark, sf).select(
        "period", "feature", "kind", "n", "n_null", "least", "most",
        F.coalesce(F.kll_sketch_get_n_double("quantiles"), F.lit(0)).alias("sketched"))


@register("sketch_merged_audit", oracle=f"""
with {_CELLS}
select feature, kind, count(*) as n, count(*) - count(v) as n_null, min(x) as least, max(x) as most,
       count(distinct v) as exact_distinct, true as distinct_within,
       case when kind = 'numeric' then true end as median_within
from cells group by 1, 2""")
def sketch_merged_audit(spark, sf):
    """All days merged from the stored sketches, held against exact figures."""
    merged = SK.merge(_daily(spark, sf)).checkpoint()
    return SK.audit(TB.table(spark, sf, "events"), merged, _NUMERIC, _CATEGORICAL)
