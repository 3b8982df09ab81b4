"""Drift queries: reference slice, numeric / categorical drift, report,
retrain signal, missing values, distribution distances, weekly drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..operators import clean as C
from ..operators import drift as D
from ..operators import prefix as P
from ..sources import tables as TB
from . import oracle as O
from .catalog import register
from .q_clean import clean_base

# -- reference slice: first max(1000, n // 5) cleaned rows in id order ----------


def reference_slice_of(clean):
    n = clean.count()
    return P.first_n(clean, S.ID_COL, max(1000, n // 5), total=n)


def shifted(df):
    """Current batch with a deliberate shift: dearer, longer and all on one
    contract, so that several features drift."""
    return df.withColumns({"MonthlyCharges": F.col("MonthlyCharges") + 95.0,
                           "tenure": F.col("tenure") + 48,
                           "Contract": F.lit("One year")})


def _sides(spark, sf, shift=False, columns=None):
    # the cleaned table feeds a count, the rank cut and both drift sides:
    # materialise the columns needed once in the shared checkpoint folder
    clean = clean_base(spark, sf)
    if columns:
        clean = clean.select(S.ID_COL, *columns)
    clean = clean.checkpoint(eager=True)
    ref = reference_slice_of(clean)
    return ref, (shifted(clean) if shift else clean)


_SLICE_CTES = (O.clean_ctes(False) + """,
ref as (select * from clean qualify row_number() over (order by customerID)
        <= greatest(1000, (select count(*) from clean) // 5)),
cur0 as (select * from clean),
cur_shift as (select * replace (MonthlyCharges + 95.0 as MonthlyCharges, tenure + 48 as tenure,
                                'One year' as Contract) from clean)""")


def _num_sql(cur: str) -> str:
    parts = [f"select {i} as ord, '{c}' as feature, (select avg({c}) from ref) as rm, "
             f"(select avg({c}) from {cur}) as cm, (select stddev_samp({c}) from ref) as rs"
             for i, c in enumerate(S.DRIFT_NUMERICAL)]
    return "num as (" + " union all ".join(parts) + "),\nnum_s as (select *, abs(cm - rm) / (rs + 1e-9) as score from num)"


def _cat_sql(cur: str) -> str:
    parts = []
    for c in S.DRIFT_CATEGORICAL:
        parts.append(f"select '{c}' as feature, cast({c} as varchar) as value, 'r' as side from ref")
        parts.append(f"select '{c}' as feature, cast({c} as varchar) as value, 'c' as side from {cur}")
    order = " ".join(f"when '{c}' then {len(S.DRIFT_NUMERICAL) + i}" for i, c in enumerate(S.DRIFT_CATEGORICAL))
    return ("cat as (" + " union all ".join(parts) + "),\n"
            "cat_n as (select feature, value, count_if(side = 'r') as nr, count_if(side = 'c') as nc "
            "from cat where value is not null group by feature, value),\n"
            "cat_p as (select *, coalesce(nr / nullif(sum(nr) over (partition by feature), 0), 0) as pr, "
            "coalesce(nc / nullif(sum(nc) over (partition by feature), 0), 0) as pc from cat_n),\n"
            f"cat_s as (select case feature {order} end as ord, feature, sum(abs(pr - pc)) / 2 as score "
            "from cat_p group by feature)")


def _drift_sql(cur: str, what: str) -> str:
    head = "with " + _SLICE_CTES + ",\n" + _num_sql(cur) + ",\n" + _cat_sql(cur) + "\n"
    if what == "num":
        return head + ("select feature, round(rm, 4) as reference_mean, round(cm, 4) as current_mean, "
                       "round(score, 4) as drift_score, coalesce(score > 0.3, false) as drifted from num_s")
    if what == "cat":
        return head + ("select feature, round(score, 4) as total_variation_distance, round(score, 4) as drift_score, "
                       "coalesce(score > 0.3, false) as drifted from cat_s")
    return head + f"""
, feats as (select ord, feature, score, coalesce(score > 0.3, false) as drifted from num_s
            union all select ord, feature, score, coalesce(score > 0.3, false) from cat_s)
select 'simple_statistical' as method,
       coalesce(string_agg(case when drifted then feature end, ',' order by ord), '') as drifted_features,
       cast(count_if(drifted) as bigint) as n_drifted_features,
       cast(count(*) as bigint) as n_features,
       round(coalesce(avg(score), 0.0), 4) as drift_score,
       coalesce(bool_or(drifted), false) as drift_detected,
       (select count(*) from ref) as reference_rows,
       (select count(*) from {cur}) as current_rows,
       cast(0.3 as double) as drift_threshold
from feats"""


@register("reference_slice", oracle="with " + _SLICE_CTES + "\nselect * from ref")
def reference_slice(spark, sf):
    """First max(1000, n//5) rows in id order: the n-th id is found by an
    exact select over the id column alone, then the table is filtered. The
    cleaned table is read by the count, the select and the filter, so it is
    materialised once in the shared checkpoint folder."""
    return reference_slice_of(clean_base(spark, sf).checkpoint(eager=True))


_NUM_COLS = ["feature", "reference_mean", "current_mean", "drift_score", "drifted"]
_CAT_COLS = ["feature", "total_variation_distance", "drift_score", "drifted"]


@register("drift_numeric", oracle=_drift_sql("cur0", "num"))
def drift_numeric(spark, sf):
    ref, cur = _sides(spark, sf, columns=S.DRIFT_NUMERICAL)
    return D.numeric_drift(ref, cur).select(*_NUM_COLS)


@register("drift_categorical", oracle=_drift_sql("cur0", "cat"))
def drift_categorical(spark, sf):
    ref, cur = _sides(spark, sf, columns=S.DRIFT_CATEGORICAL)
    return D.categorical_drift(ref, cur).select(*_CAT_COLS)


@register("drift_report", oracle=_drift_sql("cur0", "report"))
def drift_report(spark, sf):
    ref, cur = _sides(spark, sf)
    return D.drift_report(ref, cur)


@register("drift_numeric_shifted", oracle=_drift_sql("cur_shift", "num"))
def drift_numeric_shifted(spark, sf):
    ref, cur = _sides(spark, sf, shift=True)
    return D.numeric_drift(ref, cur).select(*_NUM_COLS)


@register("drift_report_shifted", oracle=_drift_sql("cur_shift", "report"))
def drift_report_shifted(spark, sf):
    ref, cur = _sides(spark, sf, shift=True)
    return D.drift_report(ref, cur)


@register("retrain_decision", oracle=f"""
with rep as ({_drift_sql("cur_shift", "report")})
select drift_detected as retrain,
       case when drift_detected then 'data drift in: ' || drifted_features else 'no drift' end as reason,
       drift_score, n_drifted_features from rep""")
def retrain_decision(spark, sf):
    ref, cur = _sides(spark, sf, shift=True)
    return D.retrain_decision(D.drift_report(ref, cur))


_MISSING_COLS = [c for c in S.CUSTOMER_COLUMNS if c != S.ID_COL]


def _coerced_sides_sql() -> str:
    cols = ", ".join(f"{O._to_number(c)} as {c}" if c == "TotalCharges" else c for c in _MISSING_COLS)
    return (f"with r0 as ({TB.oracle_customer_view()}), c0 as ({TB.oracle_dirty_view()}),\n"
            f"r as (select {cols} from r0), c as (select {cols} from c0)\n")


def _missing_sql() -> str:
    rows = []
    for c in _MISSING_COLS:
        rows.append(f"select '{c}' as \"column\", "
                    f"(select count_if({c} is null) from r) as reference_nulls, "
                    f"round(coalesce((select count_if({c} is null) / nullif(count(*), 0) from r), 0), 6) as reference_share, "
                    f"(select count_if({c} is null) from c) as current_nulls, "
                    f"round(coalesce((select count_if({c} is null) / nullif(count(*), 0) from c), 0), 6) as current_share")
    return (_coerced_sides_sql() +
            "select \"column\", cast(reference_nulls as bigint) as reference_nulls, reference_share, "
            "cast(current_nulls as bigint) as current_nulls, current_share from (\n"
            + "\nunion all\n".join(rows) + "\n)")


@register("missing_values_compare", oracle=_missing_sql())
def missing_values_compare(spark, sf):
    """Nulls per column after number coercion: clean view vs dirty feed."""
    coerce = {"TotalCharges": E.to_number("TotalCharges")}
    ref = TB.customers_raw(spark, sf).withColumns(coerce)
    cur = TB.customers_dirty(spark, sf).withColumns(coerce)
    return D.missing_values(ref, cur, _MISSING_COLS)


def _events_sql() -> str:
    return """
with ev as (select time_bucket(interval '7 days', ts, timestamp '1970-01-01') as window_start,
                   value as x, event_type as cat from events),
pw as (select window_start, avg(x) as m, stddev_samp(x) as s from ev group by window_start),
r as (select * from pw order by window_start limit 1),
num as (select window_start, 'value' as feature,
               abs(m - (select m from r)) / ((select s from r) + 1e-9) as score from pw),
cn as (select window_start, cat, count(*) as n from ev where cat is not null group by window_start, cat),
sh as (select *, n / sum(n) over (partition by window_start) as p from cn),
rs as (select cat, p as p_ref from sh where window_start = (select window_start from r)),
allc as (select distinct window_start from sh),
grid as (select a.window_start, rs.cat, rs.p_ref from allc a, rs),
tv as (select coalesce(sh.window_start, grid.window_start) as window_start,
              abs(coalesce(grid.p_ref, 0) - coalesce(sh.p, 0)) as d
       from sh full outer join grid on sh.window_start = grid.window_start and sh.cat = grid.cat),
cat as (select window_start, 'event_type' as feature, sum(d) / 2 as score from tv group by window_start)
select window_start, feature, round(score, 4) as drift_score, coalesce(score > 0.3, false) as drifted
from (select * from num union all select * from cat)"""


@register("drift_by_week_events", oracle=_events_sql())
def drift_by_week_events(spark, sf):
    """Each epoch-aligned 7-day window of ``events`` against the first one."""
    return D.windowed_drift(TB.table(spark, sf, "events"), "ts", "value", "event_type")


# all columns but the id
_DIST_NUM = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"]
_DIST_CAT = [c for c in S.CUSTOMER_COLUMNS if c != S.ID_COL and c not in _DIST_NUM]


def _dist_sql(test: str = "pvalue") -> str:
    num_parts, cat_parts = [], []
    for c in _DIST_NUM:
        num_parts.append(f"select '{c}' as feature, cast({c} as double) as v, 'r' as side from ref "
                         f"union all select '{c}', cast({c} as double), 'c' from cur_shift")
    for c in _DIST_CAT:
        cat_parts.append(f"select '{c}' as feature, cast({c} as varchar) as v, 'r' as side from ref "
                         f"union all select '{c}', cast({c} as varchar), 'c' from cur_shift")
    return ("with " + _SLICE_CTES + ",\n"
            "nu as (" + " union all ".join(num_parts) + "),\n"
            "nc as (select feature, v, count_if(side = 'r') as nr, count_if(side = 'c') as nk "
            "from nu where v is not null group by feature, v),\n"
            "tot as (select feature, sum(nr) as tr, sum(nk) as tk from nc group by feature),\n"
            "cum as (select nc.feature, v, nr, nk, tr, tk, sum(nr) over (partition by nc.feature order by v) / tr "
            "- sum(nk) over (partition by nc.feature order by v) / tk as s, nr / tr - nk / tk as d "
            "from nc join tot on nc.feature = tot.feature),\n"
            "sd as (select feature, stddev_pop(v) as sdv from nu where side = 'r' and v is not null group by feature),\n"
            "w as (select cum.feature, sum(v * (abs(s - d) - abs(s))) as w1, max(abs(s)) as ks, "
            "any_value(tr) as tr, any_value(tk) as tk from cum group by cum.feature),\n"
            "w2 as (select *, tr * tk / (tr + tk) as en from w),\n"
            "w3 as (select *, (sqrt(en) + 0.12 + 0.11 / sqrt(en)) * ks as lam from w2),\n"
            "w4 as (select *, case when lam < 0.3 then 1.0 else least(1.0, greatest(0.0, list_sum(list_transform("
            "range(1, 101), lambda j: 2.0 * pow(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam))))) end as pv from w3),\n"
            "ca as (" + " union all ".join(cat_parts) + "),\n"
            "cn as (select feature, v, count_if(side = 'r') as nr, count_if(side = 'c') as nk "
            "from ca where v is not null group by feature, v),\n"
            "cp as (select *, coalesce(nr / nullif(sum(nr) over (partition by feature), 0), 0) as p, "
            "coalesce(nk / nullif(sum(nk) over (partition by feature), 0), 0) as q from cn),\n"
            "js0 as (select feature, sqrt(greatest(0.0, (sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) "
            "+ sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end)) / 2)) as js from cp group by feature),\n"
            "ct as (select feature, sum(nr) as tr, sum(nk) as tk, count(*) - 1 as dof from cn group by feature),\n"
            "ch as (select cn.feature, any_value(ct.tr) as tr, any_value(ct.tk) as tk, any_value(ct.dof) as dof, "
            "sum(case when nr * ct.tk / ct.tr > 0 then (nk - nr * ct.tk / ct.tr) * (nk - nr * ct.tk / ct.tr) / (nr * ct.tk / ct.tr) "
            "when nk > 0 then cast('inf' as double) else 0.0 end) as chi2 "
            "from cn join ct on cn.feature = ct.feature group by cn.feature),\n"
            "chp as (select *, case when dof <= 0 then 1.0 when chi2 <= 0 then 1.0 when chi2 = cast('inf' as double) then 0.0 "
            "else least(1.0, greatest(0.0, 1.0 - list_sum(list_transform("
            "range(0, cast(chi2 / 2.0 + 15 * sqrt(chi2) + 300 as bigint)), lambda n: "
            "exp(-chi2 / 2.0 + (dof / 2.0 + n) * ln(chi2 / 2.0) - lgamma(dof / 2.0 + n + 1)))))) end as pchi from ch),\n"
            "js as (select js0.feature, js0.js, chp.chi2, chp.pchi, chp.tr, chp.tk from js0 join chp on js0.feature = chp.feature),\n"
            "out as (select w4.feature, 'numeric' as kind, round(w1 / case when sdv = 0 then 1.0 else sdv end, 6) "
            "as wasserstein_normed, round(ks, 6) as ks_statistic, round(pv, 6) as ks_pvalue, "
            "cast(null as double) as jensen_shannon, cast(null as double) as chi2_statistic, "
            "cast(null as double) as chi2_pvalue, "
            + ("'ks' as test, coalesce(pv < 0.05, false) as drifted " if test == "pvalue" else
               "'wasserstein' as test, coalesce(w1 / case when sdv = 0 then 1.0 else sdv end > 0.1, false) as drifted ") +
            "from w4 join sd on w4.feature = sd.feature\n"
            "union all select feature, 'categorical', cast(null as double), cast(null as double), "
            "cast(null as double), round(js, 6), round(chi2, 6), round(pchi, 6), "
            + ("'chisquare', coalesce(pchi < 0.05, false)" if test == "pvalue" else
               "'jensen_shannon', coalesce(js > 0.1, false)") + " from js)\n"
            "select * from out")


@register("dataset_drift_stats", oracle=_dist_sql())
def dataset_drift_stats(spark, sf):
    """Normed Wasserstein and KS (numeric), Jensen–Shannon and chi-square
    (categorical) of all columns but the id, between the reference slice and
    the shifted batch; the p-values decide."""
    ref, cur = _sides(spark, sf, shift=True)
    return D.distribution_distances(ref, cur, _DIST_NUM, _DIST_CAT)


@register("dataset_drift_distances", oracle=_dist_sql("distance"))
def dataset_drift_distances(spark, sf):
    """The same statistics; the distances decide."""
    ref, cur = _sides(spark, sf, shift=True)
    return D.distribution_distances(ref, cur, _DIST_NUM, _DIST_CAT, test="distance")


@register("rows_with_missing", oracle=_coerced_sides_sql() + f"""
select 'reference' as side, count(*) as n_rows,
       count_if({" or ".join(f"{c} is null" for c in _MISSING_COLS)}) as rows_with_missing from r
union all
select 'current', count(*), count_if({" or ".join(f"{c} is null" for c in _MISSING_COLS)}) from c""")
def rows_with_missing(spark, sf):
    """Rows in which any column is missing: clean view and dirty feed."""
    coerce = {"TotalCharges": E.to_number("TotalCharges")}
    return D.rows_with_missing(TB.customers_raw(spark, sf).withColumns(coerce),
                               TB.customers_dirty(spark, sf).withColumns(coerce), _MISSING_COLS)


@register("drift_bands", oracle=f"""
with d as ({_drift_sql("cur_shift", "num")}
union all
select feature, null, null, round(score, 4), coalesce(score > 0.3, false) from cat_s)
select feature, drift_score, drifted,
       case when drift_score < 0.15 then 'low' when drift_score < 0.30 then 'medium' else 'high' end as band
from d""")
def drift_bands(spark, sf):
    """Per-feature drift of the shifted batch, banded and sorted by score."""
    ref, cur = _sides(spark, sf, shift=True)
    num = D.numeric_drift(ref, cur).select("feature", "drift_score", "drifted")
    cat = D.categorical_drift(ref, cur).select("feature", "drift_score", "drifted")
    both = num.unionByName(cat)
    return (both.withColumn("band", E.drift_band("drift_score"))
            .orderBy(F.desc("drift_score"), "feature"))


@register("dataset_drift_summary", oracle=f"""
with d as ({_dist_sql()})
select cast(count(*) as bigint) as n_features, cast(count_if(drifted) as bigint) as n_drifted,
       round(count_if(drifted) / count(*), 6) as drift_share,
       count_if(drifted) / count(*) >= 0.5 as dataset_drift
from d""")
def dataset_drift_summary(spark, sf):
    """Dataset-level flag: share of drifted columns ≥ 0.5."""
    d = dataset_drift_stats(spark, sf)
    share = F.count_if("drifted") / F.count(F.lit(1))
    return d.agg(F.count(F.lit(1)).alias("n_features"), F.count_if("drifted").alias("n_drifted"),
                 E.rnd(share, 6).alias("drift_share"), (share >= 0.5).alias("dataset_drift"))


# -- small samples: exact two-sample test by counting lattice paths ---------------------
_KS_REF, _KS_CUR = "l_orderkey <= 80", "l_orderkey > 80 and l_orderkey <= 200 and l_quantity > 10"
_KS_COLS = ["l_extendedprice", "l_tax"]


@register("drift_small_samples", oracle=f"""
with recursive cells as (
  select 'r' as side, f.feature, f.x from lineitem, lateral (select unnest(['l_extendedprice', 'l_tax']) as feature,
         unnest([l_extendedprice, l_tax]) as x) f where {_KS_REF}
  union all
  select 'c', f.feature, f.x from lineitem, lateral (select unnest(['l_extendedprice', 'l_tax']) as feature,
         unnest([l_extendedprice, l_tax]) as x) f where {_KS_CUR}),
n as (select feature, count_if(side = 'r')::bigint as n1, count_if(side = 'c')::bigint as n2 from cells group by 1),
v as (select feature, x, count_if(side = 'r') as r, count_if(side = 'c') as c from cells group by 1, 2),
cum as (select feature, sum(r) over w as r, sum(c) over w as c from v window w as (partition by feature order by x)),
s as (select feature, n1, n2, max(abs(r * n2 - c * n1))::bigint as steps from cum join n using (feature) group by 1, 2, 3),
paths as (
  select feature, n1, n2, steps, 0 as i, [case when j * n1 < steps then 1.0::double else 0.0::double end for j in range(0, n2 + 1)] as u
  from s
  union all
  select feature, n1, n2, steps, i + 1,
         [case when abs((i + 1) * n2 - j * n1) < steps
               then list_sum([case when abs((i + 1) * n2 - k * n1) < steps then u[k + 1] else 0 end for k in range(0, j + 1)])
               else 0.0::double end for j in range(0, n2 + 1)]
  from paths where i < n1),
p as (select feature, n1, n2, steps / (n1 * n2)::double as d,
             1 - exp(ln(u[n2 + 1]) - (lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1))) as p
      from paths where i = n1)
select feature, n1, n2, round(d, 6) as ks_statistic, round(least(1, greatest(0, p)), 6) as ks_pvalue, 'exact' as method,
       p < 0.05 as drifted from p""")
def drift_small_samples(spark, sf):
    """Order lines of the first orders against dearer ones of the next: samples too
    small for the asymptotic test."""
    li = TB.table(spark, sf, "lineitem")
    return D.small_sample_drift(li.where(_KS_REF), li.where(_KS_CUR), _KS_COLS)


# -- the reference slice in file order ----------------------------------------------------
@register("reference_slice_file_order", oracle=O.with_ctes(O.clean_ctes(True)) + f""",
feed as ({TB.oracle_dirty_view()}),
f as (select {O._strip('customerID')} as customerID, min(load_order) as load_order from feed group by 1)
select f.customerID, f.load_order from f join clean using (customerID)
qualify row_number() over (order by f.load_order) <= greatest(1000, (select count(*) from clean) // 5)""")
def reference_slice_file_order(spark, sf):
    """The first rows of the file that survive cleaning, by their place in the file."""
    clean = C.clean_customers(TB.customers_dirty(spark, sf), order_cols=["load_order"], keep_order=True)
    clean = clean.select(S.ID_COL, "load_order").checkpoint(eager=True)
    n = clean.count()
    return P.first_n(clean, "load_order", max(1000, n // 5), total=n)
