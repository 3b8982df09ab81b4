"""Reference-versus-current drift.

Both tables are tagged and unioned, so each statistic is one aggregate over
one stream:

* numeric features — one global aggregate of conditional moments
  (``avg``/``stddev_samp`` of ``when(side = ...)``): partial aggregation in
  every task, a single tiny final merge, no shuffle of rows;
* categorical features — all columns unpivoted into (feature, value) and
  counted per side in one ``groupBy``; map-side partial aggregation means
  only (feature, value) pairs cross the network, whatever the skew.

The per-feature tables have one row per feature (or per category), so the
joins and windows that follow run on report-sized data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import ensure_checkpoint_dir
from ..functions import expressions as E
from . import prefix
from . import registry as REG

REF, CUR = "reference", "current"


def _present(cols, ref: DataFrame, cur: DataFrame) -> list[str]:
    """Features present on both sides, in the given order."""
    return [c for c in cols if c in ref.columns and c in cur.columns]


def tagged_union(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    return (ref.select(F.lit(REF).alias("_side"), *cols)
            .unionByName(cur.select(F.lit(CUR).alias("_side"), *cols)))


def _num(c: str):
    return E.nan_to_null(F.col(c).cast("double"))


def numeric_drift(ref: DataFrame, cur: DataFrame, features=None,
                  threshold: float = S.DRIFT_THRESHOLD, digits: int | None = 4,
                  with_rows: bool = False) -> DataFrame:
    """Per numeric feature: both means, the reference sample deviation and
    ``|mean_cur − mean_ref| / (std_ref + 1e-9)``; drifted when strictly above
    the threshold. ``with_rows`` adds both sides' row counts, taken in the
    same pass."""
    features = _present(features or S.DRIFT_NUMERICAL, ref, cur)
    u = tagged_union(ref, cur, features)
    is_ref, is_cur = F.col("_side") == REF, F.col("_side") == CUR
    aggs = [F.count_if(is_ref).alias("nr"), F.count_if(is_cur).alias("nc")] if with_rows else []
    for i, c in enumerate(features):
        aggs += [F.avg(F.when(is_ref, _num(c))).alias(f"rm{i}"),
                 F.avg(F.when(is_cur, _num(c))).alias(f"cm{i}"),
                 F.stddev_samp(F.when(is_ref, _num(c))).alias(f"rs{i}")]
    rows = [F.col("nr").alias("reference_rows"), F.col("nc").alias("current_rows")] if with_rows else []
    wide = u.agg(*aggs)
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature"),
                 F.col(f"rm{i}").alias("reference_mean"), F.col(f"cm{i}").alias("current_mean"),
                 F.col(f"rs{i}").alias("reference_std"), *rows)
        for i, c in enumerate(features)])))
    score = F.abs(F.col("current_mean") - F.col("reference_mean")) / (F.col("reference_std") + F.lit(S.DRIFT_EPSILON))
    out = long.withColumn("score_raw", score).withColumn(
        "drifted", F.coalesce(F.col("score_raw") > threshold, F.lit(False)))
    if digits is None:
        return out
    return out.select("ord", "feature", E.rnd("reference_mean", digits).alias("reference_mean"),
                      E.rnd("current_mean", digits).alias("current_mean"),
                      E.rnd("score_raw", digits).alias("drift_score"), "score_raw", "drifted",
                      *(["reference_rows", "current_rows"] if with_rows else []))


def category_counts(ref: DataFrame, cur: DataFrame, features) -> DataFrame:
    """(feature, value, n_ref, n_cur, t_ref, t_cur, share_ref, share_cur) with
    shares over the non-null rows of each side; one aggregate for all
    features."""
    u = tagged_union(ref, cur, features)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"))
                      for c in features])
    counts = (u.select("_side", F.inline(pairs))
              .where(F.col("value").isNotNull())
              .groupBy("feature", "value")
              .agg(F.count_if(F.col("_side") == REF).alias("n_ref"),
                   F.count_if(F.col("_side") == CUR).alias("n_cur")))
    # one row per feature: the totals table is bounded by the column count
    totals = counts.groupBy("feature").agg(F.sum("n_ref").alias("t_ref"), F.sum("n_cur").alias("t_cur"))
    return (counts.join(F.broadcast(totals), "feature")
            .withColumn("share_ref", F.coalesce(F.try_divide(F.col("n_ref"), F.col("t_ref")), F.lit(0.0)))
            .withColumn("share_cur", F.coalesce(F.try_divide(F.col("n_cur"), F.col("t_cur")), F.lit(0.0))))


def categorical_drift(ref: DataFrame, cur: DataFrame, features=None,
                      threshold: float = S.DRIFT_THRESHOLD, digits: int | None = 4) -> DataFrame:
    """Total variation distance ``½ Σ |p_ref − p_cur|`` over the union of
    categories (a category absent on one side has share 0)."""
    features = _present(features or S.DRIFT_CATEGORICAL, ref, cur)
    order = F.create_map(*[x for i, c in enumerate(features) for x in (F.lit(c), F.lit(len(S.DRIFT_NUMERICAL) + i))])
    tvd = (category_counts(ref, cur, features)
           .groupBy("feature")
           .agg((F.sum(F.abs(F.col("share_ref") - F.col("share_cur"))) / 2).alias("score_raw")))
    out = tvd.withColumn("ord", order[F.col("feature")]).withColumn(
        "drifted", F.coalesce(F.col("score_raw") > threshold, F.lit(False)))
    if digits is None:
        return out
    return out.select("ord", "feature", E.rnd("score_raw", digits).alias("total_variation_distance"),
                      E.rnd("score_raw", digits).alias("drift_score"), "score_raw", "drifted")


def drift_report(ref: DataFrame, cur: DataFrame, numeric=None, categorical=None,
                 threshold: float = S.DRIFT_THRESHOLD, method: str = "simple_statistical") -> DataFrame:
    """One-row summary: drifted features (numeric then categorical, input
    order), their count, overall score (mean of unrounded feature scores,
    rounded once), flag, method, row counts and threshold."""
    # with numeric features, the row counts ride on the numeric aggregate,
    # which reads every row of both sides anyway
    counted = bool(_present(numeric or S.DRIFT_NUMERICAL, ref, cur))
    no_rows = [F.lit(None).cast("bigint").alias("reference_rows"), F.lit(None).cast("bigint").alias("current_rows")]
    parts = []
    if counted:
        parts.append(numeric_drift(ref, cur, numeric, threshold, with_rows=True).select(
            "ord", "feature", "score_raw", "drifted", "reference_rows", "current_rows"))
    if _present(categorical or S.DRIFT_CATEGORICAL, ref, cur):
        parts.append(categorical_drift(ref, cur, categorical, threshold).select(
            "ord", "feature", "score_raw", "drifted", *no_rows))
    if not parts:  # no feature on both sides: an empty feature list
        parts.append(ref.sparkSession.createDataFrame(
            [], "ord int, feature string, score_raw double, drifted boolean, "
                "reference_rows bigint, current_rows bigint"))
    feats = parts[0]
    for p in parts[1:]:
        feats = feats.unionByName(p)
    drifted_sorted = F.array_sort(F.collect_list(F.when(F.col("drifted"), F.struct("ord", "feature"))))
    summary = feats.agg(
        F.array_join(F.transform(drifted_sorted, lambda s: s["feature"]), ",").alias("drifted_features"),
        F.count_if("drifted").alias("n_drifted_features"),
        F.count(F.lit(1)).alias("n_features"),
        E.rnd(F.coalesce(F.avg("score_raw"), F.lit(0.0)), 4).alias("drift_score"),
        F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("drift_detected"),
        F.max("reference_rows").alias("reference_rows"), F.max("current_rows").alias("current_rows"))
    if counted:
        return summary.select(
            F.lit(method).alias("method"), "drifted_features", "n_drifted_features", "n_features",
            "drift_score", "drift_detected", "reference_rows", "current_rows",
            F.lit(float(threshold)).alias("drift_threshold"))
    summary = summary.drop("reference_rows", "current_rows")
    rows = (tagged_union(ref.select(F.lit(1).alias("_one")), cur.select(F.lit(1).alias("_one")), ["_one"])
            .agg(F.count_if(F.col("_side") == REF).alias("reference_rows"),
                 F.count_if(F.col("_side") == CUR).alias("current_rows")))
    # Two one-row frames side by side: union them and fold with max().
    both = (summary.select(*[F.col(c) for c in summary.columns],
                           F.lit(None).cast("bigint").alias("reference_rows"),
                           F.lit(None).cast("bigint").alias("current_rows"))
            .unionByName(rows.select(*[F.lit(None).cast(summary.schema[c].dataType).alias(c) for c in summary.columns],
                                     "reference_rows", "current_rows")))
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        F.lit(method).alias("method"), "drifted_features", "n_drifted_features", "n_features",
        "drift_score", "drift_detected", "reference_rows", "current_rows",
        F.lit(float(threshold)).alias("drift_threshold"))


def _is_missing(df: DataFrame, c: str):
    number = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    return F.col(c).isNull() | F.isnan(c) if number else F.col(c).isNull()


def rows_with_missing(ref: DataFrame, cur: DataFrame, columns=None) -> DataFrame:
    """Per side: rows, and rows in which any of the columns is missing."""
    columns = [c for c in (columns or ref.columns) if c in cur.columns]
    u = tagged_union(ref, cur, columns)
    any_missing = F.lit(False)
    for c in columns:
        any_missing = any_missing | _is_missing(u, c)
    side = F.when(F.col("_side") == REF, "reference").otherwise("current")
    return u.groupBy(side.alias("side")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_missing).alias("rows_with_missing"))


def missing_values(ref: DataFrame, cur: DataFrame, columns=None) -> DataFrame:
    """Per column: nulls and null share on each side, in one aggregate."""
    columns = [c for c in (columns or ref.columns) if c in cur.columns]
    u = tagged_union(ref, cur, columns)
    is_ref, is_cur = F.col("_side") == REF, F.col("_side") == CUR
    aggs = [F.count_if(is_ref).alias("nr"), F.count_if(is_cur).alias("nc")]
    for i, c in enumerate(columns):
        miss = _is_missing(u, c)
        aggs += [F.count_if(is_ref & miss).alias(f"r{i}"), F.count_if(is_cur & miss).alias(f"c{i}")]
    wide = u.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.col(f"r{i}").alias("reference_nulls"),
                 E.rnd(E.safe_ratio(F.col(f"r{i}"), F.col("nr")), 6).alias("reference_share"),
                 F.col(f"c{i}").alias("current_nulls"),
                 E.rnd(E.safe_ratio(F.col(f"c{i}"), F.col("nc")), 6).alias("current_share"))
        for i, c in enumerate(columns)])))


AUC_LOSS = 0.05  # fixed value: relative loss of ROC-AUC that asks for retraining


def retrain_decision(report: DataFrame, baseline_auc: float | None = None,
                     current_auc: float | None = None) -> DataFrame:
    """Retrain signal from a drift report row and, where both are given, the
    ROC-AUC at training time and now."""
    lost = bool(baseline_auc and current_auc is not None and (baseline_auc - current_auc) / baseline_auc > AUC_LOSS)
    auc = F.lit(f"ROC-AUC fell from {baseline_auc:.4f} to {current_auc:.4f}" if lost else None).cast("string")
    drift = F.when(F.col("drift_detected"), F.concat(F.lit("data drift in: "), F.col("drifted_features")))
    return report.select(
        (F.col("drift_detected") | F.lit(lost)).alias("retrain"),
        F.when(drift.isNull() & auc.isNull(), F.lit("no drift")).otherwise(F.concat_ws("; ", drift, auc))
        .alias("reason"),
        "drift_score", "n_drifted_features")


def auc_history(runs: DataFrame, versions: DataFrame, name: str, metric: str = S.PRIMARY_METRIC) -> DataFrame:
    """One row from the run log: the metric of the serving version's run when it was
    trained (``baseline``), and that of the newest finished run of the same model type
    (``current``); null where there is none."""
    serving = REG.serving_version(versions, name).select(F.col("run_id").alias("serving_run"))
    value = F.col("metrics")[metric]
    # at most one serving version
    tagged = runs.where("status = 'FINISHED'").join(F.broadcast(serving), F.col("run_id") == F.col("serving_run"), "left")
    served = tagged.where("serving_run is not null").agg(
        F.max("model_type").alias("served_type"), F.max(value).alias("baseline"))
    newest = F.max_by(value, F.struct(F.coalesce("start_ts", F.lit("")), "run_id"))
    current = (tagged.join(F.broadcast(served), F.col("model_type") == F.col("served_type"))  # one row
               .agg(newest.alias("current")))
    return served.select("baseline", F.lit(None).cast("double").alias("current")).unionByName(
        current.select(F.lit(None).cast("double").alias("baseline"), "current")).agg(
        F.max("baseline").alias("baseline"), F.max("current").alias("current"))


def retrain_from_runs(report: DataFrame, runs: DataFrame, versions: DataFrame, name: str) -> DataFrame:
    """``retrain_decision`` with both AUC values taken from the run log."""
    told = auc_history(runs, versions, name).first()  # one row
    return retrain_decision(report, told.baseline, told.current)


def distribution_distances(ref: DataFrame, cur: DataFrame, numeric, categorical,
                           n_buckets: int | None = None, test: str = "pvalue") -> DataFrame:
    """``test`` says which statistics decide ``drifted``: ``pvalue`` (KS for
    numeric, chi-square for categorical features, p < 0.05) or ``distance``
    (normed Wasserstein, Jensen-Shannon, > 0.1). All of them are always given.

    Per feature: normed Wasserstein-1 distance and the two-sample KS
    statistic (numeric), Jensen–Shannon distance (categorical, natural log).

    The numeric distances need both empirical CDFs on the merged sorted
    values: counts per (feature, value) are prefix-summed with the bucketed
    running totals, never in a single task.
    """
    if test not in ("pvalue", "distance"):
        raise ValueError(f"unknown test {test!r}")
    by_pvalue = test == "pvalue"
    numeric = _present(numeric, ref, cur)
    categorical = _present(categorical, ref, cur)
    parts = []
    if numeric:
        u = tagged_union(ref, cur, numeric)
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _num(c).alias("value")) for c in numeric])
        counts = (u.select("_side", F.inline(pairs)).where(F.col("value").isNotNull())
                  .groupBy("feature", "value")
                  .agg(F.count_if(F.col("_side") == REF).alias("n_ref"),
                       F.count_if(F.col("_side") == CUR).alias("n_cur")))
        cum = prefix.running_totals(counts, ["value"], ["n_ref", "n_cur"], partition_cols=["feature"],
                                    n_buckets=n_buckets)
        stats = cum.groupBy("feature").agg(F.sum("n_ref").alias("tr"), F.sum("n_cur").alias("tc"))
        # the reference's deviation from its value counts: the input isn't read again
        means = cum.groupBy("feature").agg((F.sum(F.col("value") * F.col("n_ref")) / F.sum("n_ref")).alias("ref_mean"))
        off = F.col("value") - F.col("ref_mean")
        moments = (cum.join(F.broadcast(means), "feature")  # one row per column
                   .groupBy("feature").agg(F.sqrt(F.sum(off * off * F.col("n_ref")) / F.sum("n_ref")).alias("ref_std")))
        # With S = F_ref − F_cur after this value and d = this value's own step,
        # W1 = Σ v·(|S − d| − |S|) (the CDF gap before minus after each value).
        # stats has one row per feature (bounded by the column list)
        j = cum.join(F.broadcast(stats), "feature")
        s = F.col("n_ref_cum") / F.col("tr") - F.col("n_cur_cum") / F.col("tc")
        d = F.col("n_ref") / F.col("tr") - F.col("n_cur") / F.col("tc")
        w = (j.groupBy("feature")
             .agg(F.sum(F.col("value") * (F.abs(s - d) - F.abs(s))).alias("w1"),
                  F.max(F.abs(s)).alias("ks"), F.first("tr").alias("tr"), F.first("tc").alias("tc"))
             .join(moments, "feature"))
        wn = F.col("w1") / F.when(F.col("ref_std") == 0, F.lit(1.0)).otherwise(F.col("ref_std"))
        pv = ks_pvalue(F.col("ks"), F.col("tr"), F.col("tc"))
        parts.append(w.select(
            "feature", F.lit("numeric").alias("kind"),
            E.rnd(wn, 6).alias("wasserstein_normed"),
            E.rnd("ks", 6).alias("ks_statistic"),
            E.rnd(pv, 6).alias("ks_pvalue"),
            F.lit(None).cast("double").alias("jensen_shannon"),
            F.lit(None).cast("double").alias("chi2_statistic"),
            F.lit(None).cast("double").alias("chi2_pvalue"),
            F.lit("ks" if by_pvalue else "wasserstein").alias("test"),
            F.coalesce(pv < KS_ALPHA if by_pvalue else wn > DISTANCE_THRESHOLD, F.lit(False)).alias("drifted")))
    if categorical:
        cc = category_counts(ref, cur, categorical)
        m = (F.col("share_ref") + F.col("share_cur")) / 2
        kl = lambda p: F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0))
        # chi-square of the current counts against the reference proportions
        expected = F.col("n_ref") * F.col("t_cur") / F.col("t_ref")
        term = (F.when(expected > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected)
                .when(F.col("n_cur") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
        js = (cc.groupBy("feature")
              .agg(F.sqrt(F.greatest(F.lit(0.0), (F.sum(kl(F.col("share_ref"))) + F.sum(kl(F.col("share_cur")))) / 2))
                   .alias("js"),
                   F.sum(term).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"),
                   F.first("t_ref").alias("tr"), F.first("t_cur").alias("tc")))
        pchi = chi2_pvalue(F.col("chi2"), F.col("dof"))
        parts.append(js.select("feature", F.lit("categorical").alias("kind"),
                               F.lit(None).cast("double").alias("wasserstein_normed"),
                               F.lit(None).cast("double").alias("ks_statistic"),
                               F.lit(None).cast("double").alias("ks_pvalue"),
                               E.rnd("js", 6).alias("jensen_shannon"),
                               E.rnd("chi2", 6).alias("chi2_statistic"),
                               E.rnd(pchi, 6).alias("chi2_pvalue"),
                               F.lit("chisquare" if by_pvalue else "jensen_shannon").alias("test"),
                               F.coalesce(pchi < KS_ALPHA if by_pvalue else F.col("js") > DISTANCE_THRESHOLD,
                                          F.lit(False)).alias("drifted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Fixed values of the dataset-drift tests: distance threshold and
# significance level.
DISTANCE_THRESHOLD = 0.1
KS_ALPHA = 0.05


def ks_pvalue(d, n1, n2, terms: int = 100):
    """Asymptotic two-sample Kolmogorov–Smirnov p-value
    ``Q(λ) = 2 Σ_j (−1)^{j−1} exp(−2 j² λ²)``, ``λ = (√e + 0.12 + 0.11/√e)·D``
    with ``e = n1·n2/(n1+n2)``; 1 for λ < 0.3, where the series has not
    converged and Q is 1 to many digits. A higher-order function, so it
    stays a Catalyst expression."""
    en = n1 * n2 / (n1 + n2)
    lam = (F.sqrt(en) + F.lit(0.12) + F.lit(0.11) / F.sqrt(en)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, j: acc + F.lit(2.0) * F.pow(F.lit(-1.0), j - 1) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_exact(steps: int, n1: int, n2: int) -> float:
    """The exact two-sample Kolmogorov-Smirnov p-value ``P(D >= steps / (n1 n2))``
    for samples without ties (with ties it is an upper bound).

    Every order of the merged sample is a lattice path from (0, 0) to (n1, n2), all
    equally likely; D stays below the observed value on paths with ``|i n2 - j n1| < steps``
    everywhere. They are counted row by row, one running sum over the admissible band for
    each i, scaled so that nothing overflows."""
    if steps <= 0:
        return 1.0
    if n1 < n2:
        n1, n2 = n2, n1
    j = np.arange(n2 + 1)
    paths = np.where(j * n1 < steps, 1.0, 0.0)  # i = 0
    scale = 0.0
    for i in range(1, n1 + 1):
        inside = np.abs(i * n2 - j * n1) < steps
        paths = np.where(inside, np.cumsum(np.where(inside, paths, 0.0)), 0.0)
        most = paths.max()
        if most == 0.0:
            return 1.0
        if most > 1e200:
            paths, scale = paths / most, scale + math.log(most)
    total = math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1)
    return min(1.0, max(0.0, 1.0 - math.exp(math.log(paths[n2]) + scale - total))) if paths[n2] > 0 else 1.0


#: Pairs of rows up to which a small-sample test counts paths.
EXACT_PAIRS = 25_000_000


def ks_exact_pvalue(d: Column, n1: Column, n2: Column) -> Column:
    """``ks_exact`` over report rows (one per feature), for samples with at most
    ``EXACT_PAIRS`` pairs; null beyond, where the asymptotic value is good."""
    @F.pandas_udf("double")
    def exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([None if not (x == x and a > 0 and b > 0) or a * b > EXACT_PAIRS
                          else ks_exact(round(x * a * b), int(a), int(b)) for x, a, b in zip(d, n1, n2)], dtype=float)

    return exact(d.cast("double"), n1.cast("long"), n2.cast("long"))


def small_sample_drift(ref: DataFrame, cur: DataFrame, numeric) -> DataFrame:
    """Per numeric feature the two-sample KS statistic, both sample sizes, the exact
    p-value and whether it is below the significance level. Meant for small samples; of
    larger ones (``EXACT_PAIRS``) the p-value is the asymptotic one, and ``method`` says so."""
    numeric = _present(numeric, ref, cur)
    u = tagged_union(ref, cur, numeric)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), _num(c).alias("value")) for c in numeric])
    counts = (u.select("_side", F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("feature", "value")
              .agg(F.count_if(F.col("_side") == REF).alias("n_ref"), F.count_if(F.col("_side") == CUR).alias("n_cur")))
    cum = prefix.running_totals(counts, ["value"], ["n_ref", "n_cur"], partition_cols=["feature"])
    totals = cum.groupBy("feature").agg(F.sum("n_ref").alias("n1"), F.sum("n_cur").alias("n2"))
    # the statistic in whole steps of 1 / (n1 n2); totals have one row per feature
    steps = F.max(F.abs(F.col("n_ref_cum") * F.col("n2") - F.col("n_cur_cum") * F.col("n1")))
    stat = (cum.join(F.broadcast(totals), "feature").groupBy("feature", "n1", "n2").agg(steps.alias("steps"))
            .withColumn("d", F.try_divide(F.col("steps"), F.col("n1") * F.col("n2"))))
    exact = ks_exact_pvalue(F.col("d"), F.col("n1"), F.col("n2"))
    told = stat.withColumn("exact", exact)
    large = (F.col("n1") > 0) & (F.col("n2") > 0) & F.col("exact").isNull()
    p = F.when(large, ks_pvalue(F.col("d"), F.col("n1"), F.col("n2"))).otherwise(F.col("exact"))
    return told.select("feature", "n1", "n2", E.rnd("d", 6).alias("ks_statistic"), E.rnd(p, 6).alias("ks_pvalue"),
                       F.when(large, "asymptotic").otherwise("exact").alias("method"),
                       F.coalesce(p < KS_ALPHA, F.lit(False)).alias("drifted"))


def windowed_drift(df: DataFrame, ts_col: str, numeric: str, categorical: str,
                   window: str = "7 days", threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """Drift of every event-time window against the first window.

    Windows are epoch-aligned tumbling windows. Per window: the numeric
    score ``|mean_w − mean_ref| / (std_ref + 1e-9)`` and the categorical
    total variation distance, written as
    ``½ (1 + Σ_{c in w} (|p_ref(c) − p_w(c)| − p_ref(c)))`` so that only
    categories seen in the window need a row (reference categories missing
    from the window contribute their full share through the leading 1).
    All windows are scored by grouped aggregates — no loop over windows.
    """
    ev = df.select(F.window(F.col(ts_col), window).start.alias("window_start"),
                   _num(numeric).alias("x"), F.col(categorical).cast("string").alias("cat"))
    per_window = ev.groupBy("window_start").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    counts = (ev.where(F.col("cat").isNotNull()).groupBy("window_start", "cat")
              .agg(F.count(F.lit(1)).alias("n")))
    # a row per window (and category): read by several branches below
    ensure_checkpoint_dir(df.sparkSession)
    per_window, counts = per_window.checkpoint(), counts.checkpoint()
    return score_windows(per_window, counts, numeric, categorical, threshold)


def window_moments(counts: DataFrame) -> DataFrame:
    """Per-window mean and sample deviation, merged from the per-category
    counts, means and sums of squared deviations that the windowed stream
    emits (parallel-variance formula: nothing large is subtracted)."""
    some = counts.where(F.col("n_value") > 0)
    means = some.groupBy("window_start").agg(
        F.sum("n_value").alias("nv"), (F.sum(F.col("n_value") * F.col("mean_value")) / F.sum("n_value")).alias("m"))
    gap = F.col("mean_value") - F.col("m")
    return (some.join(means, "window_start")
            .groupBy("window_start").agg(
                F.first("m").alias("m"), F.first("nv").alias("nv"),
                F.sum(F.col("squares") + F.col("n_value") * gap * gap).alias("q"))
            .select("window_start", "m", F.when(F.col("nv") > 1, F.sqrt(F.col("q") / (F.col("nv") - 1))).alias("s")))


def score_windows(per_window: DataFrame, counts: DataFrame, numeric: str, categorical: str,
                  threshold: float = S.DRIFT_THRESHOLD) -> DataFrame:
    """Numeric and categorical drift of every window against the first one,
    from per-window moments (window_start, m, s) and category counts
    (window_start, cat, n)."""
    # The reference window's moments are one row: read them once as scalars.
    ref = per_window.agg(F.min_by(F.struct("window_start", "m", "s"), F.col("window_start")).alias("r")).first()["r"]
    if ref is None:
        return per_window.sparkSession.createDataFrame(
            [], "window_start timestamp, feature string, drift_score double, drifted boolean")
    ws0, ref_m, ref_s = ref["window_start"], ref["m"], ref["s"]
    num = per_window.select(
        "window_start", F.lit(numeric).alias("feature"),
        (F.abs(F.col("m") - F.lit(ref_m)) / (F.lit(ref_s).cast("double") + F.lit(S.DRIFT_EPSILON))).alias("score"))
    per_w = counts.groupBy("window_start").agg(F.sum("n").alias("tot"))
    shares = counts.join(per_w, "window_start").withColumn("p", F.col("n") / F.col("tot")).drop("tot")
    ref_shares = shares.where(F.col("window_start") == F.lit(ws0)).select("cat", F.col("p").alias("p_ref"))
    cat = (shares.join(ref_shares, "cat", "left")
           .groupBy("window_start")
           .agg(((F.lit(1.0) + F.sum(F.abs(F.coalesce("p_ref", F.lit(0.0)) - F.col("p"))
                                     - F.coalesce("p_ref", F.lit(0.0)))) / 2).alias("score"))
           .select("window_start", F.lit(categorical).alias("feature"), "score"))
    return (num.unionByName(cat)
            .select("window_start", "feature", E.rnd("score", 4).alias("drift_score"),
                    F.coalesce(F.col("score") > threshold, F.lit(False)).alias("drifted")))


def log_gamma_plus_one(a: Column) -> Column:
    """``lnΓ(a + 1)`` for ``a >= 0``: Stirling's series at ``a + 8``, less the logarithms
    of the seven factors between; right to about 15 digits for any ``a``."""
    z = a + 8.0
    z2 = z * z
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - (1.0 / 1680 - 1.0 / 1188 / z2) / z2) / z2) / z2) / z
    stirling = (z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series
    between = F.lit(0.0)
    for i in range(1, 8):
        between = between + F.log(a + float(i))
    return stirling - between


def chi2_pvalue(x, dof):
    """Upper tail of the chi-square distribution, ``Q(a, y)`` with ``a = dof/2``
    and ``y = x/2``, for any statistic and any degrees of freedom.

    Below ``a + 1`` it is one less the power series of the lower tail, above it
    the continued fraction of the upper tail, evaluated backwards. Both
    converge in a few times ``sqrt(a)`` terms there, so their length follows
    ``a``. Higher-order functions, so it stays a Catalyst expression."""
    y, a = x / 2.0, dof / 2.0
    log_gamma = log_gamma_plus_one(a)
    terms = (F.lit(200) + F.floor(F.lit(15) * F.sqrt(a))).cast("int")
    front = -y + a * F.log(y) - log_gamma
    acc0 = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("t"))
    series = F.aggregate(
        F.sequence(F.lit(1), terms), acc0,
        lambda acc, n: F.struct((acc["s"] + acc["t"] * y / (a + n)).alias("s"), (acc["t"] * y / (a + n)).alias("t")),
        lambda acc: acc["s"])
    fraction = F.aggregate(
        F.sequence(terms, F.lit(1), F.lit(-1)), y + 2 * terms + 1 - a,
        lambda acc, i: y + 2 * i - 1 - a - i * (i - a) / acc)
    q = F.when(y < a + 1, F.lit(1.0) - F.exp(front) * series).otherwise(F.exp(front) * a / fraction)
    return (F.when(x.isNull() | dof.isNull(), F.lit(None).cast("double"))
            .when(dof <= 0, F.lit(1.0))
            .when(x <= 0, F.lit(1.0))
            .when(x == float("inf"), F.lit(0.0))  # a category the reference never had
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))))
