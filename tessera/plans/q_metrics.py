"""Evaluation queries: confusion matrix, metrics, exact ROC-AUC, leaderboard,
run selection, promotion, serving version, risk bands, metric grades.

Scores come from deterministic scorers over the customer features (and
``n_chars`` for document quality), so every number is reproducible and
SQL-checkable; the trained classifiers are in ``q_models``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..operators import drift as D
from ..operators import metrics as M
from ..operators import registry as R
from ..sources import tables as TB
from . import oracle as O
from . import q_drift as QD
from .catalog import register
from .q_features import labelled

REGISTRY_NAME = "churn-classifier"


def _scorers():
    contract = (F.when(F.col("Contract") == "Month-to-month", F.lit(0.7))
                .when(F.col("Contract") == "One year", F.lit(0.4)).otherwise(F.lit(0.2)))
    return {
        "tenure_rule": F.lit(1.0) / (F.col("tenure").cast("double") + F.lit(1.0)),
        "charges_rule": F.col("MonthlyCharges") / F.lit(120.0),
        "contract_rule": contract,
    }


_SCORERS_SQL = {
    "tenure_rule": "1.0 / (cast(tenure as double) + 1.0)",
    "charges_rule": "MonthlyCharges / 120.0",
    "contract_rule": "case when Contract = 'Month-to-month' then 0.7 when Contract = 'One year' then 0.4 else 0.2 end",
}


def predictions(spark, sf):
    """Long table (customerID, model, label, score, prediction)."""
    df = labelled(spark, sf)
    scores = F.array(*[F.struct(F.lit(m).alias("model"), s.cast("double").alias("score"))
                       for m, s in _scorers().items()])
    out = df.select("customerID", "label", F.inline(scores)).select("customerID", "model", "label", "score")
    return out.withColumn("prediction", E.decision("score").cast("int"))


_PRED_CTES = (O.clean_ctes(False) + ",\n" + O.features_cte() + ",\n"
              "lab as (select *, case when Churn = 'Yes' then 1 else 0 end as label from feat),\n"
              "preds0 as (" + " union all ".join(
                  f"select customerID, '{m}' as model, label, cast({s} as double) as score from lab"
                  for m, s in _SCORERS_SQL.items()) + "),\n"
              "preds as (select *, cast(score >= 0.5 as int) as prediction from preds0)")


def _metrics_sql(src: str = "preds") -> str:
    return f"""conf as (
  select model, cast(count_if(label <> 1 and prediction <> 1) as bigint) as tn,
         cast(count_if(label <> 1 and prediction = 1) as bigint) as fp,
         cast(count_if(label = 1 and prediction <> 1) as bigint) as fn,
         cast(count_if(label = 1 and prediction = 1) as bigint) as tp,
         cast(count(*) as bigint) as n
  from {src} group by model),
sc as (select *, round(coalesce((tp + tn) / nullif(n, 0), 0), 6) as accuracy,
              round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision,
              round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
              round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1_score from conf),
ps as (select model, score, count_if(label = 1) as pos, count_if(label <> 1) as neg from {src} group by model, score),
pc as (select *, sum(neg) over (partition by model order by score rows between unbounded preceding and current row) as neg_cum from ps),
auc as (select model, round(sum(pos * (neg_cum - neg + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0), 6) as roc_auc
        from pc group by model),
ev as (select sc.*, auc.roc_auc from sc join auc on sc.model = auc.model)"""


_EVAL_SQL = "with " + _PRED_CTES + ",\n" + _metrics_sql()


@register("confusion_matrix", oracle=_EVAL_SQL + "\nselect model, tn, fp, fn, tp, n from conf")
def confusion_matrix(spark, sf):
    return M.confusion(predictions(spark, sf))


@register("classification_metrics", oracle=_EVAL_SQL +
          "\nselect model, accuracy, precision, recall, f1_score from sc")
def classification_metrics(spark, sf):
    return M.scores(M.confusion(predictions(spark, sf))).select(
        "model", "accuracy", "precision", "recall", "f1_score")


@register("roc_auc_exact", oracle=_EVAL_SQL + "\nselect model, roc_auc from auc")
def roc_auc_exact(spark, sf):
    return M.roc_auc(predictions(spark, sf))


@register("model_leaderboard", oracle=_EVAL_SQL + "\nselect * from ev")
def model_leaderboard(spark, sf):
    """All metrics for all scorers in one grouped pass (plus the AUC pass)."""
    return M.evaluate(predictions(spark, sf))


_DOC_CTES = """dp0 as (select 'n_chars_rule' as model, l.quality as label,
                  cast(d.n_chars as double) / (cast(d.n_chars as double) + 1000.0) as score
           from labels l join documents d on l.doc_id = d.doc_id),
dp as (select *, cast(score >= 0.5 as int) as prediction from dp0)"""


@register("doc_quality_metrics", oracle="with " + _DOC_CTES + ",\n" + _metrics_sql("dp") + "\nselect * from ev")
def doc_quality_metrics(spark, sf):
    """The same evaluator on a native table: document quality labels scored
    by text length."""
    lab = TB.table(spark, sf, "labels")
    docs = TB.table(spark, sf, "documents").select("doc_id", "n_chars")
    n = F.col("n_chars").cast("double")
    preds = lab.join(docs, "doc_id").select(
        F.lit("n_chars_rule").alias("model"), F.col("quality").alias("label"),
        (n / (n + F.lit(1000.0))).alias("score"))
    return M.evaluate(preds.withColumn("prediction", E.decision("score").cast("int")))


def runs_table(spark, sf):
    return R.runs_from_metrics(M.evaluate(predictions(spark, sf)))


_RUNS_CTES = (_EVAL_SQL + """,
runs as (select md5(model) as run_id, model as model_type, roc_auc, accuracy, precision, recall, f1_score from ev),
best as (select * from runs order by roc_auc desc nulls last, run_id limit 1),
v0 as (select run_id, cast(row_number() over (order by run_id) as int) as version from runs),
v1 as (select '""" + REGISTRY_NAME + """' as name, version,
              case when version = (select max(version) from v0) then 'Production' else 'Archived' end as stage,
              run_id, cast(null as varchar) as description from v0),
v2 as (select name, version, case when stage = 'Production' then 'Archived' else stage end as stage,
              run_id, description from v1
       union all
       select '""" + REGISTRY_NAME + """', cast((select max(version) from v1) + 1 as int), 'Production', run_id,
              'Best performing ' || model_type || ' model selected by ROC-AUC.' from best),
serving as (select * from v2 where name = '""" + REGISTRY_NAME + """'
            order by (stage = 'Production') desc, version desc limit 1)""")


@register("best_run", oracle=_RUNS_CTES + "\nselect run_id, model_type, roc_auc from best")
def best_run(spark, sf):
    return R.best_run(runs_table(spark, sf))


def _promoted(spark, sf):
    # the run log is read by the version ranking, its count, the best-run
    # pick and the metrics lookup: write it once to the shared checkpoint
    # folder, as a tracking store would hold it, instead of re-deriving
    # predictions and metrics for every read
    runs = runs_table(spark, sf).checkpoint(eager=True)
    versions = R.initial_versions(runs, REGISTRY_NAME)
    return runs, R.promote(versions, R.best_run(runs), REGISTRY_NAME)


@register("promote_version", oracle=_RUNS_CTES + "\nselect * from v2")
def promote_version(spark, sf):
    """Register the best run as a new Production version; archive the old."""
    return _promoted(spark, sf)[1]


@register("serving_version", oracle=_RUNS_CTES + """
select s.name, s.version, s.stage, s.run_id, r.model_type, r.roc_auc, r.accuracy, r.precision, r.recall, r.f1_score
from serving s left join runs r on s.run_id = r.run_id""")
def serving_version(spark, sf):
    """Newest Production version (else newest) with its run's metrics."""
    runs, versions = _promoted(spark, sf)
    pm = R.production_metrics(R.serving_version(versions, REGISTRY_NAME), runs)
    return pm.select("name", "version", "stage", "run_id", "model_type",
                     *[F.col("metrics")[m].alias(m) for m in
                       ["roc_auc", "accuracy", "precision", "recall", "f1_score"]])


@register("risk_bands", oracle="with " + _PRED_CTES + """
select customerID, round(score, 6) as churn_probability, score >= 0.5 as churn_prediction,
       case when score < 0.30 then 'Low' when score < 0.60 then 'Medium' else 'High' end as risk_level
from preds where model = 'charges_rule'""")
def risk_bands(spark, sf):
    p = predictions(spark, sf).where(F.col("model") == "charges_rule")
    return p.select("customerID", E.rnd("score", 6).alias("churn_probability"),
                    E.decision("score").alias("churn_prediction"), E.risk_band("score").alias("risk_level"))


def _grades_sql() -> str:
    cases = " ".join(f"when metric = '{m}' then case when value >= {g} then 'Good' when value >= {f} then 'Fair' else 'Poor' end"
                     for m, (g, f) in S.METRIC_GRADES.items())
    parts = [f"select '{m}' as metric, {m} as value from sv" for m in ["roc_auc", "accuracy", "precision", "recall", "f1_score"]]
    return (_RUNS_CTES + ",\nsv as (select r.* from serving s join runs r on s.run_id = r.run_id),\n"
            "mv as (" + " union all ".join(parts) + ")\n"
            f"select metric, value, case {cases} else '—' end as grade, "
            "case when value <= 1 then printf('%.2f%%', round(value * 100, 2) + 0.0) else printf('%.4f', round(value, 4) + 0.0) end as display "
            "from mv")


@register("metric_grades", oracle=_grades_sql())
def metric_grades(spark, sf):
    """Dashboard grading of the serving model's metrics."""
    sv = serving_version(spark, sf)
    names = ["roc_auc", "accuracy", "precision", "recall", "f1_score"]
    long = sv.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
    grade = F.lit("—")
    for m, (good, fair) in reversed(list(S.METRIC_GRADES.items())):
        g = (F.when(F.col("value") >= good, "Good").when(F.col("value") >= fair, "Fair").otherwise("Poor"))
        grade = F.when(F.col("metric") == m, g).otherwise(grade)
    v = F.col("value")
    display = F.when(v <= 1, F.format_string("%.2f%%", F.round(v * 100, 2) + F.lit(0.0))).otherwise(
        F.format_string("%.4f", F.round(v, 4) + F.lit(0.0)))
    return long.select("metric", "value", grade.alias("grade"), display.alias("display"))


@register("top_runs", oracle=_RUNS_CTES + """
select run_id, model_type, roc_auc from runs order by roc_auc desc nulls last, run_id limit 10""")
def top_runs(spark, sf):
    """Finished runs by ROC-AUC, top 10 (the limit is the feature)."""
    return R.best_runs(runs_table(spark, sf), "roc_auc", 10)


# -- retraining from the run log ------------------------------------------------------
# Two months of runs: the scorers on either half of the customers (by a hash of the id).
_PERIODS = ("2024-01", "2024-02")


@register("retrain_from_run_log", oracle=f"""
with rep as ({QD._drift_sql("cur_shift", "report")}),
lg as (select split_part(model, '@', 1) as model_type, split_part(model, '@', 2) as period, model, roc_auc
       from (with {_PRED_CTES},
             halves as (select label, score, prediction, model || '@' || case when substr(md5(customerID), 1, 1) < '8'
                               then '{_PERIODS[0]}' else '{_PERIODS[1]}' end as model from preds),
             {_metrics_sql("halves")} select model, roc_auc from auc)),
served as (select model_type, roc_auc as baseline from lg where period = '{_PERIODS[0]}'
           order by roc_auc desc nulls last, md5(model) limit 1),
told as (select baseline, roc_auc as newest,
                coalesce((baseline - roc_auc) / nullif(baseline, 0) > 0.05, false) as lost
         from served join lg using (model_type) where period = '{_PERIODS[1]}')
select drift_detected or lost as retrain,
       case when drift_detected or lost then concat_ws('; ',
              case when drift_detected then 'data drift in: ' || drifted_features end,
              case when lost then printf('ROC-AUC fell from %.4f to %.4f', baseline, newest) end)
            else 'no drift' end as reason,
       drift_score, n_drifted_features from rep, told""")
def retrain_from_run_log(spark, sf):
    """The retraining signal with both AUC values read from the run log: the
    serving version's run of the first month, the newest run of its model type."""
    half = F.when(F.substring(F.md5("customerID"), 1, 1) < "8", _PERIODS[0]).otherwise(_PERIODS[1])
    preds = predictions(spark, sf).withColumn("model", F.concat("model", F.lit("@"), half))
    runs = R.runs_from_metrics(M.evaluate(preds)).select(
        "run_id", F.substring_index("model_type", "@", 1).alias("model_type"), "status", "metrics",
        F.substring_index("model_type", "@", -1).alias("start_ts")).checkpoint(eager=True)
    none = spark.createDataFrame([], S.MODEL_VERSIONS_SCHEMA)
    versions = R.promote(none, R.best_run(runs.where(F.col("start_ts") == _PERIODS[0])), REGISTRY_NAME)
    return D.retrain_from_runs(D.drift_report(*QD._sides(spark, sf, shift=True)), runs, versions, REGISTRY_NAME)
