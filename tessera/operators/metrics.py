"""Classification metrics over a long predictions table
``(model, label, score, prediction)`` — many models in one pass.

* confusion counts, accuracy, precision, recall, F1 — one grouped
  aggregate (0 for an empty denominator);
* exact ROC-AUC with ties: scores are grouped per (model, score) into
  positive/negative counts, negatives are prefix-summed in buckets, and
  ``AUC = Σ pos_s · (neg_below_s + ½ neg_s) / (P · N)``. No down-sampling to
  bins, no single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..session import ensure_checkpoint_dir
from . import prefix


def confusion(preds: DataFrame, group_cols=("model",)) -> DataFrame:
    y, p = F.col("label") == 1, F.col("prediction") == 1
    return preds.groupBy(*group_cols).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"),
        F.count(F.lit(1)).alias("n"))


def scores(conf: DataFrame, digits: int = 6) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = E.safe_ratio(tp, tp + fp)
    recall = E.safe_ratio(tp, tp + fn)
    f1 = E.safe_ratio(2 * tp, 2 * tp + fp + fn)
    return conf.withColumns({
        "accuracy": E.rnd(E.safe_ratio(tp + tn, F.col("n")), digits),
        "precision": E.rnd(precision, digits),
        "recall": E.rnd(recall, digits),
        "f1_score": E.rnd(f1, digits),
    })


def _auc_from_counts(per_score: DataFrame, group_cols: list[str], digits: int) -> DataFrame:
    cum = prefix.running_totals(per_score, ["score"], ["pos", "neg"], partition_cols=group_cols)
    below = F.col("neg_cum") - F.col("neg")
    return (cum.groupBy(*group_cols)
            .agg(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("_u"),
                 F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
            .select(*group_cols, E.rnd(F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")), digits).alias("roc_auc")))


def roc_auc(preds: DataFrame, group_cols=("model",), digits: int = 6) -> DataFrame:
    group_cols = list(group_cols)
    per_score = (preds.groupBy(*group_cols, "score")
                 .agg(F.count_if(F.col("label") == 1).alias("pos"),
                      F.count_if(F.col("label") != 1).alias("neg")))
    return _auc_from_counts(per_score, group_cols, digits)


def evaluate(preds: DataFrame, group_cols=("model",)) -> DataFrame:
    """All five metrics plus the confusion counts, one row per group.

    The predictions are read once: counts per (group, score, prediction)
    are materialised in the shared checkpoint folder (at most one row per
    distinct score and decision), and both the confusion counts and the AUC
    prefix sums are taken from that table.
    """
    group_cols = list(group_cols)
    ensure_checkpoint_dir(preds.sparkSession)
    y = F.col("label") == 1
    cells = (preds.groupBy(*group_cols, "score", "prediction")
             .agg(F.count_if(y).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"),
                  F.count(F.lit(1)).alias("rows"))
             .checkpoint(eager=True))
    p = F.col("prediction") == 1

    def total(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")

    conf = cells.groupBy(*group_cols).agg(
        total(~p, "neg").alias("tn"), total(p, "neg").alias("fp"),
        total(~p, "pos").alias("fn"), total(p, "pos").alias("tp"),
        F.sum("rows").cast("bigint").alias("n"))
    per_score = cells.groupBy(*group_cols, "score").agg(
        F.sum("pos").cast("bigint").alias("pos"), F.sum("neg").cast("bigint").alias("neg"))
    return scores(conf).join(_auc_from_counts(per_score, group_cols, 6), group_cols)
