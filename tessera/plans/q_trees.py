"""Histogram-grown trees: boosting with figures after each round, and a forest whose
nodes keep to the least number of rows (rows-only checks; tests hold both against Spark's
learners and against trees grown by hand)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import boosting as B
from ..operators import models as MD
from .catalog import register
from .q_features import with_split

#: A short run of the reference's settings; ``boost`` itself defaults to its 300 rounds.
ROUNDS, DEPTH, RATE, TREES, FOREST_DEPTH = 12, 4, 0.3, 10, 6


def _vectors(spark, sf):
    """Training and test rows for the learners, weighted, in shared storage."""
    df = with_split(spark, sf)
    train = MD.with_weights(df.where("split = 'train'"))
    prep = MD.fit_preprocessing(train)
    test = df.where("split = 'test'").withColumn("w_pos3", F.lit(1.0)).withColumn("w_balanced", F.lit(1.0))
    keep = ["customerID", "features", "label", "w_pos3", "w_balanced"]
    return tuple(prep.transform(x).select(*keep).checkpoint() for x in (train, test))


def _rows(vectors, weight):
    return B.training_rows(vectors, weight=weight, key=F.xxhash64("customerID"))


@register("boosting_staged_metrics")
def boosting_staged_metrics(spark, sf):
    """Log loss and exact ROC-AUC on the training and test rows after each round."""
    train, test = _vectors(spark, sf)
    model = B.boost(_rows(train, "w_pos3"), rounds=ROUNDS, depth=DEPTH, rate=RATE)
    out = B.staged_metrics(model, {"train": _rows(train, "w_pos3"), "test": _rows(test, None)})
    return out.withColumn("value", E.rnd("value", 6))


@register("forest_nodes")
def forest_nodes(spark, sf):
    """The nodes of a forest with at least 5 rows to split and 2 in a leaf."""
    train, _ = _vectors(spark, sf)
    model = B.forest(_rows(train, "w_balanced"), trees=TREES, depth=FOREST_DEPTH)
    return spark.createDataFrame(
        model.nodes(), "tree int, node int, feature int, edge double, left int, right int, value double, rows long"
    ).withColumn("value", E.rnd("value", 6))
