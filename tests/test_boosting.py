"""Histogram-grown trees against plain ones and Spark's learners."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import boosting as B

RNG = np.random.default_rng(4)
N = 1500
X = np.column_stack([RNG.normal(size=N), RNG.integers(0, 12, N), (RNG.random(N) < 0.03).astype(float),
                     RNG.normal(size=N), np.where(RNG.random(N) < 0.1, np.nan, RNG.random(N))])
P = 1 / (1 + np.exp(-(1.5 * X[:, 0] * (X[:, 1] > 5) + 2 * X[:, 2] - 0.3 + 0.5 * np.nan_to_num(X[:, 4]))))
Y = (RNG.random(N) < P).astype(int)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(
        pd.DataFrame({"i": range(N), "features": X.tolist(), "label": Y, "w": 1.0 + np.arange(N) % 3})).repartition(6).checkpoint()


@pytest.fixture(scope="module")
def rows(frame):
    return B.training_rows(frame, weight="w", key=F.xxhash64("i"))


def auc(y, s):
    order = pd.Series(s).rank().to_numpy()
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def grown_by_hand(bins, g, h, n, depth, l2, min_split, min_leaf, min_hessian):
    """{path: (feature, cut) or value}, splitting rows one by one."""
    out = {}

    def split(path, at):
        total = g[at].sum() ** 2 / (h[at].sum() + l2)
        best = None
        if len(path) < depth and n[at].sum() >= min_split:
            for f in range(bins.shape[1]):
                for c in range(bins[:, f].max()):
                    left, right = at[bins[at, f] <= c], at[bins[at, f] > c]
                    if min(n[left].sum(), n[right].sum()) < max(min_leaf, 1) or min(h[left].sum(), h[right].sum()) < min_hessian:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - total
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, c, left, right)
        if best is None:
            out[path] = -g[at].sum() / (h[at].sum() + l2)
            return
        out[path] = best[1:3]
        split(path + "l", best[3])
        split(path + "r", best[4])

    split("", np.flatnonzero(n > 0))
    return out


def as_paths(tree):
    out, todo = {}, [("", 0)]
    while todo:
        path, i = todo.pop()
        if tree.feature[i] < 0:
            out[path] = pytest.approx(tree.value[i], abs=1e-5)
        else:
            out[path] = (tree.feature[i], tree.cut[i])
            todo += [(path + "l", tree.left[i]), (path + "r", tree.right[i])]
    return out


def in_order(frame, rows):
    """Rows as arrays in order of their number."""
    got = sorted(frame.select("i").withColumn("k", F.xxhash64("i")).collect())
    return np.array([r.k for r in got])


def test_first_boosted_tree_equals_one_grown_by_hand(frame, rows):
    model = B.boost(rows, rounds=1, depth=3, rate=0.5, row_share=0.7, column_share=1.0, max_bins=8, l2=2.0, seed=3)
    keys = in_order(frame, rows)
    bins = B.binned(X, model.edges)
    w = 1.0 + np.arange(N) % 3
    sampled = (B.uniform(keys, 3 * 1_000_003) < 0.7).astype(int)
    want = grown_by_hand(bins, w * (0.5 - Y), w * 0.25, sampled, 3, 2.0, 2, 1, 1.0)
    got = as_paths(model.trees[0])
    assert got == want and len(want) > 6 and 0.65 < sampled.mean() < 0.75


def test_second_tree_follows_the_first_ones_margin(frame, rows):
    model = B.boost(rows, rounds=2, depth=2, rate=0.5, row_share=1.0, column_share=1.0, max_bins=8, seed=3, refresh=1)
    p = model.staged(X, [1])[:, 0]
    w = 1.0 + np.arange(N) % 3
    want = grown_by_hand(B.binned(X, model.edges), w * (p - Y), w * p * (1 - p), np.ones(N, int), 2, 1.0, 2, 1, 1.0)
    assert as_paths(model.trees[1]) == want


def test_trees_do_not_depend_on_partitions_or_refreshes(frame, rows):
    one = B.boost(rows, rounds=5, depth=3, rate=0.3, seed=7)
    other = B.boost(B.training_rows(frame.repartition(2), weight="w", key=F.xxhash64("i")), rounds=5, depth=3, rate=0.3, seed=7,
                    refresh=2)
    assert [(t.feature, t.cut, t.rows) for t in one.trees] == [(t.feature, t.cut, t.rows) for t in other.trees]
    again = B.Ensemble.from_json(one.to_json())
    assert np.array_equal(again.staged(X), one.staged(X))


def test_auc_close_to_sparks_boosting(spark, frame):
    train, test = frame.where("i % 4 <> 0").na.drop(), frame.where("i % 4 = 0")
    model = B.boost(B.training_rows(train, key=F.xxhash64("i")), rounds=25, depth=3, rate=0.2)

    def to_vector(c):
        return array_to_vector(F.transform(c, lambda v: F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v)))

    gbt = GBTClassifier(maxIter=25, maxDepth=3, stepSize=0.2, labelCol="label", featuresCol="v", seed=1).fit(
        train.withColumn("v", to_vector("features")))
    told = {r.i: r.p for r in gbt.transform(test.withColumn("v", to_vector("features")))
            .select("i", vector_to_array("probability")[1].alias("p")).collect()}
    at = np.array(sorted(told))
    ours = {r.i: r.p for r in test.select("i", model.score("features", vector=False).alias("p")).collect()}
    a, b = auc(Y[at], [ours[i] for i in at]), auc(Y[at], [told[i] for i in at])
    assert a > 0.6 and abs(a - b) < 0.05
    assert [ours[i] for i in at] == pytest.approx(model.staged(X[at])[:, -1].tolist())


def test_staged_metrics_equal_figures_by_hand(spark, frame, rows):
    model = B.boost(rows, rounds=6, depth=2, rate=0.4)
    some = B.training_rows(frame.where("i % 5 = 0"))
    got = {(r.data, r["round"], r.metric): r.value for r in B.staged_metrics(model, {"train": rows, "test": some}, every=2).collect()}
    assert set(k[1] for k in got) == {2, 4, 6} and len(got) == 12
    for data, at in (("train", np.arange(N)), ("test", np.arange(0, N, 5))):
        staged = model.staged(X[at])
        for r in (2, 4, 6):
            s, y = staged[:, r - 1], Y[at]
            assert got[data, r, "roc_auc"] == pytest.approx(auc(y, s), abs=2e-6)
            assert got[data, r, "log_loss"] == pytest.approx(-np.mean(np.log(np.where(y == 1, s, 1 - s))))
    assert got["train", 6, "log_loss"] < got["train", 2, "log_loss"] < math.log(2)


def test_forest_keeps_to_its_stop_rules(frame, rows):
    model = B.forest(rows, trees=6, depth=8, min_split=40, min_leaf=7, together=4, max_bins=8)
    assert len(model.trees) == 6 and len({tuple(t.feature) for t in model.trees}) == 6
    for t in model.trees:
        for i, f in enumerate(t.feature):
            if f >= 0:
                assert t.rows[i] >= 40 and t.rows[i] == t.rows[t.left[i]] + t.rows[t.right[i]]
                assert min(t.rows[t.left[i]], t.rows[t.right[i]]) >= 7
            else:
                assert 0 <= t.value[i] <= 1
    plain = B.forest(rows, trees=1, depth=3, min_split=2, min_leaf=1, node_features=5, max_bins=8, seed=9)
    copies = B.poisson_one(in_order(frame, rows), 9 * 1_000_003)
    w = (1.0 + np.arange(N) % 3) * copies
    want = grown_by_hand(B.binned(X, plain.edges), -w * Y, w, copies, 3, 0.0, 2, 1, 0.0)
    assert {p: v for p, v in as_paths(plain.trees[0]).items() if isinstance(v, tuple)}.keys() == {
        p for p, v in want.items() if isinstance(v, tuple)}
    assert auc(Y, model.staged(X)[:, -1]) > 0.7


def test_constant_and_empty_tables(spark):
    same = spark.createDataFrame([([1.0, 2.0], 1)] * 20, "features array<double>, label int")
    model = B.boost(B.training_rows(same), rounds=2, depth=2)
    assert all(t.feature == [-1] for t in model.trees) and model.staged(np.array([[1.0, 2.0]]))[0, -1] > 0.5
    assert B.boost(B.training_rows(same.limit(0)), rounds=2).trees == []
