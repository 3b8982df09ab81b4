"""Feature pipeline, classifiers, run logging and batch scoring (Spark ML).

One ``PipelineModel`` holds imputation, scaling, one-hot encoding and the
classifier, so training and scoring always apply the same transformation
(feature engineering is a plain projection applied before it).

Hyper-parameters follow the reference configuration:

* logistic regression — C = 1, 1000 iterations, balanced class weights;
  Spark averages the loss where the reference sums it, so the penalty is
  ``regParam = 1 / (C · Σw)`` with ``standardization=False``;
* random forest — 200 trees, depth 10, leaf ≥ 2, balanced weights, seed 42;
* gradient-boosted trees — 300 rounds, depth 6, step 0.05, row and feature
  sampling 0.8, positive weight 3.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import (OneHotEncoder, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from . import metrics as M
from . import preprocess as PP

NUM = S.NUMERICAL_FEATURES + S.ENGINEERED_FEATURES
CAT = S.CATEGORICAL_FEATURES

#: Training rows from which they lie sorted by their features.
SORTED_ROWS = 100_000


def fit_preprocessing(train: DataFrame, num=None, cat=None) -> PipelineModel:
    """Fitted preprocessing, one persistable pipeline: exact medians, most
    frequent values, means and population deviations of the training rows
    (``preprocess``) applied as a projection, then levels in alphabetical order
    one-hot encoded. Null levels become the mode, unknown levels all zeros."""
    num, cat = list(num or NUM), list(cat or CAT)
    med = {r["feature"]: r["median"] for r in PP.medians(train, num).collect()}    # one row per column
    mode = {r["feature"]: r["mode"] for r in PP.modes(train, cat).collect()}       # one row per column
    med = {c: med.get(c, 0.0) for c in num}  # a column without values is all zeros
    stats = PP.moments(train, num, med)

    def number(x: float) -> str:
        return f"cast('{float(x)!r}' as double)"

    parts = []
    for c in num:
        x = f"coalesce(nullif(cast(`{c}` as double), cast('NaN' as double)), {number(med[c])})"
        mean, deviation = stats[c]
        parts.append(f"({x} - {number(mean or 0.0)}) / {number(deviation or 1.0)} as `numerical__{c}`")
    for c in cat:
        filled = E.sql_str(mode[c]) if mode.get(c) is not None else "''"
        parts.append(f"coalesce(cast(`{c}` as string), {filled}) as `categorical__{c}`")
    project = SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")
    stages = [
        project,
        VectorAssembler(inputCols=[f"numerical__{c}" for c in num], outputCol="num_scaled"),
        # unknown levels get an index of their own, the last, which the encoder drops
        StringIndexer(inputCols=[f"categorical__{c}" for c in cat], outputCols=[f"{c}__idx" for c in cat],
                      handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}__idx" for c in cat], outputCols=[f"{c}__ohe" for c in cat], dropLast=True),
        VectorAssembler(inputCols=["num_scaled"] + [f"{c}__ohe" for c in cat], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def with_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights ``n / (2 · n_class)`` and the boosting weight (3 for
    positives), from one aggregate of class counts."""
    counts = {r[label_col]: r["n"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    w = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(n / (2.0 * v)))])
    return df.withColumns({"w_balanced": w[F.col(label_col)],
                           "w_pos3": F.when(F.col(label_col) == 1, F.lit(3.0)).otherwise(F.lit(1.0))})


def model_configs(total_weight: float, seed: int = S.SEED) -> list[dict]:
    return [
        {"name": "LogisticRegression",
         "estimator": LogisticRegression(maxIter=1000, regParam=1.0 / total_weight, elasticNetParam=0.0,
                                         standardization=False, weightCol="w_balanced", labelCol="label"),
         "params": {"C": "1.0", "max_iter": "1000", "solver": "lbfgs", "class_weight": "balanced"}},
        {"name": "RandomForest",
         # node ids are kept, so no row walks every tree from its root at every depth; no
         # checkpoint of them in ten passes
         "estimator": RandomForestClassifier(numTrees=200, maxDepth=10, minInstancesPerNode=2,
                                             weightCol="w_balanced", labelCol="label", seed=seed,
                                             cacheNodeIds=True, checkpointInterval=-1),
         "params": {"n_estimators": "200", "max_depth": "10", "min_samples_leaf": "2",
                    "class_weight": "balanced"}},
        {"name": "GradientBoosting",
         "estimator": GBTClassifier(maxIter=300, maxDepth=6, stepSize=0.05, subsamplingRate=0.8,
                                    featureSubsetStrategy="0.8", weightCol="w_pos3", labelCol="label",
                                    seed=seed),
         "params": {"n_estimators": "300", "max_depth": "6", "learning_rate": "0.05",
                    "subsample": "0.8", "colsample": "0.8", "scale_pos_weight": "3"}},
    ]


def training_vectors(prep: PipelineModel, train: DataFrame, n_rows: int | None = None) -> DataFrame:
    """What a learner reads, once: features, label and weights, persisted in
    partitions of a size that suits hundreds of passes. Many rows lie sorted by their
    features within a partition: neighbours then meet in the same nodes of a tree, whose
    counts are still in the processor's cache. The caller unpersists it."""
    spark = train.sparkSession
    n_rows = train.count() if n_rows is None else n_rows
    columns = [c for c in ("features", "label", "w_balanced", "w_pos3") if c == "features" or c in train.columns]
    vectors = prep.transform(train).select(*columns).repartition(
        training_partitions(n_rows, spark.sparkContext.defaultParallelism))
    if n_rows >= SORTED_ROWS:
        vectors = vectors.sortWithinPartitions(vector_to_array("features"))
    return vectors.persist()


def fit(train: DataFrame, estimator, num=None, cat=None) -> PipelineModel:
    prep = fit_preprocessing(train, num, cat)
    vectors = training_vectors(prep, train)
    try:
        return PipelineModel(stages=[*prep.stages, estimator.fit(vectors)])
    finally:
        vectors.unpersist()


def probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("churn_probability", vector_to_array("probability")[1])


def feature_names(model: PipelineModel) -> list[str]:
    """Output feature names in vector order: ``numerical__<col>`` then
    ``categorical__<col>_<level>`` for each known level (alphabetical)."""
    numbers = next(s for s in model.stages if isinstance(s, VectorAssembler))
    levels = next(s for s in model.stages if hasattr(s, "labelsArray"))
    return [*numbers.getInputCols(),
            *[f"{c}_{v}" for c, labels in zip(levels.getInputCols(), levels.labelsArray) for v in labels]]


def importances(model: PipelineModel) -> list[float]:
    clf = model.stages[-1]
    if hasattr(clf, "featureImportances"):
        return list(clf.featureImportances.toArray())
    if hasattr(clf, "coefficients"):
        return [abs(x) for x in clf.coefficients.toArray()]
    return []


def top_features(spark, model: PipelineModel, k: int = 20) -> DataFrame:
    """Top-k features by importance (ties by name), prefixes removed."""
    imp = importances(model)
    names = feature_names(model)
    if len(names) != len(imp):
        raise ValueError(f"{len(names)} feature names for {len(imp)} importances")
    rows = [(n.replace("numerical__", "").replace("categorical__", ""), float(v)) for n, v in zip(names, imp)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(k)


def run_id_for(name: str, seed: int, data_tag: str) -> str:
    return hashlib.md5(f"{name}|{seed}|{data_tag}".encode()).hexdigest()


def training_partitions(n_rows: int, cores: int, rows_per_partition: int = 250_000,
                        least_rows: int = 2_000) -> int:
    """Partitions for cached training vectors: at most about 250k rows each,
    and otherwise as many as there are cores, as long as each has enough rows
    to outweigh a task's overhead in hundreds of passes. More than the cores are
    a multiple of them, so that no core idles in the last wave of a pass."""
    parts = max(1, -(-n_rows // rows_per_partition), min(cores, n_rows // least_rows))
    return -(-parts // cores) * cores if parts > cores else parts


def train_and_log(train: DataFrame, test: DataFrame, data_tag: str, model_names=None):
    """Fit every configuration (driver loop over a handful of models), score
    the test rows, compute the five metrics with the exact evaluator and
    return (fitted models by name, runs DataFrame). Any failure aborts.

    The preprocessing pipeline is fitted once; the assembled training
    vectors are cached (and released at the end) for all classifiers."""
    spark = train.sparkSession
    weighted = with_weights(train)
    n_rows = weighted.count()
    prep = fit_preprocessing(weighted)
    vectors = training_vectors(prep, weighted, n_rows)
    total_w = vectors.agg(F.sum("w_balanced")).first()[0]
    counts = test.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("rate")).first()
    train_rate = weighted.agg(F.avg(F.col("label").cast("double"))).first()[0]
    about = {"train_samples": str(n_rows), "test_samples": str(counts["n"]),
             "n_features": str(len(feature_names(prep))),
             "train_positive_rate": f"{train_rate or 0.0:.6f}", "test_positive_rate": f"{counts['rate'] or 0.0:.6f}"}
    configs = [c for c in model_configs(total_w) if not model_names or c["name"] in model_names]
    fitted, rows = {}, []
    try:
        for cfg in configs:
            start = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
            clf = cfg["estimator"].fit(vectors)
            model = PipelineModel(stages=list(prep.stages) + [clf])
            preds = probabilities(model, test).select(
                F.lit(cfg["name"]).alias("model"), "label",
                F.col("churn_probability").alias("score"),
                E.decision("churn_probability").cast("int").alias("prediction")).persist()
            try:  # read several times: counts, bucket bounds, ranks
                m = M.evaluate(preds).first()
            finally:
                preds.unpersist()
            metrics = {k: float(m[k]) for k in ["accuracy", "precision", "recall", "f1_score", "roc_auc"]}
            fitted[cfg["name"]] = model
            rows.append((run_id_for(cfg["name"], S.SEED, data_tag), cfg["name"], "FINISHED", start,
                         cfg["params"] | about,
                         {"model_type": cfg["name"], "data_tag": data_tag, "seed": str(S.SEED),
                          "primary_metric": S.PRIMARY_METRIC, "stage": "training"}, metrics))
    finally:
        vectors.unpersist()
    return fitted, spark.createDataFrame(rows, S.RUNS_SCHEMA)


def batch_score(model: PipelineModel, df: DataFrame, version: str, name: str,
                run_ts: str, id_col: str = S.ID_COL) -> DataFrame:
    """Probability (6 digits) → decision → risk band, plus version, model
    name, a stable prediction id and the run timestamp."""
    p = probabilities(model, df)
    prob = F.col("churn_probability")
    return p.select(
        id_col,
        E.rnd(prob, 6).alias("churn_probability"),
        E.decision(prob).alias("churn_prediction"),
        E.risk_band(prob).alias("risk_level"),
        F.lit(version).alias("model_version"),
        F.lit(name).alias("model_name"),
        F.sha2(F.concat_ws("|", F.col(id_col), F.lit(run_ts)), 256).alias("prediction_id"),
        F.lit(run_ts).alias("scored_at"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
