"""Preprocessing queries: split, imputation statistics, scaling, one-hot."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..operators import models as MD
from ..operators import preprocess as PP
from ..operators import split as SP
from . import oracle as O
from .catalog import register
from .q_clean import features_base


def labelled(spark, sf):
    return features_base(spark, sf).withColumn("label", E.encode_label(S.TARGET_COL))


def with_split(spark, sf, columns=None):
    # read several times (class counts, boundary rows, the split itself):
    # materialise the columns needed once in the shared checkpoint folder
    df = labelled(spark, sf)
    if columns is not None:
        df = df.select(S.ID_COL, "label", *columns)
    df = df.checkpoint(eager=True)
    return df.withColumn("split", SP.split_column(df))


_SPLIT_CTES = (O.clean_ctes(False) + ",\n" + O.features_cte() + """,
lab as (select *, case when Churn = 'Yes' then 1 else 0 end as label,
               md5('42' || customerID) as h from feat),
cnt as (select label, count(*) as nc from lab group by label),
tot as (select sum(nc) as n, cast(ceil(cast(0.2 as double) * sum(nc)) as bigint) as nt from cnt),
alloc as (select label, nc, (nt * nc) // n as base, (nt * nc) % n as rem, nt from cnt, tot),
rr as (select *, row_number() over (order by rem desc, label) as r from alloc),
quota as (select label, base + case when r <= nt - (select sum(base) from alloc) then 1 else 0 end as kt from rr),
ranked as (select lab.*, row_number() over (partition by lab.label order by h, customerID) as rn from lab),
splitted as (select ranked.*, case when rn <= kt then 'test' else 'train' end as split
             from ranked join quota on ranked.label = quota.label),
train as (select * from splitted where split = 'train')""")

_NUM = PP.NUM_FEATURES


@register("stratified_split", oracle="with " + _SPLIT_CTES + "\nselect customerID, label, split from splitted")
def stratified_split(spark, sf):
    return with_split(spark, sf, []).select("customerID", "label", "split")


def _impute_sql() -> str:
    parts = [f"select '{c}' as feature, 'median' as strategy, (select median({c}) from train) as median, "
             f"cast(null as varchar) as mode" for c in _NUM]
    for c in S.CATEGORICAL_FEATURES:
        parts.append(f"select '{c}', 'most_frequent', cast(null as double), "
                     f"(select v from (select {c} as v, count(*) as n from train where {c} is not null group by {c}) "
                     f"order by n desc, v limit 1)")
    return "with " + _SPLIT_CTES + "\n" + "\nunion all\n".join(parts)


@register("impute_statistics", oracle=_impute_sql())
def impute_statistics(spark, sf):
    """Median of every numeric feature and mode of every categorical one,
    fitted on the training rows."""
    train = with_split(spark, sf).where(F.col("split") == "train")
    med = PP.medians(train).select("feature", F.lit("median").alias("strategy"), "median",
                                   F.lit(None).cast("string").alias("mode"))
    mod = PP.modes(train).select("feature", F.lit("most_frequent").alias("strategy"),
                                 F.lit(None).cast("double").alias("median"), "mode")
    return med.unionByName(mod)


def _scaled_sql() -> str:
    stats = ",\n".join(
        f"(select median({c}) from train) as med_{i}, (select avg(coalesce({c}, (select median({c}) from train))) from train) as m_{i}, "
        f"(select stddev_pop(coalesce({c}, (select median({c}) from train))) from train) as s_{i}"
        for i, c in enumerate(_NUM))
    cols = ",\n".join(
        f"round((coalesce(cast({c} as double), st.med_{i}) - st.m_{i}) / case when st.s_{i} = 0 or st.s_{i} is null "
        f"then 1.0 else st.s_{i} end, 6) as numerical__{c}" for i, c in enumerate(_NUM))
    return ("with " + _SPLIT_CTES + f",\nst as (select {stats})\n"
            f"select customerID, split, {cols} from splitted, st")


@register("scaled_numeric", oracle=_scaled_sql())
def scaled_numeric(spark, sf):
    """Median-imputed, standard-scaled numeric features (train statistics,
    population deviation) for every row."""
    df = with_split(spark, sf, _NUM)
    train = df.where(F.col("split") == "train")
    med = {r["feature"]: r["median"] for r in PP.medians(train).collect()}
    stats = PP.moments(train, _NUM, med)
    cols = PP.scale_columns(stats, med)
    return df.select("customerID", "split", *[E.rnd(e, 6).alias(n) for n, e in cols.items()])


def _vocab_sql() -> str:
    parts = [f"select distinct '{c}' as feature, cast({c} as varchar) as value from train where {c} is not null"
             for c in S.CATEGORICAL_FEATURES]
    return ("with " + _SPLIT_CTES + ",\nlv as (" + " union all ".join(parts) + "),\n"
            "voc as (select feature, value, cast(row_number() over (partition by feature order by value) - 1 as int) as slot, "
            "'categorical__' || feature || '_' || value as name from lv)\n")


@register("one_hot_vocabulary", oracle=_vocab_sql() + "select * from voc")
def one_hot_vocabulary(spark, sf):
    train = with_split(spark, sf).where(F.col("split") == "train")
    return PP.vocabulary(train)


def _long_sql() -> str:
    parts = [f"select customerID, '{c}' as feature, cast({c} as varchar) as value from splitted"
             for c in S.CATEGORICAL_FEATURES]
    return (_vocab_sql() + ", al as (" + " union all ".join(parts) + ")\n"
            "select al.customerID, al.feature, voc.name from al join voc on al.feature = voc.feature and al.value = voc.value")


@register("one_hot_long", oracle=_long_sql())
def one_hot_long(spark, sf):
    """Active one-hot slot per customer and categorical feature (vocabulary
    fitted on train, applied to all rows; unknown levels → no slot)."""
    df = with_split(spark, sf, S.CATEGORICAL_FEATURES)
    vocab = PP.vocabulary(df.where(F.col("split") == "train"))
    return PP.one_hot_long(df, vocab)


def _vector_sql() -> str:
    numbers = " union all ".join(f"select customerID, 'numerical__{c}' as name, numerical__{c} as value from scaled"
                                 for c in _NUM)
    filled = " union all ".join(
        f"select customerID, '{c}' as feature, coalesce(cast({c} as varchar), (select v from (select {c} as v, count(*) as n "
        f"from train where {c} is not null group by {c}) order by n desc, v limit 1)) as value from splitted"
        for c in S.CATEGORICAL_FEATURES)
    head, _, scaled = _scaled_sql().rpartition("\nselect customerID, split")
    voc = _vocab_sql().split(",\nlv as (", 1)[1]
    return (head + ",\nscaled as (select customerID, split" + scaled + "),\nlv as (" + voc
            + f", al as ({filled})\n{numbers}\nunion all\n"
            "select al.customerID, voc.name, 1.0 from al join voc on al.feature = voc.feature and al.value = voc.value")


@register("feature_vector_long", oracle=_vector_sql())
def feature_vector_long(spark, sf):
    """The vector that the models read, for every row, as (name, value): all
    numeric slots and the one-hot slots that are set."""
    df = with_split(spark, sf, [*_NUM, *S.CATEGORICAL_FEATURES])
    prep = MD.fit_preprocessing(df.where(F.col("split") == "train"))
    names = F.array(*[F.lit(n) for n in MD.feature_names(prep)])
    slots = F.arrays_zip(names.alias("name"), vector_to_array("features").alias("value"))
    return (prep.transform(df).select(S.ID_COL, F.inline(slots))
            .where(F.col("name").startswith("numerical__") | (F.col("value") != 0))
            .select(S.ID_COL, "name", E.rnd("value", 6).alias("value")))


@register("class_weights", oracle="with " + _SPLIT_CTES + """
select label, cast(count(*) as bigint) as n,
       round((select count(*) from train) / (2.0 * count(*)), 6) as weight
from train group by label""")
def class_weights(spark, sf):
    train = with_split(spark, sf, []).where(F.col("split") == "train")
    return PP.class_weights(train)


@register("feature_metadata", oracle="with " + _SPLIT_CTES + ",\n" + """
lv as (""" + " union all ".join(
    f"select distinct '{c}' as feature, {c} as value from train where {c} is not null" for c in S.CATEGORICAL_FEATURES) + """)
select 9 as n_numerical, 15 as n_categorical,
       cast(9 + (select count(*) from lv) as bigint) as n_output_features,
       (select count(*) from splitted where split = 'train') as train_rows,
       (select count(*) from splitted where split = 'test') as test_rows,
       round((select avg(cast(label as double)) from splitted where split = 'train'), 6) as train_churn_rate,
       round((select avg(cast(label as double)) from splitted where split = 'test'), 6) as test_churn_rate""")
def feature_metadata(spark, sf):
    """Feature counts, output width, split sizes and label rates (one row)."""
    df = with_split(spark, sf)
    vocab = PP.vocabulary(df.where(F.col("split") == "train"))
    width = vocab.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") + len(_NUM)).alias("w")).first()["w"]
    stats = df.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        E.rnd(F.avg(F.when(F.col("split") == "train", F.col("label").cast("double"))), 6).alias("train_churn_rate"),
        E.rnd(F.avg(F.when(F.col("split") == "test", F.col("label").cast("double"))), 6).alias("test_churn_rate"))
    return stats.select(F.lit(len(_NUM)).alias("n_numerical"), F.lit(len(S.CATEGORICAL_FEATURES)).alias("n_categorical"),
                        F.lit(width).cast("bigint").alias("n_output_features"), "*")


@register("feature_report", oracle="with " + _SPLIT_CTES + ",\n" + """
lv as (""" + " union all ".join(
    f"select distinct {i} as f, 'categorical__{c}_' || {c} as name, {c} as v from train where {c} is not null"
    for i, c in enumerate(S.CATEGORICAL_FEATURES)) + f""")
select '{",".join(_NUM)}' as numerical_features, '{",".join(S.CATEGORICAL_FEATURES)}' as categorical_features,
       '{",".join("numerical__" + c for c in _NUM)}' || ',' || (select string_agg(name, ',' order by f, v) from lv)
         as output_features,
       (select count(*) from lv)::int + {len(_NUM)} as n_output_features,
       (select count(*) from splitted where split = 'train') as train_rows,
       (select count(*) from splitted where split = 'test') as test_rows,
       round((select avg(cast(label as double)) from splitted where split = 'train'), 6) as train_label_rate,
       round((select avg(cast(label as double)) from splitted where split = 'test'), 6) as test_label_rate,
       (select count(*) from splitted where Churn not in ('Yes', 'No')) as labels_unmapped""")
def feature_report(spark, sf):
    """The features by name, in vector order, and what the split holds."""
    df = with_split(spark, sf).withColumn("label_unmapped", E.label_unmapped(S.TARGET_COL))
    report = PP.feature_metadata(df)
    names = ("numerical_features", "categorical_features", "output_features")
    return report.select(*[F.array_join(c, ",").alias(c) if c in names else F.col(c) for c in report.columns])
