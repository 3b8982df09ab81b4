"""Streaming queries. Inputs are written by Spark from the driver tables into
the shared checkpoint folder, then consumed as streams with ``availableNow``
triggers; which windows are closed follows from the data, so SQL can check
them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expressions as E
from ..operators import drift as D
from ..operators import models as MD
from ..session import scratch_path
from ..sources import files as IO
from ..sources import tables as TB
from ..streaming import drift as SD
from ..streaming import requests as SR
from ..streaming import scoring as ST
from . import oracle as O
from .catalog import register
from .q_clean import clean_dirty
from .q_features import with_split

RUN_TS = "2024-01-31T00:00:00"


@register("stream_score")
def stream_score(spark, sf):
    """Customer records arrive as JSON files; each micro-batch is validated,
    valid rows are scored by the fitted pipeline, invalid rows quarantined."""
    root = scratch_path(spark, f"stream-score-{uuid.uuid4().hex}")
    clean_dirty(spark, sf).repartition(4).write.json(f"{root}/in")
    df = with_split(spark, sf)
    train = MD.with_weights(df.where(F.col("split") == "train"))
    total_w = train.agg(F.sum("w_balanced")).first()[0]
    model = MD.fit(train, MD.model_configs(total_w)[0]["estimator"])
    q = ST.start_scoring_stream(spark, f"{root}/in", model, f"{root}/valid", f"{root}/rejected",
                                f"{root}/_checkpoint", version="1", name="LogisticRegression",
                                run_ts=RUN_TS)
    q.awaitTermination()
    valid = spark.read.parquet(f"{root}/valid").select(
        "customerID", F.lit("scored").alias("status"), "risk_level", F.lit(None).cast("string").alias("violations"))
    rejected = spark.read.parquet(f"{root}/rejected").select(
        "customerID", F.lit("quarantined").alias("status"), F.lit(None).cast("string").alias("risk_level"),
        "violations")
    return valid.unionByName(rejected)


# Windows that the watermark (newest event less a day) has passed.
_CLOSED = """
ev as (select time_bucket(interval '7 days', ts, timestamp '1970-01-01') as window_start,
              event_type as cat, cast(value as double) as x from events),
closed as (select * from ev where window_start + interval '7 days'
           <= (select max(ts) from events) - interval '1 day')"""


def _replayed(spark, sf, parts: int | None = None):
    """``events`` written as a file feed in event-time order and read back as
    one stream: window aggregates of the closed windows."""
    root = scratch_path(spark, f"stream-events-{uuid.uuid4().hex}")
    ev = TB.table(spark, sf, "events")
    ordered = ev.repartitionByRange(parts, "ts") if parts else ev.repartitionByRange("ts")
    ordered.sortWithinPartitions("ts").write.parquet(f"{root}/in")
    q = ST.start_window_counts(spark, f"{root}/in", ev.schema, f"{root}/out", f"{root}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("stream_window_counts", oracle=f"""
with {_CLOSED}
select window_start, window_start + interval '7 days' as window_end, cat as category, count(*) as n,
       count(x) as n_value, round(avg(x), 4) as mean_value, round(var_pop(x), 4) as variance
from closed group by window_start, cat""")
def stream_window_counts(spark, sf):
    """``events`` replayed as a file stream; 7-day windows with a 1-day
    watermark; only closed windows are emitted, each with all its rows."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return _replayed(spark, sf).select(
        ntz("window_start"), ntz("window_end"), "category", "n", "n_value",
        E.rnd("mean_value", 4).alias("mean_value"),
        E.rnd(F.col("squares") / F.col("n_value"), 4).alias("variance"))


@register("stream_window_drift", oracle=f"""
with {_CLOSED},
pw as (select window_start, avg(x) as m, stddev_samp(x) as s from closed group by window_start),
r as (select * from pw order by window_start limit 1),
num as (select window_start, 'value' as feature,
               abs(m - (select m from r)) / ((select s from r) + 1e-9) as score from pw),
cats as (select distinct cat from closed where cat is not null),
sh as (select w.window_start, cats.cat, count(c.cat) as n from (select distinct window_start from closed) w
       cross join cats left join closed c on c.window_start = w.window_start and c.cat = cats.cat group by 1, 2),
p as (select window_start, cat, n / sum(n) over (partition by window_start) as p from sh),
tv as (select p.window_start, sum(abs(p.p - q.p)) / 2 as score
       from p join p q on p.cat = q.cat and q.window_start = (select window_start from r) group by p.window_start)
select window_start, feature, round(score, 4) as drift_score, coalesce(score > 0.3, false) as drifted
from (select * from num union all select window_start, 'event_type', score from tv)""")
def stream_window_drift(spark, sf):
    """Drift of each closed 7-day window of the ``events`` stream against
    the first window, computed from the streamed window aggregates."""
    counts = _replayed(spark, sf)
    per_window = D.window_moments(counts)
    cats = counts.where(F.col("category").isNotNull()).select(
        "window_start", F.col("category").alias("cat"), "n")
    return D.score_windows(per_window, cats, "value", "event_type").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz"))


# -- drift while the stream runs ----------------------------------------------------
_STREAM_NUMERIC, _STREAM_CATEGORICAL = ["value", "user_id"], ["event_type"]


@register("stream_drift_fixed_reference", oracle=f"""
with {_CLOSED.replace("cast(value as double) as x", "cast(value as double) as x, cast(user_id as double) as u")},
num as (select window_start, 'value' as feature, x from closed union all
        select window_start, 'user_id', u from closed),
mom as (select window_start, feature, count(*) as n, avg(x) as m, stddev_samp(x) as s from num group by 1, 2),
ref as (select * from mom where window_start = (select min(window_start) from ev)),
shares as (select window_start, cat, count(*) as n,
                  cast(count(*) as double) / sum(count(cat)) over (partition by window_start) as p
           from closed where cat is not null group by 1, 2),
ref_shares as (select cat, p from shares where window_start = (select min(window_start) from ev)),
tv as (select w.window_start, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 as score
       from (select distinct window_start from closed) w
       join (select distinct cat from shares) c on true
       left join shares a on a.window_start = w.window_start and a.cat = c.cat
       left join ref_shares b on b.cat = c.cat group by 1),
scores as (
  select m.window_start, m.feature, 'numeric' as kind, m.n as current_rows, r.n as reference_rows,
         abs(m.m - r.m) / (r.s + 1e-9) as score
  from mom m join ref r on m.feature = r.feature
  union all
  select tv.window_start, 'event_type', 'categorical', (select count(*) from closed c where c.window_start = tv.window_start),
         (select count(*) from closed c where c.window_start = (select min(window_start) from ev)), score from tv)
select window_start, feature, kind, current_rows, reference_rows, round(score, 4) as drift_score, score > 0.3 as drifted
from scores""")
def stream_drift_fixed_reference(spark, sf):
    """``events`` as a feed: each closed 7-day window scored, while the stream
    runs, against a reference profile of the first week that is stored before it starts."""
    root = scratch_path(spark, f"stream-drift-{uuid.uuid4().hex}")
    ev = TB.table(spark, sf, "events")
    ev.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(f"{root}/in")
    week = F.window(F.col("ts").cast("timestamp"), "7 days").start
    first = ev.agg(F.min(week)).first()[0]
    SD.write_reference(ev.where(week == F.lit(first)), _STREAM_NUMERIC, _STREAM_CATEGORICAL, f"{root}/reference")
    SD.start_drift_stream(spark, f"{root}/in", ev.schema, f"{root}/reference", f"{root}/drift", f"{root}/_checkpoint",
                          _STREAM_NUMERIC, _STREAM_CATEGORICAL).awaitTermination()
    return spark.read.parquet(f"{root}/drift").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "feature", "kind", "current_rows",
        "reference_rows", E.rnd("score", 4).alias("drift_score"), "drifted")


# -- scoring requests -------------------------------------------------------------------
def _digit(text, modulus: int):
    """A number below ``modulus`` from a text's md5, the same in both engines."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % modulus


def request_lines(customers, received: str = "2024-03-01 00:00:00"):
    """A request feed made of customers: every fifth request arrives three times,
    some lines are cut off, some requests have no id."""
    cid = F.col(S.ID_COL)
    named = customers.withColumns({
        "request_id": F.when(_digit(F.concat(cid, F.lit("id")), 19) != 4, F.md5(cid)),
        "received_at": F.lit(received).cast("timestamp") + F.make_dt_interval(secs=_digit(cid, 3600))})
    line = F.to_json(F.struct("request_id", "received_at", *[f.name for f in S.REQUEST_SCHEMA.fields]))
    cut = _digit(F.concat(cid, F.lit("cut")), 17) == 3
    times = F.when(_digit(F.concat(cid, F.lit("again")), 5) == 0, F.array(*map(F.lit, (1, 2, 3)))).otherwise(F.array(F.lit(1)))
    return named.select(F.when(cut, F.substring(line, 1, 25)).otherwise(line).alias("value"),
                            F.explode(times).alias("copy")).drop("copy")


def _md5_digit(text: str, modulus: int) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 7) as bigint) % {modulus}"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@register("request_outcomes", oracle=O.with_ctes(O.clean_ctes(True)) + f"""
, q as (
  select customerID,
         case when {_md5_digit("customerID || 'again'", 5)} = 0 then 3 else 1 end as copies,
         {_md5_digit("customerID || 'cut'", 17)} = 3 as cut, {_md5_digit("customerID || 'id'", 19)} = 4 as no_id,
         SeniorCitizen in (0, 1) and tenure >= 0 and MonthlyCharges > 0 and not isnan(MonthlyCharges)
           and TotalCharges >= 0 and not isnan(TotalCharges) and gender in {_in(S.GENDER_VALUES)}
           and Contract in {_in(S.CONTRACT_VALUES)}
           and {" and ".join(f"{f.name} is not null" for f in S.REQUEST_SCHEMA.fields)} as fine
  from clean),
o as (
  select case when cut then 'unreadable' when no_id then 'unidentified' when coalesce(fine, false) then 'scored'
              else 'invalid' end as outcome,
         case when cut or no_id then copies else 1 end as answers, copies
  from q)
select outcome, sum(answers)::bigint as answers, sum(copies)::bigint as lines
from o group by outcome""")
def request_outcomes(spark, sf):
    """A feed with repeated, cut-off and nameless requests: what became of its
    lines. A request that came several times is answered once."""
    root = scratch_path(spark, f"requests-{uuid.uuid4().hex}")
    request_lines(clean_dirty(spark, sf)).repartition(4).write.text(f"{root}/in")
    train = MD.with_weights(with_split(spark, sf).where(F.col("split") == "train"))
    total_w = train.agg(F.sum("w_balanced")).first()[0]
    model = MD.fit(train, MD.model_configs(total_w)[0]["estimator"])
    SR.start_request_stream(spark, f"{root}/in", model, f"{root}/scored", f"{root}/rejected", f"{root}/_checkpoint",
                            version="1", name="LogisticRegression", run_ts=RUN_TS).awaitTermination()
    answers = (spark.read.parquet(f"{root}/scored").select("request_id", F.lit("scored").alias("outcome"))
               .unionByName(spark.read.parquet(f"{root}/rejected").select("request_id", F.col("reason").alias("outcome"))))
    # lines of the feed by what became of their request
    feed = IO.read_requests(spark, f"{root}/in")
    odd = F.when(F.col(IO.RAW_LINE).isNotNull(), SR.UNREADABLE).when(F.col("request_id").isNull(), SR.UNIDENTIFIED)
    told = answers.where(~F.col("outcome").isin(SR.UNREADABLE, SR.UNIDENTIFIED)).select("request_id", F.col("outcome").alias("told"))
    lines = (feed.withColumn("odd", odd).join(told, "request_id", "left")
             .groupBy(F.coalesce("odd", "told").alias("outcome")).agg(F.count(F.lit(1)).alias("lines")))
    return (answers.groupBy("outcome").agg(F.count(F.lit(1)).alias("answers"))
            .join(lines, "outcome", "full").select("outcome", "answers", "lines"))
