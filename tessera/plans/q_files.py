"""File formats as queries: tables written and read back as CSV and JSON, and
JSON text taken apart."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..session import scratch_path
from ..sources import files as IO
from ..sources import tables as TB
from .catalog import register


def _through(spark, df, fmt: str):
    path = scratch_path(spark, f"{fmt}-{uuid.uuid4().hex}.{fmt}")
    writer = (df.write.option("header", True).option("escape", '"').option("quoteAll", True)
              .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)) if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    return IO.read_table(spark, path, df.schema, fmt)


@register("csv_round_trip", oracle="""
select """ + ", ".join(S.CUSTOMER_COLUMNS) + " from (" + TB.oracle_dirty_view() + ")")
def csv_round_trip(spark, sf):
    """The dirty customer feed through CSV: blanks stay text, types come from the schema."""
    raw = TB.customers_dirty(spark, sf).select(*S.CUSTOMER_COLUMNS)
    return _through(spark, raw, "csv")


@register("json_props", oracle="""
select event_type, count(*) as n, count(props) as with_props,
       sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as sum_k,
       max(cast(json_extract_string(props, '$.k') as bigint)) as max_k
from events group by event_type""")
def json_props(spark, sf):
    """``events`` through JSON lines, and the JSON text in ``props`` parsed."""
    events = _through(spark, TB.table(spark, sf, "events").select("event_type", "props"), "json")
    k = F.from_json("props", "k long")["k"]
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"),
        F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))
