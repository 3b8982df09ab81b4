"""File sources and sinks: typed CSV/parquet/JSON scans, missing-input
errors, load-or-generate, table and report sinks, latest-report scan.

All reads take an explicit schema (no inference), all writes are Spark
writers; only existence checks run on the driver (Hadoop FileSystem, so
they work for any cluster file system).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

# Text read as null in CSV input, as pandas does by default (a lone " "
# stays a string).
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def require_input(spark: SparkSession, path: str, label: str, run_first: str) -> None:
    """Raise ``FileNotFoundError`` naming the stage to run first."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no {label} data under '{path}'; the {run_first} stage writes it")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str | None = None, label: str = "input", run_first: str = "ingestion",
               multi_line: bool = False) -> DataFrame:
    """Typed scan of a CSV (with header), parquet or JSON table. ``multi_line``: CSV
    fields may hold line breaks; such a file can't be split, so one task reads it."""
    require_input(spark, path, label, run_first)
    fmt = fmt or ("csv" if path.endswith(".csv") else "json" if path.endswith(".json") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        na = NA_VALUES
        df = (reader.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multi_line)
              .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
              .option("ignoreTrailingWhiteSpace", False).csv(path))
        # CSV has one nullValue option; map the other NA words per column.
        return df.select(*[F.when(F.col(c).cast("string").isin(na), F.lit(None)).otherwise(F.col(c)).alias(c)
                           if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
                           for c in df.columns])
    if fmt == "json":
        return reader.option("mode", "PERMISSIVE").json(path)
    return reader.parquet(path)


def load_or_generate(spark: SparkSession, path: str, n: int = 7043, seed: int = S.SEED,
                     force: bool = False) -> DataFrame:
    """Raw customer table: read it when present, otherwise generate it with
    the seeded distributed generator, persist it as parquet and read back."""
    from .synthetic import generate_customers
    if force or not path_exists(spark, path):
        generate_customers(spark, n, seed).write.mode("overwrite").parquet(path)
    return spark.read.schema(S.RAW_CUSTOMER_SCHEMA).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def write_report(report: DataFrame, directory: str, run_ts: str) -> None:
    """Write a (small) report table as JSON under ``run_ts=<run_ts>``. A rerun
    with the same stamp replaces its own rows, other runs' stay."""
    (report.withColumn("run_ts", F.lit(run_ts)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_ts").json(directory))


DRIFT_SUMMARY_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("drifted_features", T.StringType()),
    T.StructField("n_drifted_features", T.LongType()),
    T.StructField("n_features", T.LongType()),
    T.StructField("drift_score", T.DoubleType()),
    T.StructField("drift_detected", T.BooleanType()),
    T.StructField("reference_rows", T.LongType()),
    T.StructField("current_rows", T.LongType()),
    T.StructField("drift_threshold", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("run_ts", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def latest_report(spark: SparkSession, directory: str,
                  schema: T.StructType = DRIFT_SUMMARY_SCHEMA) -> DataFrame:
    """Newest report row by ``run_ts``, always one row of the same columns.
    ``status``: ``no_reports_directory``, ``no_reports_found``, ``unreadable`` (no
    line could be parsed), ``error`` (the newest report says so) or ``ok``. What
    isn't known is false, zero or ``none``; unparsable lines are counted in
    ``parse_errors`` instead of raising."""
    fields = [f for f in schema.fields if f.name not in ("_corrupt_record", "status")]
    fallback = {T.BooleanType: F.lit(False), T.LongType: F.lit(0), T.DoubleType: F.lit(0.0)}

    def filled(row: DataFrame) -> DataFrame:
        cols = [F.coalesce("method", F.lit("none")).alias("method") if f.name == "method"
                else F.coalesce(F.col(f.name), fallback[type(f.dataType)].cast(f.dataType)).alias(f.name)
                if type(f.dataType) in fallback else F.col(f.name) for f in fields]
        return row.select("status", *cols, "parse_errors")

    empty = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields],
                                  F.lit(0).cast("long").alias("parse_errors"))
    if not path_exists(spark, directory):
        return filled(empty.withColumn("status", F.lit("no_reports_directory")))
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(directory).cache()
    good = F.col("_corrupt_record").isNull()
    try:
        newest, bad, n = rows.agg(
            F.max_by(F.struct(*[f.name for f in schema.fields if f.name != "_corrupt_record"]),
                     F.when(good, F.coalesce("run_ts", F.lit("")))),
            F.count_if(~good), F.count(F.lit(1))).first()
    finally:
        rows.unpersist()
    if newest is None:
        return filled(empty.withColumn("parse_errors", F.lit(bad).cast("long"))
                      .withColumn("status", F.lit("unreadable" if n else "no_reports_found")))
    given = newest.asDict()
    row = spark.createDataFrame([tuple(given[f.name] for f in fields)], T.StructType(
        [T.StructField(f.name, f.dataType) for f in fields]))
    return filled(row.withColumn("status", F.lit(given.get("status") or "ok"))
                  .withColumn("parse_errors", F.lit(bad).cast("long")))


#: Column that holds a line that could not be parsed.
RAW_LINE = "_corrupt_record"

#: A scoring request: its id, when it was received, and the record's fields.
REQUEST_LINE_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("received_at", T.TimestampType()),
    *S.REQUEST_SCHEMA.fields, T.StructField(RAW_LINE, T.StringType())])


def read_requests(spark: SparkSession, path: str, stream: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Scoring requests (JSON lines), as a table or a stream. A line that isn't
    JSON, or has a field of another type, keeps its text in ``_corrupt_record``."""
    reader = (spark.readStream if stream else spark.read).schema(REQUEST_LINE_SCHEMA)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)
