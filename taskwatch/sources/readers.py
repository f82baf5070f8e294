"""Readers: task tables (S1-S4) and the task view over the driver's tables.

Text files are read with the task schema, never an inferred one: inference
costs a pass over the data and can change between files. Parquet files bring
their own schema; ``conform`` casts it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskwatch.functions.time import add_minutes, epoch_us, trunc_hour
from taskwatch.sources.schema import RAW_RECORD, TASK_COLUMNS, TASK_SCHEMA, TASK_TEXT_SCHEMA, TIMESTAMP_COLUMNS, raw_text_schema
from taskwatch.functions.time import parse_timestamps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_parquet_tasks(spark: SparkSession, path: str) -> DataFrame:
    """S1. Parquet files may store timestamps as strings or zoned values."""
    return conform(spark.read.parquet(path))


def read_task_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The tasks of a table that ``jobs.write_tasks`` wrote, started on the days
    ``first`` to ``last`` (ISO dates, inclusive); only these days are read."""
    days = F.col("start_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return conform(spark.read.parquet(path).where(days)).drop("start_date")


def read_csv_tasks(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """S2. Header CSV with ISO-8601 timestamp strings. With ``raw``, a line that
    is no record of the schema is kept as it is in ``RAW_RECORD``."""
    reader = spark.read.schema(raw_text_schema() if raw else TASK_TEXT_SCHEMA).option("header", True)
    return conform((reader.option("columnNameOfCorruptRecord", RAW_RECORD) if raw else reader).csv(path))


def read_json_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Request records, one JSON document a line; unreadable lines are kept in ``RAW_RECORD``."""
    return conform(spark.read.schema(raw_text_schema()).option("columnNameOfCorruptRecord", RAW_RECORD).json(path))


def load_tasks(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """S3: pick the reader by suffix, as the reference does."""
    if path.endswith(".parquet"):
        return read_parquet_tasks(spark, path)
    return read_csv_tasks(spark, path, raw)


def conform(df: DataFrame) -> DataFrame:
    """Cast known columns to the task schema; absent optional columns stay absent.
    Where ``RAW_RECORD`` is asked for, a record with a timestamp that does not
    parse is kept there as it came."""
    if RAW_RECORD in df.columns:
        texts = [c for c in TIMESTAMP_COLUMNS if c in df.columns and df.schema[c].dataType.typeName() == "string"]
        odd = F.exists(F.array(*[F.col(c).isNotNull() & F.try_to_timestamp(F.col(c)).isNull() for c in texts]), lambda x: x) \
            if texts else F.lit(False)
        record = F.to_json(F.struct(*[c for c in df.columns if c != RAW_RECORD]))
        df = df.withColumn(RAW_RECORD, F.coalesce(F.col(RAW_RECORD), F.when(odd, record)))
    df = parse_timestamps(df)
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in TASK_SCHEMA.fields
             if f.name in df.columns and df.schema[f.name].dataType != f.dataType}
    return df.withColumns(casts) if casts else df


def validate_records(df: DataFrame, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split records into (valid, rejected); a record is rejected when its
    text could not be read, a required request field is missing or a timestamp
    did not parse. The rejected side carries the list of offending fields
    (``RAW_RECORD`` for text that is no whole record) and the record as text: the line itself
    where the reader kept it, else its fields as JSON."""
    from taskwatch.sources.schema import REQUEST_COLUMNS
    required = [c for c in (required or REQUEST_COLUMNS) if c in df.columns]
    fields = [c for c in df.columns if c != RAW_RECORD]
    line = F.col(RAW_RECORD) if RAW_RECORD in df.columns else F.lit(None).cast("string")
    missing = F.array_compact(F.array(F.when(line.isNotNull(), F.lit(RAW_RECORD)),
                                      *[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    tagged = df.withColumn("__missing", missing)
    valid = tagged.where(F.size("__missing") == 0).select(*fields)
    rejected = tagged.where(F.size("__missing") > 0).select(
        *fields, F.col("__missing").alias("missing_fields"), F.coalesce(line, F.to_json(F.struct(*fields))).alias("raw"))
    return valid, rejected


def newest_file(spark: SparkSession, directory: str, suffix: str = ".parquet") -> DataFrame:
    """The most recently modified file in a folder, as a one-row table.

    Uses Spark's file listing metadata (``_metadata``), so it runs on any
    file system Spark can read; only one row per file reaches the result.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
             .load(directory).select("path", "modificationTime", "length"))
    return files.agg(F.max_by("path", "modificationTime").alias("path"),
                     F.max("modificationTime").alias("modified"),
                     F.count(F.lit(1)).alias("files"))


def task_view(events: DataFrame) -> DataFrame:
    """One maintenance task per event (see FIXTURES.md §2).

    Integer arithmetic only, so every engine rounds alike. The planned start
    is the event time truncated to the hour, as in the reference data.
    """
    eid = F.col("event_id")
    uid = F.col("user_id")
    ps = trunc_hour(F.col("ts").cast("timestamp_ntz"))
    pm = F.lit(60) + (eid % 7) * 30
    pct = F.when(eid % 13 == 3, F.lit(250)).otherwise(F.lit(80) + eid % 50)
    delay = eid % 30 + F.when(eid % 26 == 3, F.lit(600)).otherwise(F.lit(0))
    prod = pm * pct
    actual = ((prod - prod % 100) / 100).cast("bigint")
    task_id = F.concat(F.lit("WO"), eid.cast("string"))
    cols = {
        "task_id": task_id,
        "wo_id": task_id,
        "engine_id": F.concat(F.lit("E"), (uid % 10).cast("string")),
        "module_id": F.concat(F.lit("M"), (uid % 20).cast("string")),
        "submodule_id": F.concat(F.lit("S"), (uid % 100).cast("string")),
        "part_id": F.concat(F.lit("P"), (eid % 400).cast("string")),
        "serial_no": F.lit(None).cast("string"),
        "task_name": F.col("event_type"),
        "bay_id": F.concat(F.lit("B"), (eid % 5).cast("string")),
        "planned_start_ts": ps,
        "planned_end_ts": add_minutes(ps, pm),
        "actual_start_ts": add_minutes(ps, delay),
        "actual_end_ts": add_minutes(ps, delay + actual),
        "planned_minutes": pm.cast("bigint"),
        "actual_minutes": actual,
        "tech_id": F.concat(F.lit("T"), uid.cast("string")),
        "tech_grade": F.substring(F.lit("ABC"), (uid % 3 + 1).cast("int"), 1),
        "concurrent_tasks": (eid % 4 + 1).cast("int"),
        "snag_count": F.when(eid % 13 == 3, F.lit(9)).otherwise(eid % 3).cast("int"),
        "snag_severity": F.when(eid % 13 == 3, F.lit(3)).otherwise(eid % 2).cast("int"),
        "tat_hours_engine": F.col("value").cast("double"),
        "wip_count_shop": (eid % 25 + 5).cast("int"),
        "mttr_hours_engine": F.col("value").cast("double") / F.lit(4.0),
        "shift": F.when(eid % 2 == 0, F.lit("D")).otherwise(F.lit("N")),
        "weekday": F.weekday(ps),
        "is_anomaly": F.when(eid % 13 == 3, F.lit(1)).otherwise(F.lit(0)).cast("int"),
    }
    return events.select(*[cols[c].alias(c) for c in TASK_COLUMNS])


def tasks_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_view(table(spark, sf_dir, "events"))


__all__ = ["table", "load_tasks", "read_parquet_tasks", "read_task_days", "read_csv_tasks", "read_json_tasks", "conform",
           "newest_file", "task_view", "tasks_from_events", "epoch_us"]
