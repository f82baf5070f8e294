"""Time and duration expressions.

All arithmetic is on TIMESTAMP_NTZ through ``timestamp_diff`` /
``timestamp_add``, which do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.sources.schema import TIMESTAMP_COLUMNS

US_PER_MINUTE = 60_000_000
US_PER_HOUR = 3_600_000_000
US_PER_DAY = 86_400_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def epoch_ntz() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch_us(col) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp (bigint)."""
    return F.timestamp_diff("MICROSECOND", epoch_ntz(), _c(col))


def trunc_hour(col) -> Column:
    c = _c(col)
    return F.timestamp_add("MICROSECOND", -F.pmod(epoch_us(c), F.lit(US_PER_HOUR)), c)


def add_minutes(col, minutes) -> Column:
    return F.timestamp_add("MINUTE", _c(minutes), _c(col))


def minutes_between(start, end) -> Column:
    """(end - start) in minutes as a double, microsecond exact."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(60_000_000.0)


def parse_timestamps(df: DataFrame) -> DataFrame:
    """ISO-8601 strings (or zoned timestamps) to wall-clock timestamps.

    Strings that do not parse become NULL instead of failing the job; the
    callers put them into a reject table (``validate_records``).
    """
    out = {}
    for name in TIMESTAMP_COLUMNS:
        if name not in df.columns:
            continue
        dtype = df.schema[name].dataType.typeName()
        if dtype == "string":
            out[name] = F.try_to_timestamp(F.col(name)).cast("timestamp_ntz")
        elif dtype != "timestamp_ntz":
            out[name] = F.col(name).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def time_features() -> dict[str, Column]:
    """P2-P11 as named expressions over a parsed task table."""
    return {
        "planned_duration_minutes": minutes_between("planned_start_ts", "planned_end_ts"),
        "actual_duration_minutes": minutes_between("actual_start_ts", "actual_end_ts"),
        "start_lag_minutes": minutes_between("planned_start_ts", "actual_start_ts"),
        "end_lag_minutes": minutes_between("planned_end_ts", "actual_end_ts"),
        # ANSI mode raises on x/0; the reference yields no usable ratio there.
        "duration_ratio": F.try_divide(F.col("actual_minutes").cast("double"),
                                       F.col("planned_minutes").cast("double")),
        "duration_variance": (F.col("actual_minutes") - F.col("planned_minutes")).cast("double"),
        "hour_of_day": F.hour("planned_start_ts"),
        "day_of_week": F.weekday("planned_start_ts"),  # Monday = 0
        "month": F.month("planned_start_ts"),
        "day_of_month": F.dayofmonth("planned_start_ts"),
    }


def with_time_features(df: DataFrame) -> DataFrame:
    return parse_timestamps(df).withColumns(time_features())
