"""Record schemas.

Fixed values: the task record columns and their domains are those of the
reference data model (26 columns, timestamps as wall-clock values).
Timestamps are TIMESTAMP_NTZ: the records carry no zone, so results never
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

TIMESTAMP_COLUMNS = ["planned_start_ts", "planned_end_ts", "actual_start_ts", "actual_end_ts"]

_FIELDS = [
    ("task_id", T.StringType()),
    ("wo_id", T.StringType()),
    ("engine_id", T.StringType()),
    ("module_id", T.StringType()),
    ("submodule_id", T.StringType()),
    ("part_id", T.StringType()),
    ("serial_no", T.StringType()),
    ("task_name", T.StringType()),
    ("bay_id", T.StringType()),
    ("planned_start_ts", T.TimestampNTZType()),
    ("planned_end_ts", T.TimestampNTZType()),
    ("actual_start_ts", T.TimestampNTZType()),
    ("actual_end_ts", T.TimestampNTZType()),
    ("planned_minutes", T.LongType()),
    ("actual_minutes", T.LongType()),
    ("tech_id", T.StringType()),
    ("tech_grade", T.StringType()),
    ("concurrent_tasks", T.IntegerType()),
    ("snag_count", T.IntegerType()),
    ("snag_severity", T.IntegerType()),
    ("tat_hours_engine", T.DoubleType()),
    ("wip_count_shop", T.IntegerType()),
    ("mttr_hours_engine", T.DoubleType()),
    ("shift", T.StringType()),
    ("weekday", T.IntegerType()),
    ("is_anomaly", T.IntegerType()),
]

TASK_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in _FIELDS])
TASK_COLUMNS = [n for n, _ in _FIELDS]

# Request records: same without serial_no and the label.
REQUEST_COLUMNS = [c for c in TASK_COLUMNS if c not in ("serial_no", "is_anomaly")]
REQUEST_SCHEMA = T.StructType([f for f in TASK_SCHEMA.fields if f.name in REQUEST_COLUMNS])

# Text form of the record (CSV / JSON): timestamps arrive as ISO-8601 strings.
TASK_TEXT_SCHEMA = T.StructType([
    T.StructField(f.name, T.StringType() if f.name in TIMESTAMP_COLUMNS else f.dataType, True)
    for f in TASK_SCHEMA.fields
])
#: column in which a text reader keeps a line that it cannot read as a record
RAW_RECORD = "_raw_record"


def raw_text_schema() -> T.StructType:
    """``TASK_TEXT_SCHEMA`` with room for unreadable lines."""
    return T.StructType(TASK_TEXT_SCHEMA.fields + [T.StructField(RAW_RECORD, T.StringType(), True)])


REQUEST_TEXT_SCHEMA = T.StructType([f for f in TASK_TEXT_SCHEMA.fields if f.name in REQUEST_COLUMNS])

IDENTITY_COLUMNS = ["engine_id", "module_id", "submodule_id", "task_id", "wo_id"]
