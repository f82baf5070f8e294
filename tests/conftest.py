import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from taskwatch.session import local_session
    s = local_session("*", 8, "taskwatch-tests")
    yield s
    s.stop()


def task_rows(spark, rows):
    """Build a task table from dicts; unspecified columns take neutral defaults."""
    import datetime as dt
    from taskwatch.sources.schema import TASK_SCHEMA
    base = {
        "wo_id": None, "engine_id": "E1", "module_id": "M1", "submodule_id": "S1", "part_id": "P1",
        "serial_no": None, "task_name": "repair", "bay_id": "B1",
        "planned_minutes": 60, "actual_minutes": 60, "tech_id": "T1", "tech_grade": "A",
        "concurrent_tasks": 1, "snag_count": 0, "snag_severity": 0, "tat_hours_engine": 50.0,
        "wip_count_shop": 10, "mttr_hours_engine": 10.0, "shift": "D", "weekday": 0, "is_anomaly": 0,
    }
    out = []
    for r in rows:
        d = dict(base)
        d.update(r)
        ps = d["planned_start_ts"]
        d.setdefault("planned_end_ts", ps + dt.timedelta(minutes=d["planned_minutes"]))
        d.setdefault("actual_start_ts", ps)
        d.setdefault("actual_end_ts", ps + dt.timedelta(minutes=d["actual_minutes"]))
        d["wo_id"] = d["wo_id"] or d["task_id"]
        out.append(tuple(d[f.name] for f in TASK_SCHEMA.fields))
    return spark.createDataFrame(out, TASK_SCHEMA)
