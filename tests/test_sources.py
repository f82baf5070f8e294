"""Readers, writers and saved state."""
import json
import os

from conftest import SF0001
from taskwatch import catalog as C
from taskwatch.plans.jobs import read_report
from taskwatch.session import scratch_path
from taskwatch.sources.readers import load_tasks, newest_file


def test_csv_and_parquet_roundtrip(spark):
    t = C.tasks(spark, SF0001)
    base = scratch_path(spark, "src")
    t.write.mode("overwrite").option("header", True).csv(os.path.join(base, "tasks.csv"))
    t.write.mode("overwrite").parquet(os.path.join(base, "tasks.parquet"))
    a = load_tasks(spark, os.path.join(base, "tasks.csv"))
    b = load_tasks(spark, os.path.join(base, "tasks.parquet"))
    assert a.schema == b.schema
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_newest_file(spark):
    r = newest_file(spark, SF0001).first()
    assert r["files"] >= 10 and r["path"].endswith(".parquet")


def test_read_report_defaults(spark):
    path = scratch_path(spark, "report")
    doc = {"evaluation_summary": {"metrics": {"classification": {"precision": 0.5}}}}
    spark.createDataFrame([(json.dumps(doc),)], "value string").write.text(path)
    r = read_report(spark, path).first()
    assert r["precision"] == 0.5 and r["recall"] == 0.0 and r["auc_roc"] == 0.0


def test_validate_records(spark):
    from taskwatch.sources.readers import validate_records
    t = C.tasks(spark, SF0001).limit(5)
    from pyspark.sql import functions as F
    broken = t.withColumn("engine_id", F.when(F.col("task_id") == "WO1", F.lit(None)).otherwise(F.col("engine_id")))
    valid, rejected = validate_records(broken)
    assert valid.count() + rejected.count() == 5
    r = rejected.collect()
    assert all("engine_id" in x["missing_fields"] for x in r)
