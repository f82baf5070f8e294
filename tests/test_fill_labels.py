"""Fill per key (F4), the task table (S5), job artifacts by value (S6-S12), late labels."""
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, task_rows
from taskwatch.catalog import tasks
from taskwatch.operators.fill import forward_fill
from taskwatch.session import scratch_path

SCHEMA = "id long, k string, t timestamp, x double, y string"


def test_forward_fill_against_brute_force(spark):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        key = r.choice(["hot", "hot", "b", "c", None])
        t = None if r.random() < .05 else start + dt.timedelta(hours=r.randrange(24 * 40))
        rows.append((i, key, t, r.random() if r.random() < .2 else None, r.choice(["p", None, None])))
    last, want = {}, {}
    for i, k, t, x, y in sorted((q for q in rows if q[1] and q[2]), key=lambda q: (q[2], q[0])):
        a, b = last.get(k, (None, None))
        last[k] = want[i] = (a if x is None else x, b if y is None else y)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = forward_fill(df, ["x", "y"], "k", "t", "id")
    assert got.columns == df.columns
    for i, k, t, x, y in got.collect():
        assert (x, y) == (want[i] if k and t else rows[i][3:]), i
    assert got.count() == 600
    assert forward_fill(df.limit(0), ["x"], "k", "t", "id").count() == 0


def test_fill_key_is_a_parameter_of_the_features(spark):
    from taskwatch.config import Params
    from taskwatch.plans.featurize import FeaturePipeline
    d = dt.datetime(2024, 3, 4, 8)
    t = task_rows(spark, [
        {"task_id": "a", "planned_start_ts": d, "tat_hours_engine": 70.0},
        {"task_id": "b", "planned_start_ts": d + dt.timedelta(days=2), "tat_hours_engine": None},
        {"task_id": "c", "planned_start_ts": d + dt.timedelta(days=3), "engine_id": "E2", "tat_hours_engine": None}])
    for key, want in ((None, {"a": 70.0, "b": 0.0, "c": 0.0}), ("engine_id", {"a": 70.0, "b": 70.0, "c": 0.0})):
        model = FeaturePipeline(Params(fill_key=key)).fit(t)
        assert {r["task_id"]: r["tat_hours_engine"] for r in model.raw(t).collect()} == want
    with pytest.raises(ValueError):
        model.raw(t, carry=object())


def test_ingest_writes_a_table_that_reads_back(spark):
    from taskwatch.plans.jobs import ingest_job
    from taskwatch.sources.readers import load_tasks, read_task_days
    t = tasks(spark, SF0001).withColumn("engine_id", F.when(F.col("task_id") != "WO5", F.col("engine_id")))
    src, out = scratch_path(spark, "ingest") + ".parquet", scratch_path(spark, "ingested")
    t.write.parquet(src)
    n = t.where("engine_id is null").count()
    assert ingest_job(spark, src, out) == {"accepted": t.count() - n, "rejected": n}
    valid = t.where("engine_id is not null")
    back = load_tasks(spark, out + "/tasks.parquet").select(*t.columns)
    text = load_tasks(spark, out + "/tasks_csv").select(*t.columns)
    for df in (back, text):
        assert df.exceptAll(valid).count() == 0 and valid.exceptAll(df).count() == 0
    day = t.agg(F.to_date(F.min("planned_start_ts"))).first()[0] + dt.timedelta(days=1)
    some = read_task_days(spark, out + "/tasks.parquet", str(day), str(day + dt.timedelta(days=2)))
    want = valid.where(F.to_date("planned_start_ts").between(F.lit(day), F.lit(day + dt.timedelta(days=2))))
    assert some.select(*t.columns).exceptAll(want).count() == 0 and some.count() == want.count() > 0
    assert "PartitionFilters: [isnotnull(start_date" in some._jdf.queryExecution().toString()


def test_job_artifacts_hold_the_fitted_values(spark):
    from taskwatch.config import Params
    from taskwatch.plans.detector import DetectorModel
    from taskwatch.plans.featurize import FeatureModel
    from taskwatch.plans.jobs import evaluate_job, fit_and_score, score_file_job, train_job
    src, art = scratch_path(spark, "jobs") + ".parquet", scratch_path(spark, "artifacts")
    t = tasks(spark, SF0001)
    t.write.parquet(src)
    p = Params(n_trees=30)
    summary = train_job(spark, src, art, p)
    f = fit_and_score(t, p)
    features, detector = FeatureModel.load(spark, art + "/features"), DetectorModel.load(spark, art + "/detector")
    assert features.params == p and features.features == f.features.features and features.categories == f.features.categories
    for c, (m, s) in f.features.scaler.items():
        assert features.scaler[c] == pytest.approx((m, s))
    assert detector.if_threshold == pytest.approx(f.detector.if_threshold)
    assert detector.ae_threshold == pytest.approx(f.detector.ae_threshold)
    saved = json.loads(spark.read.text(art + "/thresholds").first()[0])
    assert saved["thresholds"] == summary["thresholds"]
    assert saved["thresholds"]["isolation_forest"] == detector.if_threshold
    out = scratch_path(spark, "scores")
    result = score_file_job(spark, src, art, out)
    csv = {r["task_id"]: r for r in spark.read.option("header", True).option("inferSchema", True).csv(out).collect()}
    want = {r["task_id"]: r for r in f.scored.collect()}
    assert csv.keys() == want.keys() and result["anomalies_detected"] == sum(r["anomaly_flag"] for r in csv.values())
    for k, r in want.items():
        assert csv[k]["anomaly_score"] == pytest.approx(r["anomaly_score"], abs=1e-9)
        assert csv[k]["if_score"] == pytest.approx(r["if_score_norm"], abs=1e-9)
        assert (csv[k]["anomaly_flag"], csv[k]["engine_id"]) == (r["anomaly_flag"], r["engine_id"])
    ev = scratch_path(spark, "eval")
    report = evaluate_job(spark, src, art, ev)
    m = report["evaluation_summary"]["metrics"]
    test = [r for r in want.values() if r["is_train"] == 0]
    assert m["confusion_matrix"] == [[sum(r["is_anomaly"] == a and r["anomaly_flag"] == b for r in test) for b in (0, 1)]
                                     for a in (0, 1)]
    lines = [r[0] for r in spark.read.text(ev + "/metrics_summary").collect()]
    assert f"Total samples: {len(test):,}" in lines


def test_late_labels_give_the_metrics_of_the_batch(spark):
    from taskwatch import models_catalog as MC
    from taskwatch.operators import metrics as M
    got = MC.q_late_labels(spark, SF0001)
    scores, labels = (x.collect() for x in MC.late_label_tables(spark, SF0001))
    at = {r["task_id"]: r for r in scores}
    last = {}
    for task, when, label in labels:
        if when - at[task]["scored_at"] <= dt.timedelta(days=7):
            last[task] = max(last.get(task, (when, label)), (when, label))
    assert {r["task_id"]: r["is_anomaly"] for r in got.collect()} == {k: v[1] for k, v in last.items()}
    batch = spark.createDataFrame([(k, at[k]["anomaly_flag"], v[1]) for k, v in last.items()],
                                  "task_id string, anomaly_flag int, is_anomaly int")
    assert M.classification_metrics(got).first() == M.classification_metrics(batch).first()
