"""The driver contract and the end-to-end model path at sf0.001."""
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001


def test_contract_keys():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(s) >= 30


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    n = df.count()
    assert n == 1000
    assert {"anomaly_score", "anomaly_flag", "if_flag", "ae_flag"} <= set(df.columns)


def test_single_task_matches_batch(spark):
    """One task scored with its history gives the batch answer."""
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    f = MC.fitted(spark, SF0001)
    t = tasks(spark, SF0001)
    target = f.scored.orderBy(F.desc("planned_start_ts"), "task_id").first()
    hist = t.where((F.col("planned_start_ts") <= F.lit(target["planned_start_ts"].isoformat(sep=" ")).cast("timestamp_ntz")))
    one = f.detector.score(f.features.transform(hist)).where(F.col("task_id") == target["task_id"]).first()
    assert one["anomaly_score"] == pytest.approx(target["anomaly_score"], abs=1e-9)
    assert one["anomaly_flag"] == target["anomaly_flag"]


def test_stream_matches_batch(spark):
    from taskwatch import models_catalog as MC
    f = MC.fitted(spark, SF0001)
    stream = MC.q_stream_scores(spark, SF0001).select("task_id", "anomaly_score", "anomaly_flag")
    batch = f.scored.select("task_id", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_flag")
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0


def test_jobs_roundtrip(spark, tmp_path):
    from taskwatch.plans.jobs import evaluate_job, score_file_job, train_job
    from taskwatch.config import Params
    from taskwatch.session import scratch_path
    from taskwatch.catalog import tasks
    src = scratch_path(spark, "jobs-src")
    tasks(spark, SF0001).write.parquet(src + "/tasks.parquet")
    art = scratch_path(spark, "artifacts")
    summary = train_job(spark, src + "/tasks.parquet", art, Params(n_trees=40))
    assert summary["data_info"]["train_samples"] == 800
    report = evaluate_job(spark, src + "/tasks.parquet", art, scratch_path(spark, "eval"))
    assert report["evaluation_summary"]["metrics"]["total_samples"] == 200
    res = score_file_job(spark, src + "/tasks.parquet", art, scratch_path(spark, "scores"))
    assert res["total_tasks"] == 1000


def test_missing_label_scores_but_refuses_metrics(spark):
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    from taskwatch.operators import metrics as M
    f = MC.fitted(spark, SF0001)
    unlabelled = tasks(spark, SF0001).drop("is_anomaly")
    scored = f.detector.score(f.features.transform(unlabelled))
    assert scored.count() == 1000 and "is_anomaly" not in scored.columns
    with pytest.raises(ValueError):
        M.classification_metrics(scored)
