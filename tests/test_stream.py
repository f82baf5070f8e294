"""Stream fixture: JSON task files read with availableNow, with re-sent
duplicates and a record older than the watermark."""
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from taskwatch.operators.cooldown import cooldown_batch
from taskwatch.session import scratch_path
from taskwatch.streaming.registry import BatchLedger, ModelRegistry
from taskwatch.streaming.scoring import BatchScorer, publish_fitted, run_scoring_stream, stream_paths


def test_json_stream_dedup_and_late(spark):
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    f = MC.fitted(spark, SF0001)
    root = scratch_path(spark, "models")
    publish_fitted(spark, f.features, f.detector, root)
    t = tasks(spark, SF0001)
    src = scratch_path(spark, "json-source")
    cut = t.agg(F.percentile_approx(F.unix_seconds(F.col("planned_start_ts").cast("timestamp")), 0.5)).first()[0]
    early = t.where(F.unix_seconds(F.col("planned_start_ts").cast("timestamp")) <= cut)
    late = t.where(F.unix_seconds(F.col("planned_start_ts").cast("timestamp")) > cut)
    fmt = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in
           ["planned_start_ts", "planned_end_ts", "actual_start_ts", "actual_end_ts"]}
    early.withColumns(fmt).coalesce(1).write.json(src, mode="append")
    # second file: the later tasks, re-sent tasks that start before the delay and within it, one task far older
    resent = early.orderBy("task_id").limit(5)
    stale = early.orderBy("planned_start_ts").limit(1).withColumn("task_id", F.lit("WO_STALE")) \
        .withColumn("planned_start_ts", F.col("planned_start_ts") - F.expr("INTERVAL 60 DAYS"))
    fresh = early.orderBy(F.desc("planned_start_ts"), "task_id").limit(3)   # re-sent while their start is not late yet
    late.unionByName(resent).unionByName(fresh).unionByName(stale).withColumns(fmt).coalesce(1).write.json(src, mode="append")
    paths = run_scoring_stream(spark, src, root, scratch_path(spark, "json-work"), fmt="json",
                               max_files_per_trigger=1)
    scores = spark.read.parquet(paths["scores"])
    assert scores.count() == t.count()                       # duplicates dropped, nothing lost
    assert scores.select("task_id").distinct().count() == t.count()
    assert scores.where(F.col("task_id") == "WO_STALE").count() == 0
    assert {r["task_id"] for r in spark.read.parquet(paths["late"]).collect()} == {"WO_STALE"} | {r["task_id"] for r in resent.collect()}
    again = spark.read.parquet(paths["duplicates"]).collect()
    assert {r["task_id"] for r in again} == {r["task_id"] for r in fresh.collect()}
    assert all(r["copies"] == 1 and r["duplicate_of"] == "earlier batch" for r in again)
    _sinks_are_the_sent_alerts(spark, paths, scores)


def _sinks_are_the_sent_alerts(spark, paths, scores):
    """Every sink holds the alerts that the batch cooldown passes on the same scores."""
    flagged = scores.where(F.col("anomaly_flag") == 1).withColumnRenamed("actual_end_ts", "alert_time")
    want = {r["task_id"] for r in cooldown_batch(flagged, 30).where("sent = 1").collect()}
    assert 0 < len(want) < flagged.count()
    for sink in paths["sinks"]:                              # fan-out
        events = [json.loads(r["value"]) for r in spark.read.text(sink).collect()]
        assert len(events) == len(want) and {e["task_id"] for e in events} == want
        assert set(events[0]) == {"type", "task_id", "engine_id", "anomaly_score", "timestamp"}


def test_a_key_silent_for_long_is_filled_as_in_batch(spark):
    """W17 without limit: a technician's lone task long after two others."""
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    f = MC.fitted(spark, SF0001)
    root = scratch_path(spark, "models")
    publish_fitted(spark, f.features, f.detector, root)
    t = tasks(spark, SF0001)
    order = [r["task_id"] for r in t.orderBy("planned_start_ts", "task_id").select("task_id").collect()]
    silent, minutes = [order[5], order[6], order[-3]], F.col("actual_minutes")
    t = t.withColumns({"tech_id": F.when(F.col("task_id").isin(silent), "T_SILENT").otherwise(F.col("tech_id")),
                       "actual_minutes": F.when(F.col("task_id") == order[5], minutes + 500).otherwise(minutes)})
    src = MC.write_in_order(t, "planned_start_ts", "silent-source")
    paths = run_scoring_stream(spark, src, root, scratch_path(spark, "silent-work"), max_files_per_trigger=MC.FILES)
    stream = spark.read.parquet(paths["scores"]).select("task_id", F.round("anomaly_score", 6).alias("s"), "anomaly_flag")
    raw = f.features.raw(t)
    row = raw.where(F.col("task_id") == order[-3]).select("tech_actual_minutes_std").first()
    assert row[0] > 100                                      # the old value, which 0 would replace
    batch = f.detector.score(f.features.transform(t)).select("task_id", F.round("anomaly_score", 6).alias("s"), "anomaly_flag")
    assert stream.count() == batch.count() and stream.exceptAll(batch).count() == 0
    assert len(os.listdir(paths["fills"].replace("file:", ""))) <= 2


def _texts(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in
                           ["planned_start_ts", "planned_end_ts", "actual_start_ts", "actual_end_ts"]})


def test_every_line_is_scored_rejected_late_or_a_duplicate(spark):
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    f = MC.fitted(spark, SF0001)
    root, src = scratch_path(spark, "models"), scratch_path(spark, "lines")
    publish_fitted(spark, f.features, f.detector, root)
    good = _texts(tasks(spark, SF0001).orderBy("planned_start_ts", "task_id").limit(40))
    lines = [r["j"] for r in good.select(F.to_json(F.struct("*")).alias("j")).collect()]
    without_id = [json.dumps({k: v for k, v in json.loads(x).items() if k != "task_id"}) for x in lines[:4]]
    odd_time = json.dumps(json.loads(lines[5]) | {"task_id": "ODD", "planned_end_ts": "soon"})
    broken = ["{not json", "{not json", lines[3][:50]]
    resent = [lines[7], lines[7], lines[8]]
    given = lines + without_id + [odd_time] + broken + resent
    spark.createDataFrame([(x,) for x in given], "value string").coalesce(1).write.text(src)
    paths = run_scoring_stream(spark, src, root, scratch_path(spark, "lines-work"), fmt="json")
    scores, rejects = spark.read.parquet(paths["scores"]), spark.read.parquet(paths["rejects"])
    copies = {r["task_id"]: r["copies"] for r in spark.read.parquet(paths["duplicates"]).collect()}
    assert scores.count() == 40 and rejects.count() == 8
    assert copies == {json.loads(lines[7])["task_id"]: 2, json.loads(lines[8])["task_id"]: 1}
    raw = sorted(r["raw"] for r in rejects.collect())
    assert [x for x in raw if x in broken] == sorted(broken)
    assert any(json.loads(x).get("planned_end_ts") == "soon" for x in raw if x not in broken)
    assert scores.count() + rejects.count() + sum(copies.values()) == len(given)


def test_a_batch_keeps_the_version_it_was_first_tried_with(spark):
    """Retraining between two micro-batches, one of which is tried again after a restart."""
    from taskwatch import models_catalog as MC
    from taskwatch.catalog import tasks
    from taskwatch.config import Params
    f = MC.fitted(spark, SF0001)
    root, paths = scratch_path(spark, "models"), stream_paths(scratch_path(spark, "versions-work"))
    registry = ModelRegistry(spark, root)
    with pytest.raises(FileNotFoundError):
        registry.newest()
    first = registry.publish(f.features, f.detector)
    t = tasks(spark, SF0001).orderBy("planned_start_ts", "task_id")
    ids = [r["task_id"] for r in t.select("task_id").collect()]
    early, late = t.where(F.col("task_id").isin(ids[:300])), t.where(F.col("task_id").isin(ids[300:450]))

    def of(batch):
        rows = spark.read.parquet(os.path.join(paths["scores"], f"batch={batch}"))
        return {(r["task_id"], r["model_version"], round(r["anomaly_score"], 9)) for r in rows.collect()}

    BatchScorer(spark, root, paths)(early, 0)
    before, kept = of(0), sorted(r["value"] for r in spark.read.text(paths["sinks"][0]).collect())
    src = scratch_path(spark, "retrain-src") + "/tasks.parquet"
    t.write.parquet(src)
    second = registry.retrain(src, Params(n_trees=20, contamination=0.2))
    assert registry.versions() == [first, second] and registry.newest() == second
    os.makedirs(registry.path("9" * 20).replace("file:", ""))   # a version without marker is none
    assert registry.newest() == second
    with pytest.raises(FileExistsError):
        registry.commit(second)
    BatchScorer(spark, root, paths)(early, 0)                    # tried again: same version, same scores
    assert of(0) == before and {v for _, v, _ in before} == {first}
    assert sorted(r["value"] for r in spark.read.text(paths["sinks"][0]).collect()) == kept
    BatchScorer(spark, root, paths)(late, 1)
    once = of(1)
    assert {v for _, v, _ in once} == {second} and len(once) == 150
    third = registry.publish(f.features, f.detector)
    BatchScorer(spark, root, paths)(late, 1)
    assert of(1) == once and registry.newest() == third
    models = registry.load(second)
    want = models[1].score(models[0].transform(t.where(F.col("task_id").isin(ids[:450])))).where(F.col("task_id").isin(ids[300:450]))
    assert {(r["task_id"], round(r["anomaly_score"], 9)) for r in want.collect()} == {(i, s) for i, _, s in once}


def test_the_ledger_binds_once(spark):
    class Fixed:
        def newest(self):
            return self.name

    ledger, registry = BatchLedger(spark, scratch_path(spark, "ledger")), Fixed()
    registry.name = "a"
    assert ledger.open(0, registry) == {"batch": 0, "version": "a", "seen": None}
    registry.name = "b"
    assert ledger.open(0, registry)["version"] == "a"
    ledger.close(0, "2024-01-01T00:00:00")
    ledger.close(0, "2025-01-01T00:00:00")                       # closed once
    assert ledger.open(10, registry) == {"batch": 10, "version": "b", "seen": "2024-01-01T00:00:00"}
    assert ledger.last_done(0) is None
