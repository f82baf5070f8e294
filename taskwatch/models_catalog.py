"""Registered queries that need fitted models (no SQL oracle: the forest is
randomised and the reconstruction needs an eigen-decomposition). They are
checked by row counts here and by unit tests against brute-force numpy on
small fixtures.

The fit (split, features, scaler, forest, reconstruction, thresholds) runs
once per session and data folder; every query below reuses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskwatch.catalog import rounded, scored, tasks
from taskwatch.config import Params
from taskwatch.operators import metrics as M
from taskwatch.operators.explain import explanation_rows, top_feature_summary
from taskwatch.operators.cooldown import cooldown_batch
from taskwatch.plans.jobs import Fitted, evaluation_tables, fit_and_score, training_metrics
from taskwatch.session import pin, scratch_path
from taskwatch.sources.readers import newest_file
from taskwatch.streaming.cooldown import alert_rows, cooldown_stream
from taskwatch.streaming.labels import labelled, latest_label
from taskwatch.streaming.scoring import publish_fitted, run_scoring_stream

_FITS: dict[tuple[str, str], Fitted] = {}


def fitted(spark: SparkSession, sf: str, params: Params | None = None) -> Fitted:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        _FITS[key] = fit_and_score(tasks(spark, sf), params or Params())
    return _FITS[key]


def q_iforest_scores(spark, sf):
    s = fitted(spark, sf).scored
    return rounded(s.select("task_id", "if_score", "if_flag"))


def q_reconstruction_scores(spark, sf):
    s = fitted(spark, sf).scored
    return rounded(s.select("task_id", "ae_score", "ae_flag"))


def q_hybrid_scores(spark, sf):
    s = fitted(spark, sf).scored
    return rounded(s.select("task_id", "engine_id", "is_train", "is_anomaly", "if_score_norm",
                            "ae_score_norm", "if_flag", "ae_flag", "anomaly_score", "primary_flag",
                            "agreement_flag", "anomaly_flag"))


def _explained(spark, sf) -> DataFrame:
    f = fitted(spark, sf)
    flagged = f.scored.where(F.col("anomaly_flag") == 1)
    return explanation_rows(f.detector.explain(flagged))


def q_explanations(spark, sf):
    return rounded(_explained(spark, sf))


def q_feature_contributions(spark, sf):
    return rounded(top_feature_summary(_explained(spark, sf), 10))


def q_training_metrics(spark, sf):
    return rounded(training_metrics(fitted(spark, sf).scored))


def q_evaluation_metrics(spark, sf):
    tables = evaluation_tables(fitted(spark, sf).scored)
    return rounded(tables["rank"].join(
        tables["classification"].select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col("precision"), F.col("recall"), F.col("f1_score"),
                     F.col("alert_rate"))
            for m in ("ensemble",)]))), "model", "left"))


def q_model_calibration(spark, sf):
    return rounded(M.calibration(fitted(spark, sf).scored.where(F.col("is_train") == 0)))


def q_cooldown_alerts(spark, sf):
    """Q1 batch: flagged tasks with the 30-minute per-engine cooldown applied."""
    f = fitted(spark, sf)
    alerts = f.scored.where(F.col("anomaly_flag") == 1).select(
        "engine_id", "task_id", F.col("planned_start_ts").alias("alert_time"), "anomaly_score")
    return rounded(cooldown_batch(alerts, f.detector.params.alert_cooldown_minutes))


FILES = 8


def write_in_order(df: DataFrame, time_col: str, name: str, chunks: int = 4) -> str:
    """``df`` as Parquet files written chunk after chunk in order of time (file
    streams pick files up in modification order), ``FILES`` files each, so that
    ``maxFilesPerTrigger=FILES`` gives one micro-batch per chunk. Chunks split on
    whole weeks, so rows with the same time never straddle two of them."""
    src = scratch_path(df.sparkSession, name)
    week = F.floor(F.datediff(F.to_date(time_col), F.lit("1970-01-05")) / 7)
    weeks = sorted(r[0] for r in df.select(week.alias("w")).distinct().collect())
    size = max(1, -(-len(weeks) // chunks))
    for i in range(0, len(weeks), size):
        df.where(week.between(weeks[i], weeks[min(i + size, len(weeks)) - 1])).repartition(FILES).write.mode("append").parquet(src)
    return src


def q_stream_scores(spark, sf):
    """The task view replayed as a file stream through the scoring stream."""
    f = fitted(spark, sf)
    root = scratch_path(spark, "models")
    publish_fitted(spark, f.features, f.detector, root)
    src = write_in_order(tasks(spark, sf), "planned_start_ts", "stream-source")
    paths = run_scoring_stream(spark, src, root, scratch_path(spark, "stream-work"),
                               max_files_per_trigger=FILES)
    return rounded(spark.read.parquet(paths["scores"]).drop("batch", "model_version", "actual_end_ts"))


def q_stream_cooldown(spark, sf):
    """Q1 stream: scored tasks as an alert stream through the stateful cooldown."""
    f = fitted(spark, sf)
    alerts = pin(alert_rows(f.scored), "stream-alerts")   # the wide scored table is read once, its alerts chunk by chunk
    src = write_in_order(alerts, "alert_time", "alert-source")
    stream = spark.readStream.option("maxFilesPerTrigger", FILES).schema("engine_id string, task_id string, alert_time timestamp, "
                                     "anomaly_score double").parquet(src)
    out = scratch_path(spark, "alert-sink")
    q = (cooldown_stream(stream, f.detector.params.alert_cooldown_minutes).writeStream
         .format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return rounded(spark.read.parquet(out))


def late_label_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Rule scores at the task's end, and labels that come 0 to 8 days after it;
    every tenth task is labelled anew, the other way, six days after it."""
    s = pin(scored(spark, sf).select("task_id", F.col("actual_end_ts").cast("timestamp").alias("scored_at"),
                                     "anomaly_flag", "anomaly_score", "is_anomaly"), "late-scores")
    n = F.substring("task_id", 3, 20).cast("long")
    later = lambda days: F.timestamp_add("DAY", days, F.col("scored_at"))
    labels = s.select("task_id", later(n % 9).alias("labelled_at"), "is_anomaly").unionByName(
        s.where(n % 10 == 0).select("task_id", later(F.lit(6)).alias("labelled_at"), (1 - F.col("is_anomaly")).alias("is_anomaly")))
    return s.drop("is_anomaly"), labels


def q_late_labels(spark, sf):
    """Scores and late labels as two streams, joined; the label that came
    last of those within seven days."""
    tables = dict(zip(("scored_at", "labelled_at"), late_label_tables(spark, sf)))
    streams = {}
    for time, table in tables.items():
        src = write_in_order(table, time, "late-" + time)
        streams[time] = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES).parquet(src)
    out = scratch_path(spark, "late-joined")
    q = (labelled(streams["scored_at"], streams["labelled_at"]).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "-ckpt").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return rounded(latest_label(spark.read.parquet(out).drop("scored_at")))


def q_newest_table(spark, sf):
    """What the newest Parquet file in the data folder holds: its columns,
    the rows and the non-null values of each."""
    newest = spark.read.parquet(newest_file(spark, sf).first()["path"])
    counts = newest.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"v{i}")
                                                           for i, c in enumerate(newest.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("values")) for i, c in enumerate(newest.columns)])
    return counts.select("rows", F.inline(cells))


MODEL_QUERIES = {
    "late_labels": q_late_labels,
    "iforest_scores": q_iforest_scores,
    "reconstruction_scores": q_reconstruction_scores,
    "hybrid_scores": q_hybrid_scores,
    "explanations": q_explanations,
    "feature_contributions": q_feature_contributions,
    "training_metrics": q_training_metrics,
    "evaluation_metrics": q_evaluation_metrics,
    "model_calibration": q_model_calibration,
    "cooldown_alerts": q_cooldown_alerts,
    "stream_scores": q_stream_scores,
    "stream_cooldown": q_stream_cooldown,
    "newest_table": q_newest_table,
}
