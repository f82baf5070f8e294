"""Batch jobs: train (T7, S10-S12, M20), evaluate (T7, S13-S14), score a file
(T6, S6, M21).

Train order fixes the reference's leakage (D9): split first, fit the
categories, group means and scaler on the training rows only. Rolling
features are computed over all rows because their frames only look back in
time, so a test row sees the seven days before it, as it would in service.
Evaluation scores the held-out rows (D11) and joins labels by key (D2).
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskwatch.config import Params
from taskwatch.operators import metrics as M
from taskwatch.operators.ensemble import anomaly_summary
from taskwatch.operators.split import time_split
from taskwatch.plans.detector import DetectorModel, HybridDetector
from taskwatch.plans.featurize import FeatureModel, FeaturePipeline
from taskwatch.session import drop_paths, pin, pinned_scope
from taskwatch.sources.readers import conform, load_tasks, validate_records


@dataclass
class Fitted:
    features: FeatureModel
    detector: DetectorModel
    scored: DataFrame          # every task, scored, with is_train and identity columns
    X: DataFrame               # scaled matrix of every task


def fit_and_score(tasks: DataFrame, params: Params | None = None) -> Fitted:
    p = params or Params()
    tasks = conform(tasks)
    split = pin(time_split(tasks, p.test_size))
    fm, X = FeaturePipeline(p).fit_transform(split, "is_train")   # X is a projection of the pinned raw features
    det, raw_scores = HybridDetector(p).fit_scored(X, fm.features, "is_train")
    scored = det.score(raw_scores, raw=False)   # flags and ensemble: projections only
    return Fitted(fm, det, scored, X)


def training_metrics(scored: DataFrame) -> DataFrame:
    """M1-M3, M5, M8, M11 on the training rows (AUC of the hard flags)."""
    train = scored.where(F.col("is_train") == 1)
    cls = M.classification_metrics(train)
    auc = M.rank_metrics(M.long_scores(train.withColumn("__f", F.col("anomaly_flag").cast("double")),
                                       {"flags": "__f"}))
    return _with_auc(cls, auc)


def _with_auc(cls: DataFrame, auc: DataFrame) -> DataFrame:
    # both sides have one row; attach by aggregation over a union, not a join
    a = auc.select(F.col("auc_roc").alias("v"), F.lit("auc_roc").alias("k"))
    c = cls.select(F.inline(F.array(*[F.struct(F.col(n).cast("double").alias("v"), F.lit(n).alias("k"))
                                      for n in cls.columns])))
    names = cls.columns + ["auc_roc"]
    return c.unionByName(a).groupBy().pivot("k", names).agg(F.first("v"))


def evaluation_tables(scored: DataFrame, params: Params | None = None) -> dict[str, DataFrame]:
    """Everything the evaluation report and its charts need, on held-out rows."""
    p = params or Params()
    test = scored.where((F.col("is_train") == 0) & F.col("is_anomaly").isNotNull())
    long = M.long_scores(test, {"ensemble": "anomaly_score", "isolation_forest": "if_score_norm",
                                "autoencoder": "ae_score_norm"})
    ranked = M.ranked_counts(long)   # counted and ranked once for the three tables that read it
    return {
        "classification": M.classification_metrics(test),
        "rank": M.rank_metrics(long, ranked),
        "confusion": M.confusion_matrix(test),
        "roc": M.roc_curve(long, ranked),
        "pr": M.pr_curve(long, ranked),
        "histogram": M.histogram(long),
        "boxplot": M.boxplot(long),
        "calibration": M.calibration(test),
    }


def train_job(spark: SparkSession, data_path: str, artifacts: str, params: Params | None = None) -> dict:
    """T7 train: fit, save every artifact, return the training summary.
    Intermediate tables pinned on the way are dropped once the artifacts exist."""
    with pinned_scope() as pinned:
        summary = _train(spark, data_path, artifacts, params)
    drop_paths(spark, pinned)
    return summary


def _train(spark: SparkSession, data_path: str, artifacts: str, params: Params | None) -> dict:
    p = params or Params()
    valid = _accepted(load_tasks(spark, data_path, raw=True), os.path.join(artifacts, "rejects"))
    fitted = fit_and_score(valid, p)
    fitted.features.save(os.path.join(artifacts, "features"))
    fitted.detector.save(spark, os.path.join(artifacts, "detector"))
    tm = training_metrics(fitted.scored).first().asDict()
    counts = fitted.scored.agg(F.count(F.lit(1)).alias("n"), F.sum("is_train").alias("train"),
                               F.avg(F.col("is_anomaly").cast("double")).alias("rate")).first()
    summary = {"training_metrics": tm,
               "data_info": {"total_samples": counts["n"], "train_samples": counts["train"],
                             "test_samples": counts["n"] - counts["train"],
                             "features": len(fitted.features.features), "anomaly_rate": counts["rate"]},
               "model_info": {"isolation_forest_weight": p.if_weight, "autoencoder_weight": p.ae_weight},
               "thresholds": {"anomaly_score": p.anomaly_score_threshold,
                              "isolation_forest": fitted.detector.if_threshold,
                              "reconstruction_error": fitted.detector.ae_threshold,
                              "alert_cooldown_minutes": p.alert_cooldown_minutes}}
    _write_json(spark, summary, os.path.join(artifacts, "thresholds"))   # S12
    return summary


def evaluate_job(spark: SparkSession, data_path: str, artifacts: str, out_dir: str) -> dict:
    """T7 evaluate: score held-out rows with saved models, write report (S13) and summary."""
    with pinned_scope() as pinned:
        report = _evaluate(spark, data_path, artifacts, out_dir)
    drop_paths(spark, pinned)
    return report


def _evaluate(spark: SparkSession, data_path: str, artifacts: str, out_dir: str) -> dict:
    fm = FeatureModel.load(spark, os.path.join(artifacts, "features"))
    det = DetectorModel.load(spark, os.path.join(artifacts, "detector"))
    valid = _accepted(load_tasks(spark, data_path, raw=True), os.path.join(out_dir, "rejects"))
    tasks = pin(time_split(valid, fm.params.test_size))
    X = fm.transform(tasks, extra=["is_train"])
    scored = pin(det.score(X))
    tables = evaluation_tables(scored)
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(os.path.join(out_dir, name))
    report = report_document(tables) | {
        "timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "model_info": {"weights": {"isolation_forest": fm.params.if_weight, "autoencoder": fm.params.ae_weight},
                       "thresholds": {"anomaly_score": fm.params.anomaly_score_threshold,
                                      "isolation_forest": det.if_threshold, "reconstruction_error": det.ae_threshold}},
        "data_info": {"path": data_path, "features": len(fm.features), "test_size": fm.params.test_size}}
    _write_json(spark, report, os.path.join(out_dir, "evaluation_report"))
    spark.createDataFrame([(summary_text(report),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(out_dir, "metrics_summary"))
    return report


def report_document(tables: dict[str, DataFrame]) -> dict:
    cls = tables["classification"].first().asDict()
    ranks = {r["model"]: r.asDict() for r in tables["rank"].collect()}
    cm = {(r["actual"], r["predicted"]): r["n"] for r in tables["confusion"].collect()}
    auc = ranks.get("ensemble", {}).get("auc_roc", 0.5)
    metrics = {
        "classification": {k: cls[k] for k in ("precision", "recall", "f1_score", "alert_rate",
                                                "true_anomaly_rate")},
        "auc_metrics": {"auc_roc": auc, "auc_pr": ranks.get("ensemble", {}).get("auc_pr", 0.0)},
        "model_comparison": {"isolation_forest_auc": ranks.get("isolation_forest", {}).get("auc_roc", 0.5),
                             "autoencoder_auc": ranks.get("autoencoder", {}).get("auc_roc", 0.5),
                             "ensemble_auc": auc},
        "confusion_matrix": [[cm.get((0, 0), 0), cm.get((0, 1), 0)], [cm.get((1, 0), 0), cm.get((1, 1), 0)]],
        "total_samples": cls["total_samples"], "anomalies_detected": cls["anomalies_detected"],
        "true_anomalies": cls["true_anomalies"],
    }
    models = metrics["model_comparison"]
    advised = tables["classification"].withColumns({
        "if_auc": F.lit(float(models["isolation_forest_auc"])), "ae_auc": F.lit(float(models["autoencoder_auc"]))})
    recs = advised.select(M.recommendations(advised).alias("r")).first()["r"]
    return {"evaluation_summary": {"metrics": metrics}, "recommendations": list(recs)}


def summary_text(report: dict) -> str:
    """The plain-text metrics summary."""
    # The labels of the reference's text report.
    m = report["evaluation_summary"]["metrics"]
    c, a, mc = m["classification"], m["auc_metrics"], m["model_comparison"]
    lines = [
        "Evaluation Summary", "",
        f"Total samples: {m['total_samples']:,}", f"True anomalies: {m['true_anomalies']:,}",
        f"Anomaly rate: {c['true_anomaly_rate']:.1%}", "",
        f"Precision: {c['precision']:.3f}", f"Recall: {c['recall']:.3f}", f"F1 Score: {c['f1_score']:.3f}",
        f"Alert Rate: {c['alert_rate']:.1%}", "",
        f"AUC-ROC: {a['auc_roc']:.3f}", f"AUC-PR: {a['auc_pr']:.3f}", "",
        f"Isolation Forest AUC: {mc['isolation_forest_auc']:.3f}",
        f"Autoencoder AUC: {mc['autoencoder_auc']:.3f}", f"Ensemble AUC: {mc['ensemble_auc']:.3f}", "",
        f"Confusion Matrix: {m['confusion_matrix']}", "", "Recommendations:",
    ] + [f"- {r}" for r in report["recommendations"]]
    return "\n".join(lines)


def score_file_job(spark: SparkSession, data_path: str, artifacts: str, out_path: str) -> dict:
    """S1/S2 -> F10 -> score -> S6 CSV with the reference's 8 columns, plus M21."""
    with pinned_scope() as pinned:
        result = _score_file(spark, data_path, artifacts, out_path)
    drop_paths(spark, pinned)
    return result


def _score_file(spark: SparkSession, data_path: str, artifacts: str, out_path: str) -> dict:
    fm = FeatureModel.load(spark, os.path.join(artifacts, "features"))
    det = DetectorModel.load(spark, os.path.join(artifacts, "detector"))
    valid = _accepted(load_tasks(spark, data_path, raw=True), out_path + "_rejects")
    scored = pin(det.score(fm.transform(valid)))
    out = scored.select("task_id", "engine_id", "anomaly_flag", "anomaly_score",
                        F.col("if_score_norm").alias("if_score"), F.col("ae_score_norm").alias("ae_score"),
                        "if_flag", "ae_flag")
    out.write.mode("overwrite").option("header", True).csv(out_path)
    return anomaly_summary(scored).first().asDict()


def _accepted(tasks: DataFrame, rejects: str) -> DataFrame:
    """The valid records of ``tasks``; the others, with the names of the fields
    that are missing or did not parse, are written to ``rejects`` (S15)."""
    valid, rejected = validate_records(tasks)
    rejected.write.mode("overwrite").parquet(rejects)
    return valid


def ingest_job(spark: SparkSession, data_path: str, out: str) -> dict:
    """Read a task file, write its valid records as the task
    table and the others as rejects; the counts of what was written."""
    valid = _accepted(load_tasks(spark, data_path, raw=True), os.path.join(out, "rejects"))
    write_tasks(valid, out)
    return {name: spark.read.parquet(os.path.join(out, path)).count()
            for name, path in (("accepted", "tasks.parquet"), ("rejected", "rejects"))}


def write_tasks(tasks: DataFrame, path: str) -> None:
    """The task table as Parquet partitioned by start date, and as CSV with
    a header, under ``path``. A day is written by few tasks, a large one by more."""
    dated = tasks.withColumn("start_date", F.to_date("planned_start_ts"))
    dated.hint("rebalance", "start_date").write.mode("overwrite").partitionBy("start_date") \
        .parquet(os.path.join(path, "tasks.parquet"))
    tasks.write.mode("overwrite").option("header", True).csv(os.path.join(path, "tasks_csv"))


def _write_json(spark: SparkSession, doc: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(doc, default=str),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read a report and flatten its nested metrics with 0 defaults."""
    raw = spark.read.json(path)
    m = "evaluation_summary.metrics"
    cols = {
        "precision": f"{m}.classification.precision", "recall": f"{m}.classification.recall",
        "f1_score": f"{m}.classification.f1_score", "alert_rate": f"{m}.classification.alert_rate",
        "auc_roc": f"{m}.auc_metrics.auc_roc", "auc_pr": f"{m}.auc_metrics.auc_pr",
        "isolation_forest_auc": f"{m}.model_comparison.isolation_forest_auc",
        "autoencoder_auc": f"{m}.model_comparison.autoencoder_auc",
        "total_samples": f"{m}.total_samples",
    }
    fields = set(_paths(raw.schema))
    return raw.select(*[(F.coalesce(F.col(p).cast("double"), F.lit(0.0)) if p in fields else F.lit(0.0))
                        .alias(k) for k, p in cols.items()])


def _paths(schema, prefix=""):
    from pyspark.sql.types import StructType
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        yield name
        if isinstance(f.dataType, StructType):
            yield from _paths(f.dataType, name + ".")
