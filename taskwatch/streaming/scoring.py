"""Structured Streaming scoring and alerting (T1-T5, Q1 on the stream's own alerts).

T1  ``readStream`` of task records (Parquet, JSON or CSV) -> ``foreachBatch``.
    Every record of a micro-batch is accounted for, in this order:
    rejected (S15: unreadable or incomplete, kept with its raw text), late (its
    start lies more than the delay before the latest one of earlier batches), a
    duplicate (of a record of the batch or of an earlier one; named with its
    number of copies), or scored.
    Rolling features need history, so the scored tasks are unioned with the
    stored ones whose frames a coming row may still need (the delay and two
    windows before the latest start), completed for W17 by each key's last
    rolling values before them (one row per key and table, written per batch id).
T3  flagged rows become alert events, of which the cooldown (Q1) passes on those
    that are not closer than it to an alert of their engine that was sent, in
    this batch or an earlier one.
T4  every alert sink is written from the same micro-batch (fan-out).
T5  a micro-batch is bound to a model version when it is first tried
    (``registry.BatchLedger``); its scores name the version.

Every write is keyed by the batch id and replaces what an earlier try of the
same batch wrote; a batch reads of its predecessors only what is bound to them.
The history is stored by day (``start_date=<d>/batch=<id>``), so a batch lists
the days it needs, however many batches there have been.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from taskwatch.operators.cooldown import cooldown_batch
from taskwatch.operators.rolling import ROLLING_SPEC, Carry
from taskwatch.plans.detector import DetectorModel
from taskwatch.plans.featurize import FeatureModel
from taskwatch.session import drop_paths, pin, pinned_scope
from taskwatch.sources.readers import conform, validate_records
from taskwatch.sources.schema import RAW_RECORD, TASK_SCHEMA, raw_text_schema
from taskwatch.streaming.registry import BatchLedger, Files, ModelRegistry


def publish_fitted(spark: SparkSession, features: FeatureModel, detector: DetectorModel,
                   model_root: str, version: str | None = None) -> str:
    """Publish already-fitted models as a new version; its path."""
    registry = ModelRegistry(spark, model_root)
    return registry.path(registry.publish(features, detector, version))


# ---------------------------------------------------------------- T1: the stream

def read_task_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Task records; of text that cannot be read as one, the line is kept in ``RAW_RECORD``."""
    reader = spark.readStream.schema(TASK_SCHEMA if fmt == "parquet" else raw_text_schema()).format(fmt)
    if fmt != "parquet":
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_RECORD).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return conform(reader.load(path))


class BatchScorer:
    """The ``foreachBatch`` function of T1-T5 under the folder ``work``."""

    def __init__(self, spark: SparkSession, model_root: str, paths: dict, days: int = 7, delay_days: int = 7):
        self.spark, self.paths, self.days, self.delay_days = spark, paths, days, delay_days
        self.registry, self.ledger = ModelRegistry(spark, model_root), BatchLedger(spark, paths["ledger"])
        self.files = Files(spark)

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> DataFrame:
        path = os.path.join(self.paths[kind], f"batch={batch_id}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _carry(self, batch_id: int) -> tuple[Carry, object, list[str]]:
        """The last values that the newest earlier batch stored, the start
        before which they were taken, and the folders of all earlier batches."""
        fills = self.paths["fills"]
        ids = [int(n[6:]) for n in self.files.names(fills) if n.startswith("batch=")]
        whole = [b for b in ids if b < batch_id and self.files.exists(os.path.join(fills, f"batch={b}", "until", "_SUCCESS"))]
        folders = [os.path.join(fills, f"batch={b}") for b in sorted(whole)]
        if not folders:
            return Carry(), None, folders
        until = self.spark.read.parquet(os.path.join(folders[-1], "until")).first()["until"]
        return Carry(ntz_literal(until), {p: self.spark.read.parquet(os.path.join(folders[-1], p)) for p in ROLLING_SPEC}), until, folders

    def _store(self, carry: Carry, seen, batch_id: int) -> None:
        """Each key's last values before the first start that a coming row's
        fill may look at, and that start (written last)."""
        until = ntz_literal(seen) - F.expr(f"INTERVAL {self.delay_days + self.days} DAYS")
        folder = os.path.join(self.paths["fills"], f"batch={batch_id}")
        for p, (key, _) in ROLLING_SPEC.items():
            carry.last(p, key, until).write.mode("overwrite").parquet(os.path.join(folder, p))
        self.spark.range(1).select(until.alias("until")).write.mode("overwrite").parquet(os.path.join(folder, "until"))

    def _days(self, kind: str, lo: dt.datetime, hi: dt.datetime, schema: T.StructType, batch_id: int) -> DataFrame:
        """What earlier batches stored for the days from ``lo`` to ``hi``."""
        root = self.paths[kind]
        full = T.StructType(schema.fields + [T.StructField("start_date", T.DateType()), T.StructField("batch", T.LongType())])
        span = (hi.date() - lo.date()).days + 1
        days = [os.path.join(root, f"start_date={lo.date() + dt.timedelta(days=i)}") for i in range(span)]
        days = [d for d in days if self.files.exists(d)]
        if not days:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", root).parquet(*days).where(F.col("batch") < batch_id)

    def _append_days(self, df: DataFrame, kind: str, time_col: str, batch_id: int) -> None:
        """Store by day; a retried batch replaces its own part of each day."""
        (df.withColumns({"start_date": F.to_date(time_col), "batch": F.lit(batch_id).cast("long")})
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("start_date", "batch").parquet(self.paths[kind]))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # intermediate tables pinned for this batch are dropped once its outputs exist
        with pinned_scope() as pinned:
            self._process(batch, batch_id)
        drop_paths(self.spark, pinned)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        bound = self.ledger.open(batch_id, self.registry)
        seen = dt.datetime.fromisoformat(bound["seen"]) if bound["seen"] else None
        # one evaluation of the micro-batch: what is scored, stored and rejected is the same
        tasks, rejected = validate_records(pin(batch, "stream-batch"))           # S15
        self._write(rejected, "rejects", batch_id)
        if seen is not None:
            too_late = F.col("planned_start_ts") < ntz_literal(seen - dt.timedelta(days=self.delay_days))
            self._write(tasks.where(too_late), "late", batch_id)
            tasks = tasks.where(~too_late)
        cols = [c for c in TASK_SCHEMA.fieldNames() if c in tasks.columns]
        # of several records of one task the one that ended last counts, ties by all its fields
        best = F.max(F.struct("actual_end_ts", F.xxhash64(*cols).alias("tie"), F.struct(*cols).alias("record")))
        found = pin(tasks.groupBy("task_id").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")), "stream-tasks")
        span = found.agg(F.min("best.record.planned_start_ts").alias("lo"), F.max("best.record.planned_start_ts").alias("hi")).first()
        if span["lo"] is None:
            self.ledger.close(batch_id, bound["seen"])
            return
        hi = span["hi"] if seen is None else max(seen, span["hi"])
        reach = dt.timedelta(days=self.delay_days + 2 * self.days)
        hist = self._days("history", (span["lo"] if seen is None else min(seen, span["lo"])) - reach, hi, TASK_SCHEMA, batch_id)
        known = found.join(hist.select("task_id", F.lit("earlier batch").alias("of")).distinct(), "task_id", "left")
        known = pin(known, "stream-known")
        copies = F.when(F.col("of").isNull(), F.col("copies") - 1).otherwise(F.col("copies"))
        self._write(known.select("task_id", copies.alias("copies"), F.coalesce("of", F.lit("same batch")).alias("duplicate_of"))
                    .where("copies > 0"), "duplicates", batch_id)
        new = known.where(F.col("of").isNull()).select("best.record.*")
        fm, det = self.registry.load(bound["version"])
        carry, since, earlier = self._carry(batch_id)
        if since is not None:
            hist = hist.where(F.col("planned_start_ts") > ntz_literal(since) - F.expr(f"INTERVAL {self.days} DAYS"))
        union = new.withColumn("__new", F.lit(1)).unionByName(hist.select(*cols).withColumn("__new", F.lit(0)))
        X = fm.transform(union, extra=["__new", "actual_end_ts"], carry=carry)
        scored = det.score(X.where(F.col("__new") == 1))
        out = scored.select(F.lit(batch_id).cast("long").alias("batch"), F.lit(bound["version"]).alias("model_version"),
                            "task_id", "engine_id", "anomaly_flag", "anomaly_score",
                            F.col("if_score_norm").alias("if_score"), F.col("ae_score_norm").alias("ae_score"),
                            "if_flag", "ae_flag", "planned_start_ts", "actual_end_ts")
        self._alert(self._write(out, "scores", batch_id), det.params.alert_cooldown_minutes, batch_id)
        self._store(carry, hi if since is None else max(hi, since + dt.timedelta(days=self.delay_days + self.days)), batch_id)
        drop_paths(self.spark, earlier[:-1])   # a retry needs the newest earlier one only
        self._append_days(new, "history", "planned_start_ts", batch_id)
        self.ledger.close(batch_id, hi.isoformat())

    def _alert(self, scored: DataFrame, minutes: int, batch_id: int) -> None:
        """The alerts that the cooldown passes, to every sink."""
        alerts = pin(alert_rows(scored), "stream-alerts")
        span = alerts.agg(F.min("alert_time").alias("lo"), F.max("alert_time").alias("hi")).first()
        if span["lo"] is not None:
            near = dt.timedelta(minutes=minutes)
            before = self._days("sent", span["lo"] - near, span["hi"] + near, alerts.schema, batch_id)
            alerts = cooldown_batch(alerts, minutes, against=before)
        else:
            alerts = alerts.withColumn("sent", F.lit(0))
        judged = self._write(alerts, "alerts", batch_id)
        sent = judged.where("sent = 1").drop("sent")
        for sink in self.paths["sinks"]:
            alert_events(sent).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite") \
                .text(os.path.join(sink, f"batch={batch_id}"))
        self._append_days(sent, "sent", "alert_time", batch_id)


def ntz_literal(value):
    """A wall-clock literal that does not pass through the driver's time zone."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def alert_rows(scored: DataFrame) -> DataFrame:
    """Flagged tasks as alerts; an alert's time is the end of its task, when its record is complete."""
    return scored.where(F.col("anomaly_flag") == 1).select(
        "engine_id", "task_id", F.col("actual_end_ts").alias("alert_time"), "anomaly_score")


def alert_events(alerts: DataFrame) -> DataFrame:
    """One event per alert."""
    return alerts.select(F.lit("anomaly_detected").alias("type"), "task_id", "engine_id", "anomaly_score",
                         F.col("alert_time").alias("timestamp"))


def stream_paths(work: str, n_alert_sinks: int = 2) -> dict:
    """The folders of one scoring stream."""
    names = ["scores", "alerts", "sent", "history", "fills", "rejects", "late", "duplicates", "ledger", "checkpoint"]
    return {n: os.path.join(work, n) for n in names} | {
        "sinks": [os.path.join(work, f"alerts_{i}") for i in range(n_alert_sinks)]}


def run_scoring_stream(spark: SparkSession, source: str, model_root: str, work: str,
                       fmt: str = "parquet", max_files_per_trigger: int | None = None,
                       n_alert_sinks: int = 2) -> dict:
    """Run T1-T5 over everything in ``source`` (availableNow) and return the output paths."""
    paths = stream_paths(work, n_alert_sinks)
    query = (read_task_stream(spark, source, fmt, max_files_per_trigger).writeStream
             .foreachBatch(BatchScorer(spark, model_root, paths)).option("checkpointLocation", paths["checkpoint"])
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return paths
