"""Labels that arrive after the scores (J2, J3 on streams).

Scored tasks and labels are two streams joined by task. A label counts if it
comes within ``wait`` of the task's score time; both streams have a watermark,
so a score is kept in state until no label for it can come any more, and a
label until no earlier score can. The watermark follows the slower stream:
neither drops the other's rows by running ahead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled(scores: DataFrame, labels: DataFrame, wait: str = "7 days", delay: str = "1 day",
             how: str = "inner") -> DataFrame:
    """``scores(task_id, scored_at, ...)`` with ``label`` and ``labelled_at`` of
    each label ``labels(task_id, labelled_at, is_anomaly)`` that counts; a task
    labelled twice comes twice. ``how="left_outer"`` adds the unlabelled ones
    once their time is over. Rows without a task id match nothing."""
    s = scores.withWatermark("scored_at", delay)
    m = labels.select(F.col("task_id").alias("_task"), "labelled_at", F.col("is_anomaly").alias("label")) \
        .withWatermark("labelled_at", delay)
    on = (F.col("task_id") == F.col("_task")) & (F.col("labelled_at") >= F.col("scored_at")) \
        & (F.col("labelled_at") <= F.col("scored_at") + F.expr(f"interval {wait}"))
    return s.join(m, on, how).drop("_task")


def latest_label(joined: DataFrame) -> DataFrame:
    """One row per task: its columns, the label that came last (of two at the
    same time the larger) as ``is_anomaly``, and the number of labels."""
    rest = [c for c in joined.columns if c not in ("task_id", "label", "labelled_at", "is_anomaly")]
    got = joined.groupBy("task_id").agg(
        *[F.first(c).alias(c) for c in rest],
        F.max(F.when(F.col("label").isNotNull(), F.struct("labelled_at", "label"))).alias("_last"),
        F.count("label").alias("n_labels"))
    return got.select("task_id", *rest, F.col("_last.label").alias("is_anomaly"), "n_labels")
