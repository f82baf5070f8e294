"""Alert cooldown on a stream (Q1): ``applyInPandasWithState`` keyed by engine.

State per engine is the times of its sent alerts that a coming alert could
still collide with: those not older than the watermark by more than the
cooldown, at most (watermark delay / cooldown) + 2 numbers. Within a
micro-batch an engine's alerts are taken in order of time. An alert is sent if
no sent alert of its engine, earlier or later, is closer than the cooldown: for
alerts in order this is the greedy "since the last sent" rule, and a late one
is judged by its own neighbours, not by whatever was sent last. Alerts behind
the watermark are dropped by Spark; the state of an engine that falls silent
times out once nothing can collide any more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from taskwatch.session import ship_package

OUTPUT_SCHEMA = "engine_id string, task_id string, alert_time timestamp, anomaly_score double"
STATE_SCHEMA = "sent array<long>"


def allowed(times: list[int], sent: list[int], width: int) -> list[bool]:
    """Which of the ascending ``times`` are sent; ``sent`` (ascending) is updated."""
    out = []
    for t in times:
        i = bisect_left(sent, t)
        free = (i == 0 or t - sent[i - 1] >= width) and (i == len(sent) or sent[i] - t >= width)
        if free:
            sent.insert(i, t)
        out.append(free)
    return out


def _suppress(minutes: int):
    width_us = minutes * 60_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = list(state.get[0]) if state.exists else []
        batch = pd.concat(list(pdfs)).sort_values(["alert_time", "task_id"])
        us = batch["alert_time"].astype("datetime64[us]").astype("int64")
        keep = allowed([int(t) for t in us], sent, width_us)
        watermark = state.getCurrentWatermarkMs()
        sent = [t for t in sent if t > watermark * 1000 - width_us]
        if sent:
            state.update((sent,))
            state.setTimeoutTimestamp(max(sent[-1] + width_us, watermark * 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield batch[keep]

    return fn


def cooldown_stream(alerts: DataFrame, minutes: int = 30, watermark: str = "1 day") -> DataFrame:
    """``alerts``: streaming (engine_id, task_id, alert_time timestamp, anomaly_score)."""
    ship_package(alerts.sparkSession)
    return (alerts.withWatermark("alert_time", watermark)
            .groupBy("engine_id")
            .applyInPandasWithState(_suppress(minutes), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
                                    GroupStateTimeout.EventTimeTimeout))


def alert_rows(scored: DataFrame) -> DataFrame:
    """Flagged tasks as alert rows (alert time = planned start)."""
    return scored.where(F.col("anomaly_flag") == 1).select(
        "engine_id", "task_id", F.col("planned_start_ts").cast("timestamp").alias("alert_time"),
        "anomaly_score")
