"""Alert cooldown (Q1): per engine, an alert is sent only if at least
``minutes`` have passed since the last *sent* alert of that engine.

"Last sent" makes this sequential, but what an engine's earlier alerts mean for
a stretch of time is only the time of the last one sent before it. So the time
is cut into chunks, and per (engine, chunk) the map "last sent before -> last
sent after" is worked out on its own:

1. Inside a chunk every alert points to the first one at or after its time plus
   the cooldown; following the pointers from the right gives each alert the
   last one its chain reaches. What was sent before the chunk only decides with
   which alert the chain starts, so the map is a step function of the earliest
   time allowed; neighbouring steps with the same end are joined.
2. The maps of an engine are composed in order of time, one row per chunk: the
   earliest allowed time in each chunk follows. An engine has as many chunks as
   the time span, however many alerts it has.
3. Every chunk is walked again from its own start, and the chain is marked.

Alerts of one engine at the same time are thinned to the one with the smallest
id first; the others are never sent. A hot engine spreads over its chunks, no
step is repeated, and the number of shuffles does not depend on the data.
``against`` holds alerts that are sent already (of earlier micro-batches): an
alert closer than the cooldown to one of them, before or after, is not sent.

Defined results: alerts without an engine, time or id are not sent; of rows
with equal engine, time and id all or none are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from taskwatch.functions.time import US_PER_DAY, US_PER_MINUTE, epoch_us
from taskwatch.session import ship_package

#: widths of a chunk are this many cooldowns, or a day if that is more
CHUNK_COOLDOWNS = 8


def chain_steps(t: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of one chunk with ascending alert times ``t``: if sending is
    allowed from ``a`` on, the last alert sent is ``last[i]`` for the first
    ``i`` with ``a <= until[i]``, and none beyond."""
    n = len(t)
    following = np.searchsorted(t, t + width, side="left")
    last = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        last[i] = t[i] if following[i] == n else last[following[i]]
    # what was sent before the chunk bars less than one cooldown from its first alert on
    m = min(n, int(following[0]) + 1) if n else 0
    t, last = t[:m], last[:m]
    keep = np.append(last[1:] != last[:-1], True) if m else np.zeros(0, dtype=bool)
    return t[keep], last[keep]


def walk(t: np.ndarray, allowed: int, width: int) -> np.ndarray:
    """Places of the alerts sent among the ascending times ``t``."""
    sent, i = [], int(np.searchsorted(t, allowed, side="left"))
    while i < len(t):
        sent.append(i)
        i = int(np.searchsorted(t, t[i] + width, side="left"))
    return np.array(sent, dtype=np.int64)


def _thinned(alerts: DataFrame, engine: str, time_col: str, id_col: str, chunk: int) -> DataFrame:
    """(engine, chunk, t, id): of the alerts of one engine and time the smallest id."""
    t = epoch_us(time_col)
    return (alerts.where(F.col(engine).isNotNull() & F.col(time_col).isNotNull() & F.col(id_col).isNotNull())
            .groupBy(F.col(engine).cast("string").alias("engine"), t.alias("t")).agg(F.min(F.col(id_col)).alias("id"))
            .withColumn("chunk", F.floor(F.col("t") / F.lit(chunk)).cast("long")))


def _clear_of(alerts: DataFrame, sent: DataFrame, width: int) -> DataFrame:
    """``alerts`` that are not closer than ``width`` to one of ``sent`` (engine, t).
    Sent alerts lie a cooldown apart, so a bucket of that width holds two at most."""
    bucket = F.floor(F.col("t") / F.lit(width))
    near = sent.select("engine", F.col("t").alias("other"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    hit = (F.col("a.engine") == F.col("s.engine")) & (F.col("a.b") == F.col("s.b")) & (F.abs(F.col("a.t") - F.col("s.other")) < width)
    return alerts.withColumn("b", bucket).alias("a").join(near.alias("s"), hit, "left_anti").drop("b")


def sent_alerts(thin: DataFrame, width: int) -> DataFrame:
    """(engine, t, id) of the alerts sent, from the output of ``_thinned``."""
    ship_package(thin.sparkSession)
    id_type = thin.schema["id"].dataType.simpleString()

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        until, last = chain_steps(t, width)
        return pd.DataFrame({"engine": [pdf["engine"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "until": [until], "last": [last]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, out = -(1 << 62), []
        pdf = pdf.sort_values("chunk")
        for until, last in zip(pdf["until"], pdf["last"]):
            out.append(allowed)
            i = int(np.searchsorted(until, allowed, side="left"))
            if i < len(last):
                allowed = int(last[i]) + width
        return pd.DataFrame({"engine": pdf["engine"], "chunk": pdf["chunk"], "allowed": out})

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf.iloc[walk(pdf["t"].to_numpy(), int(pdf["allowed"].iloc[0]), width)][["engine", "t", "id"]]

    maps = thin.select("engine", "chunk", "t").groupBy("engine", "chunk").applyInPandas(
        steps, "engine string, chunk long, until array<long>, last array<long>")
    entry = maps.groupBy("engine").applyInPandas(starts, "engine string, chunk long, allowed long")
    return thin.join(entry, ["engine", "chunk"]).groupBy("engine", "chunk").applyInPandas(
        mark, f"engine string, t long, id {id_type}")


def cooldown_batch(alerts: DataFrame, minutes: int = 30, engine: str = "engine_id", time_col: str = "alert_time",
                   id_col: str = "task_id", against: DataFrame | None = None) -> DataFrame:
    """Input alerts; output the same rows with ``sent`` (1 kept, 0 suppressed).
    ``against`` has the columns ``engine``, ``time_col`` of earlier sent alerts."""
    width = minutes * US_PER_MINUTE
    thin = _thinned(alerts, engine, time_col, id_col, max(US_PER_DAY, CHUNK_COOLDOWNS * width))
    if against is not None:
        thin = _clear_of(thin, against.select(F.col(engine).cast("string").alias("engine"), epoch_us(time_col).alias("t")), width)
    sent = sent_alerts(thin, width).select(F.col("engine").alias("__engine"), F.col("t").alias("__t"), F.col("id").alias("__id"),
                                           F.lit(1).alias("sent"))
    same = ((F.col(engine).cast("string") == F.col("__engine")) & (epoch_us(time_col) == F.col("__t"))
            & (F.col(id_col) == F.col("__id")))
    out = alerts.drop("sent").join(sent, same, "left").drop("__engine", "__t", "__id")
    return out.withColumn("sent", F.coalesce(F.col("sent"), F.lit(0)))


def cooldown_reference(times: list[float], minutes: float) -> list[int]:
    """Brute-force greedy rule on one engine's sorted alert times (for tests)."""
    out, last = [], None
    for t in times:
        if last is None or t - last >= minutes:
            out.append(1)
            last = t
        else:
            out.append(0)
    return out
