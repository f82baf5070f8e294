"""Alert cooldown: maps of chunks, composed, against the greedy rule."""
import random

import pandas as pd
from pyspark.sql import functions as F

from taskwatch.operators.cooldown import cooldown_batch, cooldown_reference


def _alerts(spark, pdf):
    pdf = pdf.copy()
    pdf["alert_time"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["m"], unit="min")
    return spark.createDataFrame(pdf[["engine_id", "task_id", "alert_time"]]) \
        .withColumn("alert_time", F.col("alert_time").cast("timestamp_ntz"))


def test_fixture_cooldown_30(spark):
    pdf = pd.DataFrame({"engine_id": ["E"] * 5, "task_id": list("abcde"), "m": [0, 10, 30, 45, 65]})
    out = cooldown_batch(_alerts(spark, pdf), 30).toPandas().sort_values("task_id")
    assert list(out["sent"]) == [1, 0, 1, 0, 1]


def test_random_against_greedy(spark):
    random.seed(5)
    rows = []
    for e in range(3):
        t = 0
        for i in range(300):
            t += random.choice([0, 1, 10, 29, 30, 31, 90])
            rows.append((f"E{e}", f"A{e}_{i:04d}", t))
    pdf = pd.DataFrame(rows, columns=["engine_id", "task_id", "m"])
    got = dict(cooldown_batch(_alerts(spark, pdf), 30).select("task_id", "sent").toPandas().values)
    exp = {}
    for _, g in pdf.sort_values(["engine_id", "m", "task_id"]).groupby("engine_id"):
        exp.update(zip(g["task_id"], cooldown_reference(list(g["m"]), 30)))
    assert got == exp


def test_hot_engine_ties_and_incomplete_alerts(spark):
    """One engine with a third of all alerts, many of them at the same time, over
    many chunks; alerts without engine, time or id are never sent."""
    random.seed(9)
    rows = []
    for i in range(3000):
        engine = "HOT" if i % 3 == 0 else f"E{i % 40}"
        rows.append((engine, f"A{i:05d}", random.choice([random.randrange(20 * 1440), 30 * random.randrange(960)])))
    pdf = pd.DataFrame(rows, columns=["engine_id", "task_id", "m"])
    exp = {}
    for _, g in pdf.sort_values(["engine_id", "m", "task_id"]).groupby("engine_id"):
        exp.update(zip(g["task_id"], cooldown_reference(list(g["m"]), 30)))
    df = _alerts(spark, pdf)
    odd = df.limit(1).select(F.lit(None).cast("string").alias("engine_id"), "task_id", "alert_time").unionByName(
        df.limit(1).select("engine_id", F.lit(None).cast("string").alias("task_id"), "alert_time")).unionByName(
        df.limit(1).select("engine_id", F.lit("X").alias("task_id"), F.lit(None).cast("timestamp_ntz").alias("alert_time")))
    out = cooldown_batch(df.withColumn("sent", F.lit(7)), 30).select("task_id", "sent").toPandas()
    assert dict(out.values) == exp
    out = cooldown_batch(odd, 30).toPandas()
    assert len(out) == 3 and not out["sent"].any()
    assert cooldown_batch(df.limit(0), 30).count() == 0


def test_alerts_against_those_sent_before(spark):
    """Late alerts: judged by their neighbours that were sent already."""
    from taskwatch.streaming.cooldown import allowed
    random.seed(11)
    sent = sorted(random.sample(range(0, 3000, 45), 20))
    new = sorted(random.sample(range(3000), 150))
    pdf = pd.DataFrame([("E", f"A{m:04d}", m) for m in new], columns=["engine_id", "task_id", "m"])
    old = pd.DataFrame([("E", f"S{m}", m) for m in sent], columns=["engine_id", "task_id", "m"])
    out = cooldown_batch(_alerts(spark, pdf), 30, against=_alerts(spark, old)).toPandas().sort_values("task_id")
    assert [bool(x) for x in out["sent"]] == allowed(new, list(sent), 30)


def test_chunk_maps_compose_to_one_walk():
    import numpy as np
    from taskwatch.operators.cooldown import chain_steps, walk
    random.seed(1)
    for _ in range(100):
        t = np.array(sorted(set(random.choices(range(2000), k=120))))
        allowed, got = -10**9, []
        for lo in range(0, 2000, 240):
            part = t[(t >= lo) & (t < lo + 240)]
            got += part[walk(part, allowed, 30)].tolist()
            until, last = chain_steps(part, 30)
            i = int(np.searchsorted(until, allowed, side="left"))
            if i < len(last):
                allowed = int(last[i]) + 30
        assert got == t[walk(t, -10**9, 30)].tolist()


def test_stream_cooldown_matches_batch(spark):
    from conftest import SF0001
    from taskwatch import models_catalog as MC
    batch = MC.q_cooldown_alerts(spark, SF0001).where("sent = 1").select("task_id")
    stream = MC.q_stream_cooldown(spark, SF0001).select("task_id")
    assert batch.count() == stream.count()
    assert batch.exceptAll(stream).count() == 0


def test_late_alerts_are_judged_by_their_neighbours():
    from taskwatch.streaming.cooldown import allowed
    sent = []
    assert allowed([0, 10, 200], sent, 30) == [True, False, True]
    assert allowed([20, 60, 175, 190], sent, 30) == [False, True, False, False] and sent == [0, 60, 200]
    random.seed(2)
    times = sorted(random.choices(range(2000), k=300))
    assert allowed(times, [], 30) == [bool(x) for x in cooldown_reference(times, 30)]
