"""How often the wide tables are read, written and moved: each of these steps grows with the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001


def test_explanations_of_both_models_take_one_pass(spark):
    from taskwatch.catalog import tasks
    from taskwatch.fixed_models import model
    from taskwatch.operators.explain import explanation_rows
    out = explanation_rows(model().explain(model().score(tasks(spark, SF0001))))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") == 1
    assert {r["model"] for r in out.select("model").distinct().collect()} == {"isolation_forest", "autoencoder"}


def test_top_credits_are_ranked_as_a_sort_by_size_and_place():
    from taskwatch.operators.explain import top_credits
    credits = np.random.default_rng(2).integers(-3, 4, (200, 12)).astype(float)
    at, v = top_credits(credits, 5)
    for row, i, x in zip(credits, at, v):
        want = sorted(range(12), key=lambda j: (-abs(row[j]), j))[:5]
        assert list(i) == want and list(x) == [row[j] for j in want]


def test_one_ranking_serves_all_rank_tables(spark, monkeypatch):
    from taskwatch.operators import metrics as M
    from taskwatch.plans.jobs import evaluation_tables
    calls, first = [], M.ranked_counts
    monkeypatch.setattr(M, "ranked_counts", lambda long: calls.append(1) or first(long))
    df = spark.range(200).select(F.lit(0).alias("is_train"), (F.col("id") % 5 == 0).cast("int").alias("is_anomaly"), *[
        (F.abs(F.hash("id", F.lit(i))) % 50 / 50).alias(c) for i, c in enumerate(("anomaly_score", "if_score_norm", "ae_score_norm"))],
        (F.col("id") % 4 == 0).cast("int").alias("anomaly_flag"))
    tables = evaluation_tables(df)
    assert len(calls) == 1
    long = M.long_scores(df, {"ensemble": "anomaly_score", "isolation_forest": "if_score_norm", "autoencoder": "ae_score_norm"})
    assert sorted(tables["rank"].collect()) == sorted(M.rank_metrics(long).collect())


def test_the_fit_writes_the_features_twice_raw_and_scored(spark, monkeypatch):
    from taskwatch.plans import detector, featurize, jobs
    from taskwatch.catalog import tasks
    wide = []
    for module in (detector, featurize, jobs):
        def pin(df, name="pinned", first=module.pin):
            if len(df.columns) > 90:
                wide.append(len(df.columns))
            return first(df, name)
        monkeypatch.setattr(module, "pin", pin)
    fitted = jobs.fit_and_score(tasks(spark, SF0001))
    assert len(wide) == 2
    one = fitted.X.join(fitted.scored.select("task_id", F.col("if_score").alias("s")), "task_id").limit(50).toPandas()
    assert one["s"].to_numpy() == pytest.approx(fitted.detector.forest.score(one[fitted.features.features].to_numpy(dtype=float)))


def test_rolling_tables_join_the_largest_first_and_narrow_rows(spark, monkeypatch):
    from taskwatch.catalog import tasks, rows
    from taskwatch.operators import rolling as R
    seen, first = [], R.attach

    def attach(left, right, keys, *a, **k):
        if "__c" not in keys:
            seen.append((k["rows"], len(left.columns)))
        return first(left, right, keys, *a, **k)

    monkeypatch.setattr(R, "attach", attach)
    t = tasks(spark, SF0001)
    R.with_rolling_features(rows(spark, SF0001), onto=t)
    assert [n for n, _ in seen] == sorted((n for n, _ in seen), reverse=True) and seen[0][1] == len(t.columns)


def test_the_cooldown_stream_reads_the_scored_table_once(spark, monkeypatch):
    from types import SimpleNamespace
    from taskwatch import models_catalog as C
    from taskwatch.config import Params
    scored = spark.createDataFrame([("E1", f"W{i}", 0.5, 1) for i in range(9)], "engine_id string, task_id string, anomaly_score double, anomaly_flag int") \
        .withColumn("planned_start_ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    given = []
    monkeypatch.setattr(C, "fitted", lambda *_: SimpleNamespace(scored=scored, detector=SimpleNamespace(params=Params())))
    first = C.write_in_order
    monkeypatch.setattr(C, "write_in_order", lambda df, *a: given.append(df.inputFiles()) or first(df, *a))
    assert [r["task_id"] for r in C.q_stream_cooldown(spark, SF0001).collect()] == ["W0"]
    assert given[0] and all("stream-alerts" in f for f in given[0])
