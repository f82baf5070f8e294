"""Known-answer cases for the row features and the rolling windows (FIXTURES §4)."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import task_rows
from taskwatch.operators.rolling import rolling_stats
from taskwatch.plans.featurize import row_features

T0 = dt.datetime(2024, 1, 1, 8, 0)


def _stats(spark, rows, prefix="task"):
    df = row_features(task_rows(spark, rows), {"tech_grade": ["A", "B", "C"], "shift": ["D", "N"]})
    st = rolling_stats(df, prefix)
    return df.select("task_id", "task_name", "planned_start_ts").join(
        st, ["task_name", "planned_start_ts"]).toPandas().set_index("task_id")


def test_one_row_window(spark):
    out = _stats(spark, [{"task_id": "a", "planned_start_ts": T0, "actual_minutes": 90}])
    assert out.loc["a", "task_actual_minutes_mean"] == 90
    assert out.loc["a", "task_actual_minutes_median"] == 90
    # std of one task is empty; nothing earlier to fill from, the pipeline fills 0
    assert out.loc["a", "task_actual_minutes_std"] != out.loc["a", "task_actual_minutes_std"] or \
        out.loc["a", "task_actual_minutes_std"] is None


def test_window_edge_seven_days(spark):
    rows = [{"task_id": "old", "planned_start_ts": T0, "actual_minutes": 10},
            {"task_id": "new", "planned_start_ts": T0 + dt.timedelta(days=7), "actual_minutes": 30}]
    out = _stats(spark, rows)
    assert out.loc["new", "task_actual_minutes_mean"] == 30   # the older task is outside
    assert out.loc["new", "task_snag_count_sum"] == 0
    rows[1]["planned_start_ts"] = T0 + dt.timedelta(days=7) - dt.timedelta(microseconds=1)
    out = _stats(spark, rows)
    assert out.loc["new", "task_actual_minutes_mean"] == 20   # one microsecond inside


def test_tied_starts_see_each_other(spark):
    rows = [{"task_id": "a", "planned_start_ts": T0, "actual_minutes": 10},
            {"task_id": "b", "planned_start_ts": T0, "actual_minutes": 20}]
    out = _stats(spark, rows)
    assert out.loc["a", "task_actual_minutes_mean"] == 15
    assert out.loc["b", "task_actual_minutes_mean"] == 15
    assert out.loc["a", "task_actual_minutes_std"] == pytest.approx(7.0710678, rel=1e-6)


def test_forward_fill_of_empty_std(spark):
    rows = [{"task_id": "a", "planned_start_ts": T0, "actual_minutes": 10},
            {"task_id": "b", "planned_start_ts": T0 + dt.timedelta(hours=1), "actual_minutes": 20},
            {"task_id": "c", "planned_start_ts": T0 + dt.timedelta(days=10), "actual_minutes": 50}]
    out = _stats(spark, rows)
    # c is alone in its frame: its std is the previous bucket's std
    assert out.loc["c", "task_actual_minutes_std"] == pytest.approx(out.loc["b", "task_actual_minutes_std"])


def test_zero_planned_minutes(spark):
    df = row_features(task_rows(spark, [{"task_id": "z", "planned_start_ts": T0, "planned_minutes": 0,
                                         "actual_minutes": 30}]),
                      {"tech_grade": ["A"], "shift": ["D"]})
    r = df.select("duration_ratio", "duration_outlier", "tech_efficiency").first()
    assert r["duration_ratio"] is None
    assert r["duration_outlier"] == 0


def test_day_shift_only_batch_has_night_column(spark):
    df = row_features(task_rows(spark, [{"task_id": "d", "planned_start_ts": T0, "shift": "D"}]),
                      {"tech_grade": ["A", "B", "C"], "shift": ["D", "N"]})
    r = df.select("shift_D", "shift_N").first()
    assert (r["shift_D"], r["shift_N"]) == (1, 0)


def test_shuffled_input_same_output(spark):
    from conftest import SF001
    from taskwatch import catalog as C
    r = C.rows(spark, SF001)
    a = rolling_stats(r, "module")
    b = rolling_stats(r.orderBy(F.rand(7)).repartition(5), "module")
    key = ["module_id", "planned_start_ts"]
    pa = a.toPandas().sort_values(key).reset_index(drop=True)
    pb = b.toPandas().sort_values(key).reset_index(drop=True)
    assert len(pa) == len(pb)
    assert (pa[key] == pb[key]).all().all()
    vals = [c for c in pa.columns if c not in key]
    # only the summation order may differ
    assert np.allclose(pa[vals].to_numpy(float), pb[vals].to_numpy(float), rtol=1e-12, atol=1e-9,
                       equal_nan=True)


def test_second_grain_starts_against_brute_force(spark):
    """Many buckets a frame: running totals and the wavelet matrix, for a key with
    most rows and small ones, with ties, nulls and frames over chunk borders."""
    import datetime as dt
    import numpy as np
    import pandas as pd
    from taskwatch.operators import rolling as R
    rng = np.random.default_rng(8)
    n = 4000
    base = dt.datetime(2024, 1, 3)
    key = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b", "c"], n))
    sec = rng.integers(0, 24 * 86400, n) // rng.choice([1, 3600], n) * 1
    val = np.where(rng.random(n) < 0.1, np.nan, rng.choice([1.5, 2.0, 7.25, 90.0, 400.0], n) + rng.integers(0, 50, n))
    pdf = pd.DataFrame({"k": key, "planned_start_ts": [base + dt.timedelta(seconds=int(s)) for s in sec], "v": val})
    df = spark.createDataFrame(pdf).replace(float("nan"), None).withColumn("planned_start_ts", F.col("planned_start_ts").cast("timestamp_ntz"))
    aggs = ["mean", "std", "median", "min", "max", "sum"]
    got = R.rolling_stats(df, "x", spec=("k", [("v", aggs)])).toPandas()
    at = {(r.k, r.planned_start_ts): r for r in got.itertuples()}
    assert len(at) == len(pdf[["k", "planned_start_ts"]].drop_duplicates()) and len(pdf[pdf.k == "hot"]) > 2 * R.DIRECT
    for k, g in pdf.groupby("k"):
        g = g.sort_values("planned_start_ts")
        last = {}
        for t in g["planned_start_ts"].drop_duplicates():
            x = g.loc[(g.planned_start_ts > t - pd.Timedelta(days=7)) & (g.planned_start_ts <= t), "v"].dropna()
            want = {"mean": x.mean(), "std": x.std(), "median": x.median(), "min": x.min(), "max": x.max(), "sum": x.sum() if len(x) else np.nan}
            last |= {a: w for a, w in want.items() if not np.isnan(w)}
            for a in aggs:
                assert getattr(at[k, t], f"x_v_{a}") == pytest.approx(last.get(a, np.nan), rel=1e-9, abs=1e-9, nan_ok=True), (k, t, a)


def test_kth_values_against_sorting():
    import numpy as np
    from taskwatch.operators.rolling import kth_values
    rng = np.random.default_rng(1)
    for values in (1, 2, 3, 17, 64):
        rank, weight = rng.integers(0, values, 200), rng.integers(1, 4, 200)
        start = rng.integers(0, 199, 300)
        end = np.array([rng.integers(s + 1, 201) for s in start])
        spread = [np.sort(np.repeat(rank[a:b], weight[a:b])) for a, b in zip(start, end)]
        k = np.array([rng.integers(0, len(s)) for s in spread])
        assert kth_values(rank, weight, start, end, k).tolist() == [int(s[i]) for s, i in zip(spread, k)]
