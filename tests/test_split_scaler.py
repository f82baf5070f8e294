"""Time split and robust scaler."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taskwatch.operators.scaling import apply_robust_scaler, fit_robust_scaler
from taskwatch.operators.split import time_split

T0 = dt.datetime(2024, 1, 1)


def test_split_exact_count_with_ties(spark):
    rows = [(f"t{i:03d}", T0 + dt.timedelta(hours=i // 7)) for i in range(103)]
    df = spark.createDataFrame(rows, "task_id string, planned_start_ts timestamp_ntz")
    out = time_split(df, 0.2).toPandas().sort_values(["planned_start_ts", "task_id"])
    assert out["is_train"].sum() == int(103 * 0.8)
    assert list(out["is_train"]) == [1] * 82 + [0] * 21


def test_scaler_constant_feature_and_numpy(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=501), "c": np.full(501, 3.0)})
    df = spark.createDataFrame(pdf)
    params = fit_robust_scaler(df, ["a", "c"])
    q1, med, q3 = np.percentile(pdf["a"], [25, 50, 75])
    assert params["a"] == (pytest.approx(med), pytest.approx(q3 - q1))
    assert params["c"] == (3.0, 1.0)                       # IQR 0 -> divide by 1
    out = apply_robust_scaler(df, params, ["a", "c"]).toPandas()
    assert np.allclose(out["c"], 0.0)


def test_tasks_without_start_are_in_neither_part(spark):
    rows = [(f"t{i:03d}", T0 + dt.timedelta(hours=i) if i % 10 else None) for i in range(100)]
    out = time_split(spark.createDataFrame(rows, "task_id string, planned_start_ts timestamp_ntz"), 0.2).toPandas()
    assert len(out) == 100 and (out["is_train"] == 1).sum() == 72 and (out["is_train"] == 0).sum() == 18
    assert out.loc[out["planned_start_ts"].isna(), "is_train"].isna().all()


def test_exact_quantiles_of_groups_with_ties_and_nulls(spark):
    from taskwatch.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"feature": rng.choice(["a", "b", "c"], 3000, p=[.8, .19, .01]),
                        "value": rng.integers(0, 40, 3000).astype(float)})
    pdf.loc[::17, "value"] = None
    df = spark.createDataFrame(pdf.astype({"value": object}).where(pdf.notna(), None), "feature string, value double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.93, 1.0]
    got = {r["feature"]: r["q"] for r in exact_quantiles(df, probs).collect()}
    for f, x in pdf.dropna().groupby("feature")["value"]:
        assert got[f] == pytest.approx(list(np.quantile(x, probs)))


def test_column_quantiles_against_numpy(spark, monkeypatch):
    """Ties, skew, nulls, constants, infinities, an empty column, and brackets too narrow to hold a rank."""
    from taskwatch.operators import quantiles as Q
    rng = np.random.default_rng(3)
    n, probs = 5000, [0.0, 0.07, 0.25, 0.5, 0.75, 0.93, 1.0]
    pdf = pd.DataFrame({
        "normal": rng.normal(size=n), "skew": np.exp(rng.normal(size=n) * 3), "few": rng.integers(0, 4, n).astype(float),
        "constant": 7.0, "holes": np.where(rng.random(n) < 0.6, np.nan, rng.random(n)), "mostly": np.where(rng.random(n) < 0.9, 1.0, rng.random(n)),
        "far": np.where(rng.random(n) < 0.01, -np.inf, rng.normal(size=n)), "whole": rng.integers(0, 10**6, n).astype(float)})
    df = spark.createDataFrame(pdf).replace(float("nan"), None).withColumn("none", F.lit(None).cast("double")).repartition(7)
    columns = list(pdf.columns)

    def check():
        got = Q.column_quantiles(df, [*columns, "none"], probs)
        assert got["none"] is None
        for c in columns:
            x = pdf[c].dropna().sort_values().to_numpy()
            for p, q in zip(probs, got[c]):
                pos = (len(x) - 1) * p
                lo, hi = x[int(np.floor(pos))], x[int(np.ceil(pos))]
                want = lo if lo == hi else (np.ceil(pos) - pos) * lo + (pos - np.floor(pos)) * hi
                assert q == want, (c, p)

    check()
    monkeypatch.setattr(Q, "ACCURACY", 50)                      # a coarse summary: wide brackets
    check()
    first = Q._brackets
    monkeypatch.setattr(Q, "_brackets", lambda *a: (first(*a)[0], {c: [(b[0][0], b[0][0])] * len(probs) for c, b in first(*a)[1].items()}))
    check()                                                     # brackets that miss: ranked whole
    assert Q.column_quantiles(df.limit(0), ["few"], [0.5]) == {"few": None}
    one = Q.column_quantiles(df.limit(1), ["constant"], [0.1, 0.9])
    assert one == {"constant": [7.0, 7.0]}


def test_summaries_hold_the_rank_and_stay_small():
    """The error that a merged summary states bounds how far it falls short, and
    its size does not grow with the values."""
    from taskwatch.operators import quantiles as Q
    rng = np.random.default_rng(5)
    for draw in (lambda: rng.normal(size=10_000), lambda: rng.integers(0, 50, 10_000).astype(float), lambda: np.full(10_000, 3.0)):
        held, seen = Q._Summary(), []
        for _ in range(70):
            seen.append(draw())
            held.add(seen[-1])
        value, weight, error = held.whole()
        x = np.sort(np.concatenate(seen))
        short = np.searchsorted(x, value, side="right") - np.cumsum(weight)
        before = np.searchsorted(x, value, side="left") - (np.cumsum(weight) - weight)
        assert weight.sum() == len(x) and short.min() >= 0 and max(short.max(), before.max()) <= error + weight.max()
        assert short.max() <= error <= len(x) / 500 and len(value) <= Q.ACCURACY // 2 + 1


def test_brackets_are_narrow_and_hold_the_quantiles(spark, monkeypatch):
    from taskwatch.operators import quantiles as Q
    monkeypatch.setattr(Q, "ACCURACY", 100)
    df = spark.range(0, 60_000, 1, 6).selectExpr("cast(hash(id) as double) a", "cast(id % 7 as double) b")
    n, found = Q._brackets(df, ["a", "b"], [0.25, 0.5, 0.75])
    assert n == {"a": 60_000, "b": 60_000}
    for c, x in df.toPandas().items():
        x = np.sort(x)
        for (lo, hi), p in zip(found[c], [0.25, 0.5, 0.75]):
            assert lo <= x[int(59_999 * p)] and x[int(np.ceil(59_999 * p))] <= hi
            assert np.mean((x >= lo) & (x <= hi)) <= (0.12 if c == "a" else 0.3)
