"""Ensemble known answers (FIXTURES §4)."""
import pytest

from taskwatch.config import Params
from taskwatch.operators.ensemble import ensemble, fit_score_range


def _score(spark, rows, ranges=None, params=None):
    df = spark.createDataFrame(rows, "task_id string, if_score double, ae_score double, if_flag int, ae_flag int")
    return {r["task_id"]: r for r in ensemble(df, ranges, params).collect()}


def test_constant_score_normalises_to_zero(spark):
    out = _score(spark, [("a", 0.4, 1.0, 0, 0), ("b", 0.4, 2.0, 0, 0)])
    assert out["a"]["if_score_norm"] == 0.0 and out["b"]["if_score_norm"] == 0.0


def test_both_scores_zero(spark):
    out = _score(spark, [("a", 0.0, 0.0, 0, 0)], {"if_score": (0.0, 1.0), "ae_score": (0.0, 1.0)})
    assert out["a"]["anomaly_score"] == pytest.approx(0.0)
    assert out["a"]["anomaly_flag"] == 0


def test_agreement_only(spark):
    out = _score(spark, [("a", 0.15, 0.15, 1, 1)], {"if_score": (0.0, 1.0), "ae_score": (0.0, 1.0)})
    r = out["a"]
    assert r["anomaly_score"] == pytest.approx(0.15, abs=1e-5)
    assert (r["primary_flag"], r["agreement_flag"], r["anomaly_flag"]) == (0, 1, 1)


def test_fit_range_clips_single_row(spark):
    # one-row scoring with the fitted range gives the batch answer, not 0
    batch = spark.createDataFrame([("a", 0.2, 1.0, 0, 0), ("b", 0.8, 3.0, 1, 1)],
                                  "task_id string, if_score double, ae_score double, if_flag int, ae_flag int")
    rng = fit_score_range(batch)
    full = {r["task_id"]: r["anomaly_score"] for r in ensemble(batch, rng).collect()}
    one = ensemble(batch.where("task_id = 'b'"), rng).first()["anomaly_score"]
    assert one == pytest.approx(full["b"])
    assert ensemble(batch.where("task_id = 'b'"), None, Params(normalize_mode="batch")).first()["anomaly_score"] == 0.0


def test_single_task_lookup(spark):
    from taskwatch.operators.ensemble import single
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "task_id string, x double")
    assert single(df, "a").first()["x"] == 1.0
    with pytest.raises(ValueError):
        single(df, "b")          # two rows
    with pytest.raises(ValueError):
        single(df, "zzz")        # none
