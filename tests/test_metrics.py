"""Metrics against brute force and the known-answer cases."""
import numpy as np
import pandas as pd
import pytest

from taskwatch.operators import metrics as M
from taskwatch.operators.prefix import global_prefix


def _auc_brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return 0.5
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def _ap_brute(y, s):
    order = np.argsort(-s, kind="stable")
    ys, ss = y[order], s[order]
    P = ys.sum()
    if P == 0:
        return 0.0
    ap, tp, fp, i = 0.0, 0, 0, 0
    while i < len(ss):
        j = i
        while j < len(ss) and ss[j] == ss[i]:
            j += 1
        dtp = ys[i:j].sum()
        tp += dtp
        fp += (j - i) - dtp
        ap += dtp / P * tp / (tp + fp)
        i = j
    return ap


def _long(spark, y, s):
    pdf = pd.DataFrame({"is_anomaly": y.astype(int), "score": s})
    return M.long_scores(spark.createDataFrame(pdf), {"m": "score"})


@pytest.mark.parametrize("seed", [0, 1])
def test_auc_and_ap_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    y = (rng.random(3000) < 0.1).astype(int)
    s = np.round(rng.random(3000) + y * 0.3, 2)      # many ties
    got = M.rank_metrics(_long(spark, y, s)).first()
    assert got["auc_roc"] == pytest.approx(_auc_brute(y, s), abs=1e-12)
    assert got["auc_pr"] == pytest.approx(_ap_brute(y, s), abs=1e-12)


def test_range_partitioned_prefix_matches_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.permutation(5000).astype(float), "v": rng.integers(0, 5, 5000)})
    out = global_prefix(spark.createDataFrame(pdf), ["k"], ["v"]).toPandas()
    out = out.sort_values("k")
    assert (out["cum_v"].to_numpy() == np.cumsum(out["v"].to_numpy())).all()


def test_one_class_and_tied_scores(spark):
    y = np.zeros(10, dtype=int)
    got = M.rank_metrics(_long(spark, y, np.arange(10.0))).first()
    assert got["auc_roc"] == 0.5 and got["auc_pr"] == 0.0
    got = M.rank_metrics(_long(spark, np.array([0, 1]), np.array([0.3, 0.3]))).first()
    assert got["auc_roc"] == 0.5


def test_no_alerts(spark):
    df = spark.createDataFrame(pd.DataFrame({"is_anomaly": [0, 1, 1], "anomaly_flag": [0, 0, 0]}))
    r = M.classification_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1_score"]) == (0.0, 0.0, 0.0)


def test_text_report_matrix(spark):
    # [[38578, 3272], [2916, 234]] -> precision 0.067, recall 0.074, F1 0.070
    rows = [(0, 0)] * 38578 + [(0, 1)] * 3272 + [(1, 0)] * 2916 + [(1, 1)] * 234
    df = spark.createDataFrame(rows, "is_anomaly int, anomaly_flag int")
    r = M.classification_metrics(df).first()
    assert round(r["precision"], 3) == 0.067
    assert round(r["recall"], 3) == 0.074
    assert round(r["f1_score"], 3) == 0.070
    cm = {(x["actual"], x["predicted"]): x["n"] for x in M.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 38578, (0, 1): 3272, (1, 0): 2916, (1, 1): 234}
