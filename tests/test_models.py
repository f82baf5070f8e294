"""Isolation forest and reconstruction against brute-force numpy."""
import numpy as np
import pandas as pd
import pytest

from taskwatch.config import Params
from taskwatch.operators.forest import c_factor, fit_forest
from taskwatch.operators.reconstruct import fit_reconstruction

P = Params(n_trees=60)


def _frame(spark, X):
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(X.shape[1])])
    pdf.insert(0, "task_id", [f"t{i}" for i in range(len(pdf))])
    return spark.createDataFrame(pdf), list(pdf.columns[1:])


def test_forest_scores_outlier_higher(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(2000, 5))
    X[0] = 8.0
    df, feats = _frame(spark, X)
    model = fit_forest(df, feats, P)
    s = model.score(X)
    assert ((s > 0) & (s <= 1)).all()
    assert s[0] == s.max()
    assert s[0] > 0.6 and np.median(s) < 0.5


def test_forest_is_repeatable(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(500, 4))
    df, feats = _frame(spark, X)
    a = fit_forest(df, feats, P).score(X)
    b = fit_forest(df.repartition(3), feats, P).score(X)
    assert np.allclose(a, b)


def test_attributions_sum_to_path_length_gap(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(800, 4))
    df, feats = _frame(spark, X)
    m = fit_forest(df, feats, P)
    contrib = m.contributions(X[:20])
    root = m.value[:, 0].mean()
    assert np.allclose(contrib.sum(axis=1), m.path_length(X[:20]) - root)


def test_c_factor():
    assert c_factor([1])[0] == 0 and c_factor([2])[0] == 1
    assert c_factor([256])[0] == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_reconstruction_matches_numpy_pca(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(1000, 12)) @ rng.normal(size=(12, 12))
    df, feats = _frame(spark, X)
    m = fit_reconstruction(df, feats, Params(n_components=3))
    mu = X.mean(axis=0)
    C = np.cov(X - mu, rowvar=False)
    w, V = np.linalg.eigh(C)
    V = V[:, np.argsort(w)[::-1][:3]]
    R = (X - mu) - (X - mu) @ V @ V.T
    assert np.allclose(m.errors(X), np.mean(R * R, axis=1), rtol=1e-6, atol=1e-9)


def test_autoencoder_gradients_and_training(spark):
    from taskwatch.operators.autoencoder import (fit_autoencoder, flatten, forward, gradients,
                                                 init_weights, unflatten)
    rng = np.random.default_rng(5)
    X = rng.normal(size=(32, 6))
    ws = init_weights(6, 1)
    g, loss = gradients(ws, X, None, 0.0)
    # finite-difference check on a few weights
    v = flatten(ws)
    gv = flatten(g)
    for i in rng.choice(len(v), 5, replace=False):
        e = np.zeros_like(v); e[i] = 1e-6
        up = np.mean((forward(unflatten(v + e, 6), X)[0][-1] - X) ** 2)
        dn = np.mean((forward(unflatten(v - e, 6), X)[0][-1] - X) ** 2)
        assert (up - dn) / 2e-6 == pytest.approx(gv[i], rel=1e-4, abs=1e-8)
    # a short distributed fit lowers the validation error
    Z = rng.normal(size=(600, 2))
    Xs = np.hstack([Z, Z @ rng.normal(size=(2, 4))])
    df, feats = _frame(spark, Xs)
    m = fit_autoencoder(df, feats, Params(ae_epochs=8, ae_patience=8, ae_dropout=0.0, ae_learning_rate=5e-3),
                        time_col="none", val_fraction=0.0)
    base = np.mean(np.mean((Xs - Xs.mean(axis=0)) ** 2, axis=1))
    assert np.mean(m.errors(Xs)) < base


def test_explanations_against_sorting(spark):
    """Top lists from the JVM equal a stable sort of the model's credits, ties included."""
    from taskwatch.operators.explain import forest_top_column, reconstruction_top_column
    rng = np.random.default_rng(6)
    X = rng.normal(size=(300, 6)).round(1)
    X[:, 5] = 0.0                                 # never split on: credit 0, ties in feature order
    df, feats = _frame(spark, X)
    forest, recon = fit_forest(df, feats, P), fit_reconstruction(df, feats, Params(n_components=2))
    for top, credit in ((forest_top_column(forest, feats, 6), forest.contributions(X)),
                        (reconstruction_top_column(recon, feats, 6), recon.residuals(X))):
        got = {r["task_id"]: r["top"] for r in df.select("task_id", top.alias("top")).collect()}
        for i in range(len(X)):
            order = np.argsort(-np.abs(credit[i]), kind="stable")
            assert [c["feature"] for c in got[f"t{i}"]] == [feats[j] for j in order]
            assert np.allclose([c["signed_contribution"] for c in got[f"t{i}"]], credit[i][order])
    empty = df.limit(0).select(forest_top_column(forest, feats).alias("top"))
    assert empty.count() == 0


def test_single_result_is_the_row_of_the_batch(spark):
    from conftest import SF0001
    from taskwatch.catalog import tasks
    from taskwatch.fixed_models import model
    t = tasks(spark, SF0001)
    batch = {r["task_id"]: r["result"].asDict(recursive=True) for r in model().results(t).collect()}
    for task in list(batch)[:3]:
        one = model().single_result(t, task)
        assert one == batch[task] and len(one["explainability"]["autoencoder"]) == 2
    with pytest.raises(ValueError):
        model().single_result(t, "none such")
