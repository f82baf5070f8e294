"""Reconstruction model.

The reference trains a dense autoencoder with an 8-unit bottleneck. Here the
default is its linear counterpart: the top-8 principal subspace of the
centred training features (Baldi and Hornik 1989: a linear autoencoder with
squared loss learns exactly this subspace). Fit is one distributed pass:
every partition computes (n, sum x, X^T X) with numpy in ``mapInArrow``;
the partials are summed in a two-level tree (``coalesce`` without shuffle,
then a final sum), so only d x d numbers per level move (d = 96). The
eigen-decomposition of the d x d covariance runs on the driver.

Row error (R4) = mean over features of (x - x_hat)^2 with
x_hat = mu + V V^T (x - mu). Eigenvector signs do not change it.
Threshold (R5) = max(90th percentile, mean + 2 * population std) of the
training errors; flag (R6) = error > threshold. Top-k (R7) ranks features by
|x - x_hat|.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from taskwatch.config import Params
from taskwatch.operators.quantiles import quantile_of
from taskwatch.session import broadcast_model


@dataclass
class ReconstructionModel:
    features: list[str]
    mean: np.ndarray        # [d]
    components: np.ndarray  # [d, k]
    threshold: float | None = None

    def reconstruct(self, X: np.ndarray) -> np.ndarray:
        Z = (X - self.mean) @ self.components
        return self.mean + Z @ self.components.T

    def errors(self, X: np.ndarray) -> np.ndarray:
        R = X - self.reconstruct(X)
        return np.mean(R * R, axis=1)

    def residuals(self, X: np.ndarray) -> np.ndarray:
        return X - self.reconstruct(X)


def gram_stats(X: DataFrame, features: list[str], fan_in: int = 64) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, sum x, X^T X) of the feature columns in one pass."""
    d = len(features)

    def partial(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            M = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += M.shape[0]
            s += M.sum(axis=0)
            g += M.T @ M
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])],
                                         names=["n", "s", "g"])

    def combine(batches):
        n, s, g = 0, np.zeros(d), np.zeros(d * d)
        for pdf in batches:
            n += int(pdf["n"].sum())
            for a, b in zip(pdf["s"], pdf["g"]):
                s += np.asarray(a)
                g += np.asarray(b)
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.tolist()]})

    schema = "n long, s array<double>, g array<double>"
    parts = X.select(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]) \
        .mapInArrow(partial, schema)
    level = parts.coalesce(fan_in).mapInPandas(combine, schema)   # no shuffle
    n, s, g = 0, np.zeros(d), np.zeros(d * d)
    for r in level.collect():                                      # at most fan_in rows
        n += r["n"]
        s += np.asarray(r["s"])
        g += np.asarray(r["g"])
    return n, s, g.reshape(d, d)


def fit_reconstruction(X: DataFrame, features: list[str], params: Params | None = None) -> ReconstructionModel:
    p = params or Params()
    from taskwatch.session import ship_package
    ship_package(X.sparkSession)
    n, s, g = gram_stats(X, features)
    mean = s / max(n, 1)
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    w, V = np.linalg.eigh(cov)
    k = min(p.n_components, len(features))
    comps = V[:, np.argsort(w)[::-1][:k]]
    return ReconstructionModel(features, mean, comps)


def error_column(model: ReconstructionModel, features: list[str]) -> Column:
    """R4 as a pandas UDF over the feature columns."""
    bc = broadcast_model(model)

    @F.pandas_udf(T.DoubleType())
    def ae_error(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(bc.value.errors(X))

    return ae_error(*[F.col(f).cast("double") for f in features])


def fit_error_threshold(scored: DataFrame, col: str = "ae_score", params: Params | None = None) -> float:
    """R5 = greatest(percentile(e, 0.9), avg(e) + 2 * stddev_pop(e))."""
    p = params or Params()
    q = quantile_of(scored, col, p.recon_percentile)
    if q is None:
        return float("inf")
    row = scored.agg((F.avg(col) + F.lit(p.recon_std_factor) * F.stddev_pop(col)).alias("t")).first()
    return max(q, float(row["t"]))
