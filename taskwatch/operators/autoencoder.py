"""Nonlinear reconstruction model (R1-R3), opt-in with ``Params(recon_model="mlp")``.

Shape, activations, dropout, optimiser, batch size, epochs and patience
follow the reference configuration (see ``config.Params``): d -> 128 -> 64 ->
32 -> 8 -> 32 -> 64 -> 128 -> d, ReLU, dropout 0.3 while training, linear
output, Adam 5e-4, batch 64, up to 150 epochs, early stop after 15 epochs
without a better validation loss, best weights kept. Validation rows are the
last 20 % of the training rows in time.

Distributed training by parameter averaging: every epoch the weights are
broadcast, each partition runs mini-batch Adam over its own rows for one
pass (``mapInPandas``), and the partition weights are averaged (weighted by
rows) through a two-level sum (``coalesce`` then collect, at most ``fan_in``
rows of parameters). The same pass measures the validation loss of the
incoming weights. Only parameters (about 46,000 numbers) reach the driver.
This converges differently from one sequential Keras run; it is the usual
way to train such a network over partitioned data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from taskwatch.config import Params
from taskwatch.session import pin, ship_package

HIDDEN = [128, 64, 32]
BOTTLENECK = 8


def layer_sizes(d: int) -> list[int]:
    return [d] + HIDDEN + [BOTTLENECK] + HIDDEN[::-1] + [d]


def init_weights(d: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    sizes = layer_sizes(d)
    out = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        lim = np.sqrt(6.0 / (a + b))              # Glorot uniform, as Keras defaults
        out += [rng.uniform(-lim, lim, size=(a, b)), np.zeros(b)]
    return out


def flatten(ws: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in ws])


def unflatten(v: np.ndarray, d: int) -> list[np.ndarray]:
    sizes, out, i = layer_sizes(d), [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append(v[i:i + a * b].reshape(a, b)); i += a * b
        out.append(v[i:i + b]); i += b
    return out


def forward(ws, X, rng=None, dropout=0.0):
    acts, masks, h = [X], [], X
    n_layers = len(ws) // 2
    for k in range(n_layers):
        z = h @ ws[2 * k] + ws[2 * k + 1]
        if k == n_layers - 1:
            h = z
            masks.append(None)
        else:
            h = np.maximum(z, 0.0)
            m = None
            # dropout after every hidden layer except the bottleneck
            if rng is not None and dropout > 0 and k != len(HIDDEN):
                m = (rng.random(h.shape) >= dropout) / (1.0 - dropout)
                h = h * m
            masks.append(m)
        acts.append(h)
    return acts, masks


def gradients(ws, X, rng, dropout):
    acts, masks = forward(ws, X, rng, dropout)
    n_layers = len(ws) // 2
    grads = [None] * len(ws)
    delta = 2.0 * (acts[-1] - X) / (X.shape[0] * X.shape[1])   # d MSE / d output
    for k in range(n_layers - 1, -1, -1):
        grads[2 * k] = acts[k].T @ delta
        grads[2 * k + 1] = delta.sum(axis=0)
        if k > 0:
            delta = delta @ ws[2 * k].T
            if masks[k - 1] is not None:
                delta = delta * masks[k - 1]
            delta = delta * (acts[k] > 0)
    return grads, float(np.mean((acts[-1] - X) ** 2))


@dataclass
class AutoencoderModel:
    features: list[str]
    weights: list[np.ndarray]
    threshold: float | None = None
    history: list | None = None

    def reconstruct(self, X: np.ndarray) -> np.ndarray:
        return forward(self.weights, X)[0][-1]

    def residuals(self, X: np.ndarray) -> np.ndarray:
        return X - self.reconstruct(X)

    def errors(self, X: np.ndarray) -> np.ndarray:
        r = self.residuals(X)
        return np.mean(r * r, axis=1)


def fit_autoencoder(X: DataFrame, features: list[str], params: Params | None = None,
                    time_col: str = "planned_start_ts", fan_in: int = 64,
                    val_fraction: float = 0.2) -> AutoencoderModel:
    p = params or Params()
    spark = X.sparkSession
    ship_package(spark)
    d = len(features)
    cols = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    data = X.select(*cols, F.col(time_col).alias("__ts") if time_col in X.columns else F.lit(0).alias("__ts"))
    if time_col in X.columns:
        cut = data.agg(F.percentile_approx(F.timestamp_diff("MICROSECOND", F.expr(
            "TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("__ts")), 1 - val_fraction, 10000)).first()[0]
        us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("__ts"))
        data = data.withColumn("__val", (us > F.lit(cut)).cast("int"))
    else:
        data = data.withColumn("__val", F.lit(0))
    data = pin(data.drop("__ts"), "ae-train")
    ws = init_weights(d, p.seed)
    best, best_loss, wait, history = [w.copy() for w in ws], np.inf, 0, []
    lr, b1, b2, eps = p.ae_learning_rate, 0.9, 0.999, 1e-7
    schema = "n long, val_n long, val_sse double, w array<double>"

    for epoch in range(p.ae_epochs):
        flat = flatten(ws)
        bc = spark.sparkContext.broadcast(flat)

        def train_partition(batches, epoch=epoch):
            wv = bc.value
            local = unflatten(wv.copy(), d)
            m = [np.zeros_like(w) for w in local]
            v = [np.zeros_like(w) for w in local]
            step, n, val_n, val_sse = 0, 0, 0, 0.0
            from pyspark import TaskContext
            ctx = TaskContext.get()
            rng = np.random.default_rng([p.seed, epoch, ctx.partitionId() if ctx else 0])
            start = unflatten(wv, d)
            for pdf in batches:
                M = pdf[features].to_numpy(dtype=float)
                is_val = pdf["__val"].to_numpy() == 1
                if is_val.any():
                    R = forward(start, M[is_val])[0][-1] - M[is_val]
                    val_sse += float(np.sum(np.mean(R * R, axis=1)))
                    val_n += int(is_val.sum())
                T = M[~is_val]
                T = T[rng.permutation(len(T))]
                for s0 in range(0, len(T), p.ae_batch_size):
                    g, _ = gradients(local, T[s0:s0 + p.ae_batch_size], rng, p.ae_dropout)
                    step += 1
                    for i in range(len(local)):
                        m[i] = b1 * m[i] + (1 - b1) * g[i]
                        v[i] = b2 * v[i] + (1 - b2) * g[i] * g[i]
                        mh = m[i] / (1 - b1 ** step)
                        vh = v[i] / (1 - b2 ** step)
                        local[i] -= lr * mh / (np.sqrt(vh) + eps)
                n += len(T)
            yield pd.DataFrame({"n": [n], "val_n": [val_n], "val_sse": [val_sse],
                                "w": [(flatten(local) * n).tolist()]})

        def combine(batches):
            n, val_n, sse, acc = 0, 0, 0.0, None
            for pdf in batches:
                for _, r in pdf.iterrows():
                    n += int(r["n"]); val_n += int(r["val_n"]); sse += float(r["val_sse"])
                    w = np.asarray(r["w"])
                    acc = w if acc is None else acc + w
            if acc is not None:
                yield pd.DataFrame({"n": [n], "val_n": [val_n], "val_sse": [sse], "w": [acc.tolist()]})

        parts = data.mapInPandas(train_partition, schema).coalesce(fan_in).mapInPandas(combine, schema)
        n, val_n, sse, acc = 0, 0, 0.0, np.zeros_like(flat)
        for r in parts.collect():
            n += r["n"]; val_n += r["val_n"]; sse += r["val_sse"]; acc += np.asarray(r["w"])
        bc.unpersist()
        val_loss = sse / val_n if val_n else np.nan
        history.append(val_loss)
        # val_loss measures the weights that entered this epoch
        if val_n and val_loss < best_loss:
            best_loss, best, wait = val_loss, [w.copy() for w in ws], 0
        elif val_n:
            wait += 1
            if wait >= p.ae_patience:
                break
        if n:
            ws = unflatten(acc / n, d)
    if not np.isfinite(best_loss):
        best = ws
    return AutoencoderModel(features, best, None, history)
