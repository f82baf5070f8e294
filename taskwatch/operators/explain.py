"""Per-row explanations (I5, R7) and their summary.

Explanations are computed only for the rows that need them (the caller
filters to flagged rows first). One Arrow UDF per model works out every row's
credits, ranks them by absolute value, ties in feature order, and hands back
only the first k of them, from which the JVM makes the top-k list
``[{feature, contribution, signed_contribution}]``.

Forest: path attribution (see ``operators.forest``), contribution and
signed contribution are both the signed credit, ranked by absolute value.
Reconstruction: contribution = |x - x_hat|, signed = x - x_hat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.session import broadcast_model


def top_credits(credits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the places and values of the ``k`` largest absolute credits, ties
    in feature order, NaN last."""
    at = np.argsort(-np.abs(credits), axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(credits, at, axis=1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(a.ravel(), kind))


def _top(bc, method: str, features: list[str], k: int, absolute: bool) -> Column:
    """The top-k list from ``method`` of the broadcast model over the feature columns."""

    @F.arrow_udf("struct<i array<int>, v array<double>>")
    def top(*cols: pa.Array) -> pa.Array:
        X = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols])
        at, v = top_credits(getattr(bc.value, method)(X), k)
        return pa.StructArray.from_arrays([_lists(at, pa.int32()), _lists(v, pa.float64())], names=["i", "v"])

    found = top(*[F.col(f).cast("double") for f in features])
    names = F.array(*[F.lit(f) for f in features])
    return F.transform(F.arrays_zip(found["i"].alias("i"), found["v"].alias("v")), lambda x: F.struct(
        F.get(names, x["i"]).alias("feature"),
        (F.abs(x["v"]) if absolute else x["v"]).alias("contribution"),
        x["v"].alias("signed_contribution")))


def forest_top_column(model, features: list[str], k: int = 5) -> Column:
    return _top(broadcast_model(model), "contributions", features, k, False)


def reconstruction_top_column(model, features: list[str], k: int = 5) -> Column:
    return _top(broadcast_model(model), "residuals", features, k, True)


def explanation_rows(df: DataFrame) -> DataFrame:
    """Flatten ``if_top`` / ``ae_top`` to (task_id, model, rank, feature, contribution, signed)."""
    held = [(m, c) for m, c in (("isolation_forest", "if_top"), ("autoencoder", "ae_top")) if c in df.columns]
    # one pass gives the lists of both models
    tops = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("top")) for m, c in held]))
    return (df.select("task_id", tops.alias("t")).select("task_id", "t.model", F.posexplode("t.top").alias("rank", "c"))
            .select("task_id", "model", (F.col("rank") + 1).alias("rank"), "c.feature", "c.contribution", "c.signed_contribution"))


def top_feature_summary(rows: DataFrame, k: int = 10) -> DataFrame:
    """M17, re-aimed from "first row only" to all explained rows: mean |contribution|
    per model and feature, top k per model (a top-k report, so the limit is the feature)."""
    from pyspark.sql import Window
    agg = rows.groupBy("model", "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"),
                                                F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model").orderBy(F.desc("mean_abs_contribution"), F.asc("feature"))
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
