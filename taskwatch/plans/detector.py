"""Hybrid detector: isolation forest + reconstruction model + ensemble
(E8-E11, I1-I5, R1-R7, S7-S9).

``HybridDetector.fit_scored`` runs two fits over the training part of one matrix,
scores every row once (pinned) and derives every threshold and score range
from that table with aggregations. ``DetectorModel.score`` is one projection
with two pandas UDFs (evaluated in a single Arrow round trip) followed by
the ensemble expressions; ``explain`` runs only on the rows it is given.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from taskwatch.config import Params
from taskwatch.operators.autoencoder import AutoencoderModel, fit_autoencoder, flatten, unflatten
from taskwatch.operators.ensemble import ensemble, nested_result, single
from taskwatch.operators.explain import forest_top_column, reconstruction_top_column
from taskwatch.operators.forest import ForestModel, fit_forest, score_column
from taskwatch.operators.quantiles import quantile_of
from taskwatch.operators.reconstruct import (ReconstructionModel, error_column, fit_error_threshold,
                                             fit_reconstruction)
from taskwatch.session import pin


@dataclass
class DetectorModel:
    params: Params
    features: list[str]
    forest: ForestModel
    recon: ReconstructionModel
    if_threshold: float
    ae_threshold: float
    ranges: dict

    def raw_scores(self, X: DataFrame) -> DataFrame:
        return X.withColumns({
            "if_score": score_column(self.forest, self.features),
            "ae_score": error_column(self.recon, self.features),
        })

    def score(self, X: DataFrame, raw: bool = True) -> DataFrame:
        """I2/I4, R4/R6, then E1-E7. Keeps every input column. ``raw=False``
        when ``X`` already carries ``if_score`` and ``ae_score``."""
        s = self.raw_scores(X) if raw else X
        s = s.withColumns({
            "if_flag": (F.col("if_score") > F.lit(self.if_threshold)).cast("int"),
            "ae_flag": (F.col("ae_score") > F.lit(self.ae_threshold)).cast("int"),
        })
        return ensemble(s, self.ranges, self.params)

    def explain(self, rows: DataFrame) -> DataFrame:
        """I5 + R7 for the given rows (callers pass flagged rows only)."""
        k = self.params.top_k
        return rows.withColumns({
            "if_top": forest_top_column(self.forest, self.features, k),
            "ae_top": reconstruction_top_column(self.recon, self.features, k),
        })

    def results(self, X: DataFrame) -> DataFrame:
        """Every task's nested result, explanations included."""
        return nested_result(self.explain(self.score(X)))

    def single_result(self, X: DataFrame, task_id: str) -> dict:
        """One task's nested result; only its row is scored and explained.
        Raises unless exactly one row of ``X`` has that id."""
        return self.results(single(X, task_id)).first()["result"].asDict(recursive=True)

    # ---- S7-S9
    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"params": self.params.to_dict(), "features": self.features,
                "if_threshold": self.if_threshold, "ae_threshold": self.ae_threshold,
                "ranges": self.ranges, "psi": self.forest.psi, "max_depth": self.forest.max_depth,
                "recon_kind": "mlp" if isinstance(self.recon, AutoencoderModel) else "pca"}
        if isinstance(self.recon, AutoencoderModel):
            meta["recon_weights"] = flatten(self.recon.weights).tolist()
        else:
            meta["recon_mean"] = self.recon.mean.tolist()
            meta["recon_components"] = self.recon.components.tolist()
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(os.path.join(path, "detector_metadata"))
        spark.createDataFrame(self.forest.to_nodes()).write.mode("overwrite") \
            .parquet(os.path.join(path, "forest_nodes"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DetectorModel":
        meta = json.loads(spark.read.text(os.path.join(path, "detector_metadata")).first()[0])
        nodes = spark.read.parquet(os.path.join(path, "forest_nodes")).toPandas()
        trees, m = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
        arr = lambda c, dt: nodes.pivot(index="tree", columns="node", values=c) \
            .reindex(index=range(trees), columns=range(m)).to_numpy().astype(dt)
        forest = ForestModel(meta["features"], meta["psi"], arr("feature", np.int32), arr("threshold", float),
                             arr("left", np.int32), arr("right", np.int32), arr("leaf_h", float),
                             arr("value", float), meta["max_depth"], meta["if_threshold"])
        if meta.get("recon_kind") == "mlp":
            recon = AutoencoderModel(meta["features"], unflatten(np.array(meta["recon_weights"]),
                                                                 len(meta["features"])), meta["ae_threshold"])
        else:
            recon = ReconstructionModel(meta["features"], np.array(meta["recon_mean"]),
                                        np.array(meta["recon_components"]), meta["ae_threshold"])
        ranges = {k: tuple(v) for k, v in meta["ranges"].items()}
        return cls(Params(**meta["params"]), meta["features"], forest, recon,
                   meta["if_threshold"], meta["ae_threshold"], ranges)


class HybridDetector:
    def __init__(self, params: Params | None = None):
        self.params = params or Params()

    def fit(self, X_train: DataFrame, features: list[str], id_col: str = "task_id") -> DetectorModel:
        """Both fits on one pinned matrix, thresholds from one scored table."""
        extra = ["planned_start_ts"] if "planned_start_ts" in X_train.columns else []
        model, _ = self.fit_scored(pin(X_train.select(id_col, *extra, *features)), features, None, id_col)
        return model

    def fit_scored(self, X: DataFrame, features: list[str], train_col: str | None = "is_train",
                   id_col: str = "task_id") -> tuple[DetectorModel, DataFrame]:
        """Fit on the rows with ``train_col == 1`` (all rows if None) and score
        every row of ``X`` once; thresholds and ranges come from the training
        part of that one scored table. Returns (model, raw scores of all rows).
        ``X`` is read four times: a pinned table or a projection of one (the many
        epochs of the MLP read a copy of the training rows)."""
        p = self.params
        Xt = X if train_col is None else X.where(F.col(train_col) == 1)
        if p.recon_model == "mlp" and train_col is not None:
            Xt = pin(Xt.select(id_col, *(c for c in ["planned_start_ts"] if c in X.columns), *features))
        n = Xt.count()
        forest = fit_forest(Xt, features, p, n, id_col)
        if p.recon_model == "mlp":
            recon = fit_autoencoder(Xt, features, p)
        else:
            recon = fit_reconstruction(Xt, features, p)
        partial = DetectorModel(p, features, forest, recon, float("inf"), float("inf"), {})
        scored_all = pin(partial.raw_scores(X if train_col is not None else Xt))
        train_scores = scored_all if train_col is None else scored_all.where(F.col(train_col) == 1)
        q = 1.0 - p.contamination
        if_thr = quantile_of(train_scores, "if_score", q)
        row = train_scores.agg(F.min("if_score").alias("if_lo"), F.max("if_score").alias("if_hi"),
                               F.min("ae_score").alias("ae_lo"), F.max("ae_score").alias("ae_hi")).first()
        ae_thr = fit_error_threshold(train_scores, "ae_score", p)
        forest.threshold_score = if_thr
        recon.threshold = ae_thr
        ranges = {"if_score": (row["if_lo"], row["if_hi"]), "ae_score": (row["ae_lo"], row["ae_hi"])}
        return DetectorModel(p, features, forest, recon, if_thr, ae_thr, ranges), scored_all

