"""Feature pipeline with fitted state (F1-F11, F9 fit, F10 transform).

One DataFrame keyed by ``task_id`` from read to sink; nothing is aligned by
row position. Everything that the reference re-fits per batch (categories,
group means, scaler) is fitted once here and saved with the model.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from taskwatch.config import Params
from taskwatch.functions.context import context_features
from taskwatch.functions.encode import LABEL_COLUMNS, ONE_HOT_COLUMNS, encoding_features, fit_categories
from taskwatch.functions.features import feature_names
from taskwatch.functions.time import parse_timestamps, with_time_features
from taskwatch.operators.fill import forward_fill
from taskwatch.operators.groups import apply_group_means, fit_global_means, fit_group_means
from taskwatch.operators.rolling import Carry, with_rolling_features
from taskwatch.operators.scaling import apply_robust_scaler, fit_robust_scaler
from taskwatch.session import pin
from taskwatch.sources.schema import IDENTITY_COLUMNS

LABEL = "is_anomaly"


def row_features(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """P, N and X features: per-row projections only (no shuffle)."""
    out = with_time_features(df)
    out = out.withColumns(encoding_features(categories))
    return out.withColumns(context_features())


def engineered(df: DataFrame, categories, group_tables, global_means, params: Params,
               carry: Carry | None = None) -> DataFrame:
    """Row features + rolling windows + group means, still one row per task. The
    rolling tables are joined to the tasks as they came; features that are
    projections are worked out after the joins, not moved through them."""
    rows = with_rolling_features(row_features(df, categories), days=params.rolling_window_days,
                                 broadcast_limit_bytes=params.broadcast_limit_bytes, carry=carry, onto=parse_timestamps(df))
    return apply_group_means(row_features(rows, categories), group_tables, global_means, params.broadcast_limit_bytes)


def select_features(df: DataFrame, features: list[str], strict: bool = True,
                    extra: list[str] | None = None, fill_key: str | None = None) -> DataFrame:
    """Identity + label + ordered features, missing -> 0, or
    with ``fill_key`` (F4) first the last value of that key before the task's
    start and 0 where there is none.

    The reference drops unknown names silently (F2); here a missing feature is
    an error unless ``strict=False``.
    """
    present = [f for f in features if f in df.columns]
    missing = [f for f in features if f not in df.columns]
    if missing and strict:
        raise ValueError(f"missing feature columns: {missing}")
    keep = [c for c in IDENTITY_COLUMNS if c in df.columns]
    if LABEL in df.columns:
        keep.append(LABEL)
    if "planned_start_ts" in df.columns:
        keep.append("planned_start_ts")
    keep += [c for c in (extra or []) if c in df.columns and c not in keep]
    if fill_key is not None:
        df = forward_fill(df, present, fill_key, "planned_start_ts", "task_id")
    return df.select(*keep, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f)
                              for f in present])


@dataclass
class FeatureModel:
    params: Params
    categories: dict[str, list[str]]
    group_tables: dict[str, DataFrame]
    global_means: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    features: list[str] = field(default_factory=list)

    def raw(self, df: DataFrame, extra: list[str] | None = None, carry: Carry | None = None) -> DataFrame:
        if carry is not None and self.params.fill_key is not None:
            raise ValueError("a fill per key looks back without limit: it is for batch jobs, not for a stream")
        eng = engineered(df, self.categories, self.group_tables, self.global_means, self.params, carry)
        return select_features(eng, self.features, extra=extra, fill_key=self.params.fill_key)

    def scale(self, raw: DataFrame) -> DataFrame:
        keep = [c for c in raw.columns if c not in self.features]
        return apply_robust_scaler(raw, self.scaler, self.features, keep)

    def transform(self, df: DataFrame, extra: list[str] | None = None, carry: Carry | None = None) -> DataFrame:
        """scaled feature table keyed by task_id."""
        return self.scale(self.raw(df, extra, carry))

    # Fitted state on disk
    def save(self, path: str) -> None:
        spark = next(iter(self.group_tables.values())).sparkSession
        meta = {"params": self.params.to_dict(), "categories": self.categories,
                "global_means": self.global_means, "features": self.features,
                "numerical_features": self.features, "total_features": len(self.features)}
        spark.createDataFrame([(json.dumps(meta),)], "value string") \
            .coalesce(1).write.mode("overwrite").text(os.path.join(path, "feature_metadata"))
        rows = [(k, float(m), float(s)) for k, (m, s) in self.scaler.items()]
        spark.createDataFrame(rows, "feature string, median double, scale double") \
            .write.mode("overwrite").parquet(os.path.join(path, "scaler"))
        for name, t in self.group_tables.items():
            t.write.mode("overwrite").parquet(os.path.join(path, "group_means", name))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureModel":
        meta = json.loads(spark.read.text(os.path.join(path, "feature_metadata")).first()[0])
        params = Params(**{k: v for k, v in meta["params"].items()})
        scaler = {r["feature"]: (r["median"], r["scale"])
                  for r in spark.read.parquet(os.path.join(path, "scaler")).collect()}
        tables = {name: spark.read.parquet(os.path.join(path, "group_means", name))
                  for name in meta["global_means"]}
        return cls(params, meta["categories"], tables, meta["global_means"], scaler, meta["features"])


class FeaturePipeline:
    """fit the feature state, and transform the same rows without computing
    their features a second time. With ``train_col``, the state is fitted on the
    rows that have 1 there; rolling features see all rows, as their frames only
    look back in time."""

    def __init__(self, params: Params | None = None):
        self.params = params or Params()

    def fit(self, tasks: DataFrame, train_col: str | None = None) -> FeatureModel:
        return self._fit(tasks, train_col)[0]

    def fit_transform(self, tasks: DataFrame, train_col: str | None = None) -> tuple[FeatureModel, DataFrame]:
        model, raw = self._fit(tasks, train_col)
        return model, model.scale(raw)

    def _fit(self, tasks: DataFrame, train_col: str | None) -> tuple[FeatureModel, DataFrame]:
        p = self.params

        def train(df):
            return df if train_col is None else df.where(F.col(train_col) == 1)

        rows = train(tasks)
        categories = fit_categories(rows, LABEL_COLUMNS + ONE_HOT_COLUMNS)
        group_tables = fit_group_means(rows)
        global_means = fit_global_means(rows)
        features = feature_names(categories.get("shift", []))
        eng = engineered(tasks, categories, group_tables, global_means, p)
        raw = pin(select_features(eng, features, extra=[train_col] if train_col else None, fill_key=p.fill_key))
        scaler = fit_robust_scaler(train(raw), features)
        return FeatureModel(p, categories, group_tables, global_means, scaler, features), raw
