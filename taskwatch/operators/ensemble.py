"""Score ensemble.

Min/max normalisation uses the range saved at fit time (``normalize_mode
= "fit"``) and clips to [0, 1], so scoring one task gives the same answer as
scoring it inside a batch. ``"batch"`` reproduces per-batch normalisation
(the min/max of the scored batch, found with one scalar aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.config import Params

EPS = 1e-6


def fit_score_range(scores: DataFrame, cols=("if_score", "ae_score")) -> dict[str, tuple[float, float]]:
    row = scores.agg(*[x for c in cols for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]).first()
    return {c: (row[f"{c}_min"], row[f"{c}_max"]) for c in cols}


def normalised(col: str, lo: float | None, hi: float | None, clip: bool) -> Column:
    """(s - min) / (max - min); a constant score maps to 0."""
    if lo is None or hi is None or hi == lo:
        return F.lit(0.0)
    x = (F.col(col).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo))
    if clip:
        x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return x


def ensemble(scores: DataFrame, ranges: dict[str, tuple[float, float]] | None = None,
             params: Params | None = None) -> DataFrame:
    """E1-E7 over a score table (task_id, if_score, ae_score, if_flag, ae_flag, ...)."""
    p = params or Params()
    if ranges is None or p.normalize_mode == "batch":
        ranges = fit_score_range(scores)
    clip = p.normalize_mode == "fit"
    thr = p.anomaly_score_threshold
    agree_thr = thr * p.agreement_factor
    out = scores.withColumns({
        "if_score_norm": normalised("if_score", *ranges["if_score"], clip),
        "ae_score_norm": normalised("ae_score", *ranges["ae_score"], clip),
    })
    ifn, aen = F.col("if_score_norm"), F.col("ae_score_norm")
    if p.blend_mode == "static":
        combined = F.lit(p.if_weight) * ifn + F.lit(p.ae_weight) * aen          # E2
    else:
        c_if = F.abs(ifn - F.lit(thr))                                            # E3
        c_ae = F.abs(aen - F.lit(thr))
        total = c_if + c_ae + F.lit(EPS)
        combined = (c_if / total) * ifn + (c_ae / total) * aen                    # E4
    out = out.withColumn("anomaly_score", combined)
    s = F.col("anomaly_score")
    both = (F.coalesce(F.col("if_flag"), F.lit(0)) == 1) & (F.coalesce(F.col("ae_flag"), F.lit(0)) == 1)
    return out.withColumns({
        "primary_flag": (s > F.lit(thr)).cast("int"),                             # E5
        "agreement_flag": ((s > F.lit(agree_thr)) & both).cast("int"),            # E6
    }).withColumn("anomaly_flag",                                                # E7
                  ((F.col("primary_flag") == 1) | (F.col("agreement_flag") == 1)).cast("int"))


def nested_result(df: DataFrame, with_explanations: bool = True) -> DataFrame:
    """The reference's nested result, one struct per task."""
    fields = [
        F.col("anomaly_flag"), F.col("anomaly_score"),
        F.struct(F.col("if_score_norm").alias("isolation_forest"),
                 F.col("ae_score_norm").alias("autoencoder")).alias("model_scores"),
        F.struct(F.col("if_flag").alias("isolation_forest"),
                 F.col("ae_flag").alias("autoencoder")).alias("model_flags"),
    ]
    if with_explanations and "if_top" in df.columns:
        fields.append(F.struct(F.col("if_top").alias("isolation_forest"),
                               F.col("ae_top").alias("autoencoder")).alias("explainability"))
    return df.select("task_id", F.struct(*fields).alias("result"))


def anomaly_summary(df: DataFrame, flag: str = "anomaly_flag") -> DataFrame:
    """Count and rate of flagged tasks."""
    return df.agg(F.count(F.lit(1)).alias("total_tasks"),
                  F.coalesce(F.sum(flag), F.lit(0)).cast("bigint").alias("anomalies_detected"),
                  F.avg(F.col(flag).cast("double")).alias("anomaly_rate"))


def single(df: DataFrame, task_id: str) -> DataFrame:
    """The result for one task; raises unless exactly one row matches."""
    one = df.where(F.col("task_id") == F.lit(task_id))
    rows = one.limit(2).count()
    if rows != 1:
        raise ValueError(f"expected exactly one task {task_id!r}, found {rows}")
    return one
