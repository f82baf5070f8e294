"""Evaluation metrics and curve tables.

Everything is an aggregation. Rank metrics (AUC, average precision, ROC and
PR curves) first group rows by distinct score, then take exact running totals
over the score order with ``global_prefix``: no one-partition window and no
row reaches the driver. Several scores are handled at once in long form
(``model``, ``score``, ``label``), one curve per model.

Conventions kept from the reference: precision/recall/F1 are 0 when
undefined; AUC is 0.5 when only one class is present; average precision is 0
then; ties in score count one half (the trapezoid rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taskwatch.operators.prefix import global_prefix
from taskwatch.operators.quantiles import exact_quantiles
from taskwatch.session import pin


def _i(col: str) -> Column:
    return F.coalesce(F.col(col).cast("bigint"), F.lit(0))


def require_label(df: DataFrame, label: str = "is_anomaly") -> None:
    """Metrics need labels; scoring does not. Refuse clearly when they are absent."""
    if label not in df.columns:
        raise ValueError(f"metrics need the label column {label!r}; the input has none")


def confusion_counts(df: DataFrame, label: str = "is_anomaly", pred: str = "anomaly_flag") -> DataFrame:
    require_label(df, label)
    y, p = F.col(label), F.col(pred)
    labelled = df.where(y.isNotNull())
    return labelled.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(((y == 1) & (p == 1)).cast("bigint")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("bigint")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("bigint")).alias("fn"),
        F.sum(((y == 0) & (p == 0)).cast("bigint")).alias("tn"),
    )


def classification_metrics(df: DataFrame, label: str = "is_anomaly", pred: str = "anomaly_flag") -> DataFrame:
    """M1-M3, M8, M9, M11 in one row."""
    c = confusion_counts(df, label, pred)
    tp, fp, fn, tn, n = (F.coalesce(F.col(x), F.lit(0)).cast("double")
                         for x in ("tp", "fp", "fn", "tn", "total_samples"))
    return c.select(
        F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
        F.try_divide(tp + fp, n).alias("alert_rate"),
        F.try_divide(tp + fn, n).alias("true_anomaly_rate"),
        F.col("total_samples").cast("bigint").alias("total_samples"),
        (F.coalesce(F.col("tp"), F.lit(0)) + F.coalesce(F.col("fp"), F.lit(0))).cast("bigint").alias("anomalies_detected"),
        (F.coalesce(F.col("tp"), F.lit(0)) + F.coalesce(F.col("fn"), F.lit(0))).cast("bigint").alias("true_anomalies"),
    )


def confusion_matrix(df: DataFrame, label: str = "is_anomaly", pred: str = "anomaly_flag") -> DataFrame:
    """M7 + M18: four cells (actual, predicted, n, pct of total), zero cells included."""
    c = confusion_counts(df, label, pred)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                               F.coalesce(F.col(col), F.lit(0)).cast("bigint").alias("n"))
                      for a, b, col in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    out = c.select(F.col("total_samples"), F.inline(cells))
    return out.select("actual", "predicted", "n",
                      (F.col("n").cast("double") * 100.0 / F.col("total_samples")).alias("pct"))


def long_scores(df: DataFrame, score_cols: dict[str, str], label: str = "is_anomaly") -> DataFrame:
    """(model, score, label) rows for every named score column (M10 unpivot)."""
    require_label(df, label)
    parts = F.array(*[F.struct(F.lit(name).alias("model"), F.col(col).cast("double").alias("score"))
                      for name, col in score_cols.items()])
    return (df.select(F.col(label).cast("bigint").alias("label"), F.inline(parts))
            .where(F.col("label").isNotNull() & F.col("score").isNotNull()))


def score_counts(long: DataFrame) -> DataFrame:
    """Distinct (model, score) with positive and negative counts."""
    return long.groupBy("model", "score").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def ranked_counts(long: DataFrame) -> DataFrame:
    """``score_counts`` with running totals from the highest score down
    (``cum_pos``, ``cum_neg``) and the totals ``P`` and ``N`` per model: the one
    table that every rank metric and curve is read from."""
    counts = pin(score_counts(long), "score-counts")
    down = global_prefix(counts, ["score"], ["pos", "neg"], descending=True, group_cols=["model"])
    totals = counts.groupBy("model").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return down.join(totals, "model")


def rank_metrics(long: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Per model, ROC AUC (ties = 1/2) and average precision. Here and
    in the curves, ``ranked`` is the ``ranked_counts`` of ``long`` where a caller has them."""
    c = ranked_counts(long) if ranked is None else ranked
    below = F.col("N") - F.col("cum_neg") + F.col("neg") * 0.5   # negatives a positive beats
    r = c.groupBy("model", "P", "N").agg(
        F.sum(F.col("pos") * below).alias("u"),
        F.sum(F.col("pos") * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))).alias("s"))
    return r.select(
        "model",
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P").cast("double") * F.col("N")))
        .otherwise(F.lit(0.5)).alias("auc_roc"),
        F.when(F.col("P") > 0, F.col("s") / F.col("P")).otherwise(F.lit(0.0)).alias("auc_pr"))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def _with_end(points: DataFrame, **end: float) -> DataFrame:
    """``points`` and, per model, the point at no threshold (NULL), where nothing is predicted."""
    ends = points.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(k) for k, v in end.items()])
    return points.unionByName(ends)


def roc_curve(long: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """One point per distinct threshold (predict 1 when score >= threshold), and (0, 0)."""
    points = (ranked_counts(long) if ranked is None else ranked).select("model", F.col("score").alias("threshold"),
                       _share("cum_neg", "N").alias("fpr"), _share("cum_pos", "P").alias("tpr"))
    return _with_end(points, fpr=0.0, tpr=0.0)


def pr_curve(long: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Precision and recall at every distinct threshold, and (recall 0, precision 1)."""
    points = (ranked_counts(long) if ranked is None else ranked).select(
        "model", F.col("score").alias("threshold"),
        (F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        _share("cum_pos", "P").alias("recall"))
    return _with_end(points, precision=1.0, recall=0.0)


def histogram(long: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins over [min, max] of each score, empty ones included;
    the max falls in the last bin."""
    rng = long.groupBy("model").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = long.join(rng, "model")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    found = x.withColumn("bin", b).groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, ["model", "bin"], "left").select(
        "model", "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"))


def boxplot(long: DataFrame) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers (most extreme data inside) and outlier count."""
    qs = exact_quantiles(long, [0.25, 0.5, 0.75], "model", "score")
    qs = qs.select("model", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                   F.col("q")[2].alias("q3"))
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1"))
    x = long.join(F.broadcast(qs), "model")
    lo_fence = F.col("q1") - 1.5 * F.col("iqr")
    hi_fence = F.col("q3") + 1.5 * F.col("iqr")
    return x.groupBy("model", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("score") >= lo_fence, F.col("score"))).alias("lower_whisker"),
        F.max(F.when(F.col("score") <= hi_fence, F.col("score"))).alias("upper_whisker"),
        F.sum(((F.col("score") < lo_fence) | (F.col("score") > hi_fence)).cast("bigint")).alias("outliers"))


def calibration(df: DataFrame, score: str = "anomaly_score", label: str = "is_anomaly",
                bins: int = 10) -> DataFrame:
    """Q2: reliability table over equal-width score bins on [0, 1], empty ones included."""
    require_label(df, label)
    s = F.col(score).cast("double")
    b = F.least(F.greatest(F.floor(s * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    found = (df.where(F.col(label).isNotNull() & s.isNotNull()).withColumn("bin", b)
             .groupBy("bin").agg(F.avg(s).alias("mean_score"),
                                 F.avg(F.col(label).cast("double")).alias("fraction_positive"),
                                 F.count(F.lit(1)).alias("n")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


# Recommendation rules and texts of the reference.
REC_LOW_PRECISION = "Low precision detected. Consider adjusting thresholds or feature engineering."
REC_LOW_RECALL = "Low recall detected. Consider lowering anomaly thresholds."
REC_HIGH_ALERTS = "High alert rate detected. Consider increasing thresholds to reduce false positives."
REC_MODEL_GAP = "Significant performance gap between models. Consider adjusting ensemble weights."
REC_OK = "Model performance looks good. Consider monitoring for drift over time."


def recommendations(metrics: DataFrame) -> Column:
    """M12 over a row with precision, recall, alert_rate, if_auc, ae_auc."""
    recs = F.array_compact(F.array(
        F.when(F.col("precision") < 0.5, F.lit(REC_LOW_PRECISION)),
        F.when(F.col("recall") < 0.7, F.lit(REC_LOW_RECALL)),
        F.when(F.col("alert_rate") > 0.2, F.lit(REC_HIGH_ALERTS)),
        F.when(F.abs(F.col("if_auc") - F.col("ae_auc")) > 0.1, F.lit(REC_MODEL_GAP)),
    ))
    return F.when(F.size(recs) == 0, F.array(F.lit(REC_OK))).otherwise(recs)


def band(col: str, low: float, high: float) -> Column:
    """M19: 'poor' below low, 'fair' below high, else 'good'."""
    return (F.when(F.col(col) < low, F.lit("poor")).when(F.col(col) < high, F.lit("fair"))
            .otherwise(F.lit("good")))
