"""Registered queries: one Spark builder per operator group of SURVEY §2,
with the matching DuckDB oracle SQL where SQL can state it.

Every query reads the driver's tables at ``sf_dir`` whole. Builders only
declare plans, except where an operator must fit state first (category
lists, scaler, score ranges): those fits are aggregations whose small
results are carried as literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from taskwatch import catalog_sql as S
from taskwatch.config import Params
from taskwatch.functions.encode import LABEL_COLUMNS, ONE_HOT_COLUMNS, fit_categories
from taskwatch.operators import metrics as M
from taskwatch.operators.cooldown import cooldown_batch
from taskwatch.operators.ensemble import anomaly_summary, ensemble, fit_score_range
from taskwatch.operators.fill import forward_fill
from taskwatch.operators.groups import GROUP_MEANS, apply_group_means, dataset_profile, fit_group_means
from taskwatch.operators.quantiles import quantile_of
from taskwatch.operators.reconstruct import fit_error_threshold
from taskwatch.operators.rolling import ROLLING_SPEC, rolling_columns, with_rolling_features
from taskwatch.operators.scaling import apply_robust_scaler, fit_robust_scaler
from taskwatch.operators.split import time_split, without_start
from taskwatch.plans.featurize import row_features, select_features
from taskwatch.functions.features import feature_names
from taskwatch.sources.readers import conform, read_json_tasks, tasks_from_events, validate_records
from taskwatch.session import pin, scratch_path
from taskwatch.sources.schema import RAW_RECORD, TASK_COLUMNS, TIMESTAMP_COLUMNS
from taskwatch.streaming.scoring import alert_events, alert_rows

P = Params()


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round doubles for the cross-engine comparison (+0.0 folds -0.0 into 0.0)."""
    return df.select(*[
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# ---------------------------------------------------------------- building blocks

def tasks(spark: SparkSession, sf: str) -> DataFrame:
    return tasks_from_events(spark, sf)


_CATEGORIES: dict[tuple[str, str], dict] = {}


def categories(spark: SparkSession, sf: str) -> dict[str, list[str]]:
    """Category lists of the task view, fitted once per session and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CATEGORIES:
        _CATEGORIES[key] = fit_categories(tasks(spark, sf), LABEL_COLUMNS + ONE_HOT_COLUMNS)
    return _CATEGORIES[key]


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return row_features(tasks(spark, sf), categories(spark, sf))


def engineered_all(spark: SparkSession, sf: str) -> DataFrame:
    r = rows(spark, sf)
    out = with_rolling_features(r, broadcast_limit_bytes=P.broadcast_limit_bytes, onto=tasks(spark, sf))
    return apply_group_means(row_features(out, categories(spark, sf)), fit_group_means(r), None, P.broadcast_limit_bytes)


def features(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    names = feature_names(categories(spark, sf)["shift"])
    return select_features(engineered_all(spark, sf), names), names


def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score table from the reference's own indicator rules (FIXTURES §3):
    duration ratio with its outlier flag, schedule deviation (hours) with the
    extreme-delay flag."""
    r = rows(spark, sf)
    return r.select("task_id", "engine_id", "actual_end_ts", "is_anomaly",
                    F.coalesce(F.col("duration_ratio"), F.lit(0.0)).alias("if_score"),
                    (F.col("schedule_deviation") / F.lit(60.0)).alias("ae_score"),
                    F.col("duration_outlier").alias("if_flag"),
                    F.col("extreme_delay").alias("ae_flag"))


def scored(spark: SparkSession, sf: str, static: bool = False) -> DataFrame:
    s = rule_scores(spark, sf)
    params = Params(blend_mode="static") if static else P
    return ensemble(s, fit_score_range(s), params)


def long_scores(spark: SparkSession, sf: str) -> DataFrame:
    return M.long_scores(scored(spark, sf).withColumn("flags", F.col("anomaly_flag").cast("double")),
                         {"ensemble": "anomaly_score", "isolation_forest": "if_score_norm",
                          "autoencoder": "ae_score_norm", "flags": "flags"})


# ---------------------------------------------------------------- queries

def q_task_view(spark, sf):
    return rounded(tasks(spark, sf))


def q_time_features(spark, sf):
    return rounded(rows(spark, sf).select("task_id", *S.P_COLS))


def q_encodings(spark, sf):
    return rounded(rows(spark, sf).select("task_id", *S.N_COLS))


def q_context_features(spark, sf):
    return rounded(rows(spark, sf).select("task_id", *S.X_COLS))


def q_group_means(spark, sf):
    t = tasks(spark, sf)
    out = apply_group_means(t.select("task_id", "bay_id", "module_id", "task_name"),
                            fit_group_means(t), None, P.broadcast_limit_bytes)
    return rounded(out.select("task_id", *[g[0] for g in GROUP_MEANS]))


def q_dataset_profile(spark, sf):
    return rounded(dataset_profile(tasks(spark, sf)))


def _q_rolling(prefix):
    def build(spark, sf):
        r = rows(spark, sf)
        out = with_rolling_features(r.select("task_id", *{ROLLING_SPEC[prefix][0]}, "planned_start_ts",
                                             *[c for c, _ in ROLLING_SPEC[prefix][1]]),
                                    prefixes=(prefix,), days=P.rolling_window_days,
                                    broadcast_limit_bytes=P.broadcast_limit_bytes)
        return rounded(out.select("task_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                                               for c in rolling_columns(prefix)]))
    return build


def q_feature_matrix(spark, sf):
    fm, names = features(spark, sf)
    return rounded(fm.select("task_id", "is_anomaly", *names))


def q_scaler_fit(spark, sf):
    fm, names = features(spark, sf)
    fm = pin(fm, "feature-matrix")
    params = fit_robust_scaler(fm, names)
    rows_ = [(k, float(m), float(s)) for k, (m, s) in params.items()]
    return rounded(spark.createDataFrame(rows_, "feature string, median double, scale double"))


def q_scaled_features(spark, sf):
    fm, names = features(spark, sf)
    fm = pin(fm, "feature-matrix")   # read twice: fit, then apply
    params = fit_robust_scaler(fm, names)
    return rounded(apply_robust_scaler(fm, params, names, ["task_id"]))


def q_time_split(spark, sf):
    return time_split(tasks(spark, sf), P.test_size).select("task_id", "is_train")


def q_rule_scores(spark, sf):
    return rounded(rule_scores(spark, sf).select("task_id", "if_score", "ae_score", "if_flag",
                                                 "ae_flag", "is_anomaly"))


ENSEMBLE_COLS = ["task_id", "if_score_norm", "ae_score_norm", "anomaly_score",
                 "primary_flag", "agreement_flag", "anomaly_flag"]


def q_ensemble(spark, sf):
    return rounded(scored(spark, sf).select(*ENSEMBLE_COLS))


def q_ensemble_static(spark, sf):
    return rounded(scored(spark, sf, static=True).select(*ENSEMBLE_COLS))


def q_classification_metrics(spark, sf):
    return rounded(M.classification_metrics(scored(spark, sf)))


def q_rank_metrics(spark, sf):
    return rounded(M.rank_metrics(long_scores(spark, sf)))


def q_confusion_matrix(spark, sf):
    return rounded(M.confusion_matrix(scored(spark, sf)))


def q_roc_curve(spark, sf):
    return rounded(M.roc_curve(long_scores(spark, sf)))


def q_pr_curve(spark, sf):
    return rounded(M.pr_curve(long_scores(spark, sf)))


def q_score_histogram(spark, sf):
    return rounded(M.histogram(long_scores(spark, sf).where(F.col("model") != "flags")))


def q_score_boxplot(spark, sf):
    return rounded(M.boxplot(long_scores(spark, sf).where(F.col("model") != "flags")))


def _evaluation_row(spark, sf) -> DataFrame:
    """Classification metrics with the per-model AUCs as columns (one row)."""
    names = ["precision", "recall", "f1_score", "alert_rate"]
    cls = M.classification_metrics(scored(spark, sf)).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    renamed = {"ensemble": "auc_roc", "isolation_forest": "if_auc", "autoencoder": "ae_auc"}
    ranks = (M.rank_metrics(long_scores(spark, sf)).where(F.col("model").isin(list(renamed)))
             .select(F.coalesce(*[F.when(F.col("model") == k, F.lit(v)) for k, v in renamed.items()])
                     .alias("metric"), F.col("auc_roc").alias("value")))
    metrics = names + list(renamed.values())
    # one row, by aggregation (no join of single-row tables)
    return cls.unionByName(ranks).groupBy().pivot("metric", metrics).agg(F.first("value"))


def q_recommendations(spark, sf):
    row = _evaluation_row(spark, sf)
    return row.select(F.posexplode(M.recommendations(row)).alias("position", "recommendation")) \
        .select(F.col("position").cast("int").alias("position"), "recommendation")


def q_metric_bands(spark, sf):
    row = _evaluation_row(spark, sf)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"),
                               M.band(m, lo, hi).alias("band"))
                      for m, lo, hi in (("precision", 0.5, 0.8), ("recall", 0.5, 0.8),
                                        ("f1_score", 0.5, 0.8), ("auc_roc", 0.5, 0.7))])
    return rounded(row.select(F.inline(cells)))


def q_training_summary(spark, sf):
    t = tasks(spark, sf)
    fm_names = feature_names(categories(spark, sf)["shift"])
    n = F.count(F.lit(1))
    k = F.floor(n * F.lit(1 - P.test_size)).cast("bigint")
    return rounded(t.agg(
        n.alias("total_samples"), k.alias("train_samples"), (n - k).alias("test_samples"),
        F.lit(len(fm_names)).alias("features"),
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.lit(P.if_weight).alias("isolation_forest_weight"),
        F.lit(P.ae_weight).alias("autoencoder_weight")))


def q_scoring_summary(spark, sf):
    return rounded(anomaly_summary(scored(spark, sf)))


def q_alert_events(spark, sf):
    """The events that the scoring stream sends for its alerts."""
    return rounded(alert_events(alert_rows(scored(spark, sf))))


def q_calibration(spark, sf):
    return rounded(M.calibration(scored(spark, sf)))


# Q3: the configured 30-day KPI window, over the raw engine and shop KPIs.
# Totals and peaks for the hour KPIs, mean and peak for the integer WIP count.
KPI_SPEC = ("engine_id", [("tat_hours_engine", ["sum", "max"]), ("wip_count_shop", ["mean", "max"]),
                          ("mttr_hours_engine", ["sum", "max"])])


def q_kpi_rolling(spark, sf):
    r = rows(spark, sf)
    out = with_rolling_features(r, days=P.kpi_rolling_window_days, specs={"kpi": KPI_SPEC},
                                broadcast_limit_bytes=P.broadcast_limit_bytes)
    cols = [f"kpi_{c}_{a}" for c, aggs in KPI_SPEC[1] for a in aggs]
    return rounded(out.select("task_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in cols]))


def q_score_thresholds(spark, sf):
    """I3, R5 on the rule scores."""
    s = pin(rule_scores(spark, sf).select("if_score", "ae_score"), "rule-scores")
    return rounded(spark.createDataFrame(
        [(quantile_of(s, "if_score", 1 - P.contamination), fit_error_threshold(s, "ae_score", P))],
        "if_threshold double, ae_threshold double"))


def q_forward_filled(spark, sf):
    """the optional fill per key, on two columns with long and short gaps."""
    n = F.substring("task_id", 3, 20).cast("long")
    gaps = tasks(spark, sf).select(
        "task_id", "engine_id", "planned_start_ts",
        F.when(n % 37 == 0, F.col("tat_hours_engine")).alias("tat_hours_engine"),
        F.when(n % 3 != 0, F.col("snag_count")).alias("snag_count"))
    out = forward_fill(gaps, ["tat_hours_engine", "snag_count"], "engine_id", "planned_start_ts", "task_id",
                       P.broadcast_limit_bytes)
    return rounded(out.select("task_id", F.coalesce("tat_hours_engine", F.lit(0.0)).alias("tat_hours_engine"),
                              F.coalesce("snag_count", F.lit(0)).alias("snag_count")))


def text_tasks(spark, sf) -> DataFrame:
    """The task view as a text file would bring it: ISO strings, some broken or empty."""
    t = tasks(spark, sf)
    iso = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in TIMESTAMP_COLUMNS}
    n = F.substring("task_id", 3, 20).cast("long")
    iso["planned_start_ts"] = F.when(n % 11 == 0, F.lit("not a time")).otherwise(iso["planned_start_ts"])
    iso["actual_end_ts"] = F.when(n % 17 != 0, iso["actual_end_ts"])
    return t.withColumns(iso)


def q_parsed_tasks(spark, sf):
    """The records whose timestamps all parse."""
    return validate_records(conform(text_tasks(spark, sf)))[0].select("task_id", *TIMESTAMP_COLUMNS)


def q_rejected_tasks(spark, sf):
    """The others, with the fields that are missing or did not parse."""
    return validate_records(conform(text_tasks(spark, sf)))[1].select(
        "task_id", F.concat_ws(",", "missing_fields").alias("missing_fields"))


def q_broken_lines(spark, sf):
    """The tasks as JSON lines, some cut off and some without an id, read
    back: the lines that are no records, as they came, and why others are refused."""
    t = tasks(spark, sf)
    n, fields = F.substring("task_id", 3, 20).cast("long"), t.columns
    line = (F.when(n % 19 == 0, F.concat(F.lit('{"task_id": "'), F.col("task_id"), F.lit('", "planned')))
            .when(n % 23 == 0, F.to_json(F.struct(*[c for c in fields if c != "task_id"]))).otherwise(F.to_json(F.struct(*fields))))
    path = scratch_path(spark, "json-lines")
    t.select(line.alias("value")).write.text(path)
    rejected = validate_records(read_json_tasks(spark, path))[1]
    return rejected.select(F.when(F.array_contains("missing_fields", RAW_RECORD), F.col("raw")).alias("line"),
                           F.col("missing_fields")[0].alias("reason"))


def q_parsed_split(spark, sf):
    """F13 where some tasks have no start: they are in neither part."""
    part = F.when(F.col("is_train") == 1, "train").when(F.col("is_train") == 0, "test").otherwise("none")
    return time_split(conform(text_tasks(spark, sf)), P.test_size).select("task_id", part.alias("part"))


def q_time_split_rejects(spark, sf):
    return without_start(conform(text_tasks(spark, sf))).select("task_id")


def q_cooldown_rules(spark, sf):
    """Q1 batch on the alerts of the rule scores."""
    alerts = scored(spark, sf).where(F.col("anomaly_flag") == 1).select(
        "engine_id", "task_id", F.col("actual_end_ts").alias("alert_time"))
    return cooldown_batch(pin(alerts, "rule-alerts"), P.alert_cooldown_minutes).select("task_id", "engine_id", "sent")


def q_scoring_results(spark, sf):
    s = scored(spark, sf)
    return rounded(s.select("task_id", "engine_id", "anomaly_flag", "anomaly_score",
                            F.col("if_score_norm").alias("if_score"),
                            F.col("ae_score_norm").alias("ae_score"), "if_flag", "ae_flag"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "forward_filled": q_forward_filled,
    "task_view": q_task_view,
    "time_features": q_time_features,
    "encodings": q_encodings,
    "context_features": q_context_features,
    "group_means": q_group_means,
    "dataset_profile": q_dataset_profile,
    "rolling_task": _q_rolling("task"),
    "rolling_module": _q_rolling("module"),
    "rolling_tech": _q_rolling("tech"),
    "feature_matrix": q_feature_matrix,
    "scaler_fit": q_scaler_fit,
    "scaled_features": q_scaled_features,
    "time_split": q_time_split,
    "score_thresholds": q_score_thresholds,
    "parsed_tasks": q_parsed_tasks,
    "rejected_tasks": q_rejected_tasks,
    "broken_lines": q_broken_lines,
    "parsed_split": q_parsed_split,
    "time_split_rejects": q_time_split_rejects,
    "cooldown_rules": q_cooldown_rules,
    "rule_scores": q_rule_scores,
    "ensemble": q_ensemble,
    "ensemble_static": q_ensemble_static,
    "classification_metrics": q_classification_metrics,
    "rank_metrics": q_rank_metrics,
    "confusion_matrix": q_confusion_matrix,
    "roc_curve": q_roc_curve,
    "pr_curve": q_pr_curve,
    "score_histogram": q_score_histogram,
    "score_boxplot": q_score_boxplot,
    "recommendations": q_recommendations,
    "metric_bands": q_metric_bands,
    "training_summary": q_training_summary,
    "scoring_summary": q_scoring_summary,
    "alert_events": q_alert_events,
    "calibration": q_calibration,
    "kpi_rolling": q_kpi_rolling,
    "scoring_results": q_scoring_results,
}


# ---------------------------------------------------------------- oracle SQL

def _sql() -> dict[str, str]:
    B = S.BASE
    out: dict[str, str] = {}
    task_doubles = {"tat_hours_engine", "mttr_hours_engine"}
    out["task_view"] = S.with_ctes(S.TASKS, body=f"SELECT {S.rounded(TASK_COLUMNS, task_doubles)} FROM tasks")
    p_dbl = {"planned_duration_minutes", "actual_duration_minutes", "start_lag_minutes",
             "end_lag_minutes", "duration_ratio", "duration_variance"}
    out["time_features"] = S.with_ctes(*B, body=f"SELECT task_id, {S.rounded(S.P_COLS, p_dbl)} FROM rf")
    n_dbl = {c for c in S.N_COLS if c.endswith(("_sin", "_cos"))}
    out["encodings"] = S.with_ctes(*B, body=f"SELECT task_id, {S.rounded(S.N_COLS, n_dbl)} FROM rf")
    x_int = {"tech_overload", "has_snags", "high_severity_snags", "kpi_stress", "is_overtime",
             "is_weekend", "is_night_shift", "is_peak_hours", "duration_outlier", "extreme_delay"}
    out["context_features"] = S.with_ctes(
        *B, body=f"SELECT task_id, {S.rounded(S.X_COLS, set(S.X_COLS) - x_int)} FROM rf")
    gm_cols = [g[0] for g in GROUP_MEANS]
    out["group_means"] = S.with_ctes(*B, S.GROUP_MEANS_CTE,
                                     body=f"SELECT task_id, {S.rounded(gm_cols, set(gm_cols))} FROM gm")
    out["dataset_profile"] = S.with_ctes(S.TASKS, body="""
SELECT count(*) AS rows, count(DISTINCT engine_id) AS engines, count(DISTINCT module_id) AS modules,
       count(DISTINCT tech_id) AS technicians, min(planned_start_ts) AS first_start,
       max(planned_start_ts) AS last_start, CAST(sum(is_anomaly) AS BIGINT) AS anomalies,
       round(avg(CAST(is_anomaly AS DOUBLE)), 6) + 0.0 AS anomaly_rate
FROM tasks""")
    for p in ("task", "module", "tech"):
        cols = rolling_columns(p)
        out[f"rolling_{p}"] = S.with_ctes(*B, S.rolling_cte(p),
                                          body=f"SELECT task_id, {S.rounded(cols, set(cols))} FROM r_{p}")
    F_ = S.FEATURES
    out["feature_matrix"] = S.with_ctes(*B, S.feature_matrix_cte(),
                                        body=f"SELECT task_id, is_anomaly, {S.rounded(F_, set(F_))} FROM fm")
    out["scaler_fit"] = S.with_ctes(*B, S.feature_matrix_cte(), S.scaler_cte(),
                                    body="SELECT feature, round(median, 6) + 0.0 AS median, "
                                         "round(scale, 6) + 0.0 AS scale FROM sc")
    out["scaled_features"] = S.with_ctes(*B, S.feature_matrix_cte(), S.scaler_cte(), body=S.scaled_body())
    out["time_split"] = S.with_ctes(S.TASKS, body=f"""
SELECT task_id, CAST(row_number() OVER (ORDER BY planned_start_ts, task_id)
       <= (SELECT CAST(floor(count(*) * {1 - P.test_size}) AS BIGINT) FROM tasks) AS INTEGER) AS is_train
FROM tasks""")
    out["rule_scores"] = S.with_ctes(*B, S.RULE_SCORES_CTE, body="""
SELECT task_id, round(if_score, 6) + 0.0 AS if_score, round(ae_score, 6) + 0.0 AS ae_score,
       if_flag, ae_flag, is_anomaly FROM rs""")
    ens_dbl = {"if_score_norm", "ae_score_norm", "anomaly_score"}
    ens_sel = ("SELECT task_id, round(if_n, 6) + 0.0 AS if_score_norm, round(ae_n, 6) + 0.0 AS ae_score_norm, "
               "round(anomaly_score, 6) + 0.0 AS anomaly_score, primary_flag, agreement_flag, anomaly_flag "
               "FROM scored")
    out["ensemble"] = S.with_ctes(*B, S.RULE_SCORES_CTE, S.ensemble_cte(), body=ens_sel)
    out["ensemble_static"] = S.with_ctes(*B, S.RULE_SCORES_CTE, S.ensemble_cte(static=True), body=ens_sel)
    E = (*B, S.RULE_SCORES_CTE, S.ensemble_cte())
    out["classification_metrics"] = S.with_ctes(*E, body="""
SELECT round(coalesce(tp / NULLIF(tp + fp, 0), 0.0), 6) + 0.0 AS precision,
       round(coalesce(tp / NULLIF(tp + fn, 0), 0.0), 6) + 0.0 AS recall,
       round(coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 6) + 0.0 AS f1_score,
       round((tp + fp) / n, 6) + 0.0 AS alert_rate,
       round((tp + fn) / n, 6) + 0.0 AS true_anomaly_rate,
       CAST(n AS BIGINT) AS total_samples, CAST(tp + fp AS BIGINT) AS anomalies_detected,
       CAST(tp + fn AS BIGINT) AS true_anomalies
FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
             CAST(sum(CASE WHEN is_anomaly = 1 AND anomaly_flag = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN is_anomaly = 0 AND anomaly_flag = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN is_anomaly = 1 AND anomaly_flag = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM scored WHERE is_anomaly IS NOT NULL)""")
    L = (*E, S.LONG_SCORES_CTE)
    out["rank_metrics"] = S.with_ctes(*L, body="""
SELECT a.model, round(a.auc_roc, 6) + 0.0 AS auc_roc, round(b.auc_pr, 6) + 0.0 AS auc_pr
FROM (SELECT model, CASE WHEN max(P) > 0 AND max(N) > 0
             THEN sum(pos * (cum_neg_asc - neg * 0.5)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE 0.5 END AS auc_roc
      FROM cum GROUP BY model) a
JOIN (SELECT model, CASE WHEN max(P) > 0
             THEN sum(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / max(P) ELSE 0.0 END AS auc_pr
      FROM cum GROUP BY model) b USING (model)""")
    out["confusion_matrix"] = S.with_ctes(*E, body="""
SELECT a.actual, a.predicted, CAST(count(s.task_id) AS BIGINT) AS n,
       round(count(s.task_id) * 100.0 / (SELECT count(*) FROM scored WHERE is_anomaly IS NOT NULL), 6) + 0.0 AS pct
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted)) a
LEFT JOIN scored s ON s.is_anomaly = a.actual AND s.anomaly_flag = a.predicted
GROUP BY a.actual, a.predicted""")
    out["roc_curve"] = S.with_ctes(*L, body="""
SELECT model, round(score, 6) + 0.0 AS threshold,
       round(coalesce(CAST(cum_neg AS DOUBLE) / NULLIF(N, 0), 0.0), 6) + 0.0 AS fpr,
       round(coalesce(CAST(cum_pos AS DOUBLE) / NULLIF(P, 0), 0.0), 6) + 0.0 AS tpr FROM cum
UNION ALL SELECT DISTINCT model, NULL, 0.0::DOUBLE, 0.0::DOUBLE FROM cum""")
    out["pr_curve"] = S.with_ctes(*L, body="""
SELECT model, round(score, 6) + 0.0 AS threshold,
       round(CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg), 6) + 0.0 AS precision,
       round(coalesce(CAST(cum_pos AS DOUBLE) / NULLIF(P, 0), 0.0), 6) + 0.0 AS recall FROM cum
UNION ALL SELECT DISTINCT model, NULL, 1.0::DOUBLE, 0.0::DOUBLE FROM cum""")
    out["score_histogram"] = S.with_ctes(*L, body="""
SELECT g.model, g.bin, round(any_value(g.lo) + g.bin * (any_value(g.hi) - any_value(g.lo)) / 50.0::DOUBLE, 6) + 0.0 AS lower,
       count(h.model) AS n
FROM (SELECT model, min(score) AS lo, max(score) AS hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM lg
      WHERE model <> 'flags' AND label IS NOT NULL AND score IS NOT NULL GROUP BY model) g
LEFT JOIN (SELECT lg.model, lo, hi,
             CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((score - lo) / ((hi - lo) / 50.0::DOUBLE)), 49) END AS INTEGER) AS bin
      FROM lg JOIN (SELECT model, min(score) AS lo, max(score) AS hi FROM lg
                    WHERE model <> 'flags' AND label IS NOT NULL AND score IS NOT NULL GROUP BY model) r USING (model)
      WHERE lg.label IS NOT NULL AND lg.score IS NOT NULL) h ON h.model = g.model AND h.bin = g.bin
GROUP BY g.model, g.bin""")
    out["score_boxplot"] = S.with_ctes(*L, body="""
SELECT model, round(q1, 6) + 0.0 AS q1, round(med, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3,
       round(q3 - q1, 6) + 0.0 AS iqr,
       round(min(CASE WHEN score >= q1 - 1.5 * (q3 - q1) THEN score END), 6) + 0.0 AS lower_whisker,
       round(max(CASE WHEN score <= q3 + 1.5 * (q3 - q1) THEN score END), 6) + 0.0 AS upper_whisker,
       CAST(sum(CASE WHEN score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM lg JOIN (SELECT model, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS med,
                     quantile_cont(score, 0.75) AS q3 FROM lg
              WHERE model <> 'flags' AND label IS NOT NULL AND score IS NOT NULL GROUP BY model) q USING (model)
WHERE label IS NOT NULL AND score IS NOT NULL
GROUP BY model, q1, med, q3""")
    evaluation = """
ev_row AS (
  SELECT coalesce(tp / NULLIF(tp + fp, 0), 0.0) AS precision, coalesce(tp / NULLIF(tp + fn, 0), 0.0) AS recall,
         coalesce(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1_score, (tp + fp) / n AS alert_rate,
         (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (cum_neg_asc - neg * 0.5)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE 0.5 END FROM cum WHERE model = 'ensemble') AS auc_roc,
         (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (cum_neg_asc - neg * 0.5)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE 0.5 END FROM cum WHERE model = 'isolation_forest') AS if_auc,
         (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (cum_neg_asc - neg * 0.5)) / (CAST(max(P) AS DOUBLE) * max(N)) ELSE 0.5 END FROM cum WHERE model = 'autoencoder') AS ae_auc
  FROM (SELECT CAST(count(*) AS DOUBLE) AS n,
               CAST(sum(CASE WHEN is_anomaly = 1 AND anomaly_flag = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
               CAST(sum(CASE WHEN is_anomaly = 0 AND anomaly_flag = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
               CAST(sum(CASE WHEN is_anomaly = 1 AND anomaly_flag = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
        FROM scored WHERE is_anomaly IS NOT NULL))"""
    recs = [("precision < 0.5", M.REC_LOW_PRECISION), ("recall < 0.7", M.REC_LOW_RECALL),
            ("alert_rate > 0.2", M.REC_HIGH_ALERTS), ("abs(if_auc - ae_auc) > 0.1", M.REC_MODEL_GAP)]
    rec_union = " UNION ALL ".join(f"SELECT {i} AS k, '{t}' AS recommendation FROM ev_row WHERE {c}"
                                   for i, (c, t) in enumerate(recs))
    out["recommendations"] = S.with_ctes(*L, evaluation, body=f"""
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position, recommendation
FROM ({rec_union}
      UNION ALL SELECT 99, '{M.REC_OK}' FROM ev_row
      WHERE NOT (precision < 0.5 OR recall < 0.7 OR alert_rate > 0.2 OR abs(if_auc - ae_auc) > 0.1))""")
    band_rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {m} AS value, CASE WHEN {m} < {lo} THEN 'poor' WHEN {m} < {hi} "
        f"THEN 'fair' ELSE 'good' END AS band FROM ev_row"
        for m, lo, hi in (("precision", 0.5, 0.8), ("recall", 0.5, 0.8), ("f1_score", 0.5, 0.8),
                          ("auc_roc", 0.5, 0.7)))
    out["metric_bands"] = S.with_ctes(*L, evaluation, body=f"""
SELECT metric, round(value, 6) + 0.0 AS value, band FROM ({band_rows})""")
    out["training_summary"] = S.with_ctes(S.TASKS, body=f"""
SELECT count(*) AS total_samples, CAST(floor(count(*) * {1 - P.test_size}) AS BIGINT) AS train_samples,
       count(*) - CAST(floor(count(*) * {1 - P.test_size}) AS BIGINT) AS test_samples,
       {len(S.FEATURES)} AS features, round(avg(CAST(is_anomaly AS DOUBLE)), 6) + 0.0 AS anomaly_rate,
       {P.if_weight}::DOUBLE AS isolation_forest_weight, {P.ae_weight}::DOUBLE AS autoencoder_weight
FROM tasks""")
    out["scoring_summary"] = S.with_ctes(*E, body="""
SELECT count(*) AS total_tasks, CAST(coalesce(sum(anomaly_flag), 0) AS BIGINT) AS anomalies_detected,
       round(avg(CAST(anomaly_flag AS DOUBLE)), 6) + 0.0 AS anomaly_rate FROM scored""")
    out["alert_events"] = S.with_ctes(*E, body="""
SELECT 'anomaly_detected' AS type, task_id, engine_id, round(anomaly_score, 6) + 0.0 AS anomaly_score,
       actual_end_ts AS timestamp FROM scored WHERE anomaly_flag = 1""")
    out["calibration"] = S.with_ctes(*E, body="""
SELECT g.bin, round(avg(anomaly_score), 6) + 0.0 AS mean_score,
       round(avg(CAST(is_anomaly AS DOUBLE)), 6) + 0.0 AS fraction_positive, count(s.task_id) AS n
FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS bin) g
LEFT JOIN (SELECT * FROM scored WHERE is_anomaly IS NOT NULL AND anomaly_score IS NOT NULL) s
  ON g.bin = least(greatest(floor(anomaly_score * 10), 0), 9)
GROUP BY g.bin""")
    out["score_thresholds"] = S.with_ctes(*E, body="""
SELECT round(quantile_cont(if_score, 0.93), 6) + 0.0 AS if_threshold,
       round(greatest(quantile_cont(ae_score, 0.9), avg(ae_score) + 2 * stddev_pop(ae_score)), 6) + 0.0 AS ae_threshold
FROM rs""")
    text = """
texts AS (
  SELECT * REPLACE (CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 11 <> 0 THEN planned_start_ts END AS planned_start_ts,
                    CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 17 <> 0 THEN actual_end_ts END AS actual_end_ts)
  FROM tasks)"""
    out["parsed_tasks"] = S.with_ctes(S.TASKS, text, body="""
SELECT task_id, planned_start_ts, planned_end_ts, actual_start_ts, actual_end_ts FROM texts
WHERE planned_start_ts IS NOT NULL AND actual_end_ts IS NOT NULL""")
    out["rejected_tasks"] = S.with_ctes(S.TASKS, text, body="""
SELECT task_id, concat_ws(',', CASE WHEN planned_start_ts IS NULL THEN 'planned_start_ts' END,
                          CASE WHEN actual_end_ts IS NULL THEN 'actual_end_ts' END) AS missing_fields
FROM texts WHERE planned_start_ts IS NULL OR actual_end_ts IS NULL""")
    out["broken_lines"] = S.with_ctes(S.TASKS, body="""
SELECT CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 19 = 0 THEN '{"task_id": "' || task_id || '", "planned' END AS line,
       CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 19 = 0 THEN '_raw_record' ELSE 'task_id' END AS reason
FROM tasks WHERE CAST(substr(task_id, 3) AS BIGINT) % 19 = 0 OR CAST(substr(task_id, 3) AS BIGINT) % 23 = 0""")
    out["parsed_split"] = S.with_ctes(S.TASKS, text, body="""
SELECT task_id, CASE WHEN planned_start_ts IS NULL THEN 'none'
         WHEN row_number() OVER (ORDER BY planned_start_ts NULLS LAST, task_id)
              <= (SELECT CAST(floor(count(planned_start_ts) * 0.8) AS BIGINT) FROM texts) THEN 'train' ELSE 'test' END AS part
FROM texts""")
    out["time_split_rejects"] = S.with_ctes(S.TASKS, text, body="SELECT task_id FROM texts WHERE planned_start_ts IS NULL")
    out["cooldown_rules"] = S.with_ctes(*E, """
al AS (SELECT engine_id, epoch_us(actual_end_ts) AS t, task_id FROM scored WHERE anomaly_flag = 1),
sent AS (
  SELECT engine_id, min({'t': t, 'id': task_id}) AS x FROM al GROUP BY engine_id
  UNION ALL
  SELECT engine_id, x FROM (
    SELECT s.engine_id, min({'t': al.t, 'id': al.task_id}) AS x FROM sent s
    JOIN al ON al.engine_id = s.engine_id AND al.t >= s.x.t + 1800000000 GROUP BY s.engine_id))""",
        body="""
SELECT al.task_id, al.engine_id, CAST(sent.x IS NOT NULL AS INTEGER) AS sent
FROM al LEFT JOIN sent ON sent.engine_id = al.engine_id AND sent.x.id = al.task_id""").replace("WITH", "WITH RECURSIVE", 1)
    kpi_cols = [f"kpi_{c}_{a}" for c, aggs in KPI_SPEC[1] for a in aggs]
    out["forward_filled"] = S.with_ctes(S.TASKS, body="""
SELECT task_id,
       round(coalesce(last_value(CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 37 = 0 THEN tat_hours_engine END IGNORE NULLS) OVER w, 0), 6) + 0.0 AS tat_hours_engine,
       coalesce(last_value(CASE WHEN CAST(substr(task_id, 3) AS BIGINT) % 3 <> 0 THEN snag_count END IGNORE NULLS) OVER w, 0) AS snag_count
FROM tasks
WINDOW w AS (PARTITION BY engine_id ORDER BY planned_start_ts, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    out["late_labels"] = S.with_ctes(S.TASKS, S.ROW_FEATURES, S.RULE_SCORES_CTE, S.ensemble_cte(), """
given AS (
  SELECT task_id, CAST(substr(task_id, 3) AS BIGINT) % 9 AS days, is_anomaly AS label FROM scored
  UNION ALL
  SELECT task_id, 6, 1 - is_anomaly FROM scored WHERE CAST(substr(task_id, 3) AS BIGINT) % 10 = 0)""", body="""
SELECT task_id, any_value(anomaly_flag) AS anomaly_flag, round(any_value(anomaly_score), 6) + 0.0 AS anomaly_score,
       CAST(max(days * 2 + label) % 2 AS INTEGER) AS is_anomaly, count(*) AS n_labels
FROM scored JOIN given USING (task_id) WHERE days <= 7 GROUP BY task_id""")
    out["kpi_rolling"] = S.with_ctes(*B, S.rolling_cte("kpi", KPI_SPEC[0], KPI_SPEC[1], S.FRAME_30D),
                                     body=f"SELECT task_id, {S.rounded(kpi_cols, set(kpi_cols))} FROM r_kpi")
    out["scoring_results"] = S.with_ctes(*E, body="""
SELECT task_id, engine_id, anomaly_flag, round(anomaly_score, 6) + 0.0 AS anomaly_score,
       round(if_n, 6) + 0.0 AS if_score, round(ae_n, 6) + 0.0 AS ae_score, if_flag, ae_flag FROM scored""")
    return out


def oracle_sql() -> dict[str, str]:
    return _sql()
