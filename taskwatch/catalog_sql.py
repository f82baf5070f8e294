"""DuckDB oracle SQL for the registered queries.

The SQL restates each operator independently over the driver's ``events``
view: same task view (FIXTURES.md §2), same feature rules, row-level window
functions instead of our bucketed plan. Doubles are rounded to 6 decimals on
both sides (``+ 0.0`` turns -0.0 into 0.0) so last-bit differences in
summation order do not count as mismatches.
"""

from __future__ import annotations

# Rolling aggregates per key, restated here so that the SQL does not follow the engine.
ROLLING_SPEC = {
    "task": ("task_name", [
        ("actual_minutes", ["mean", "std", "median", "min", "max"]),
        ("duration_ratio", ["mean", "std", "min", "max"]),
        ("snag_count", ["mean", "sum", "max"]),
        ("concurrent_tasks", ["mean", "max", "std"]),
        ("snag_severity", ["mean", "max"]),
        ("start_lag_minutes", ["mean", "std", "max"]),
        ("end_lag_minutes", ["mean", "std", "max"]),
    ]),
    "module": ("module_id", [
        ("actual_minutes", ["mean", "std", "median", "min", "max"]),
        ("duration_ratio", ["mean", "std", "min", "max"]),
        ("snag_count", ["mean", "sum", "max"]),
        ("snag_severity", ["mean", "max"]),
        ("concurrent_tasks", ["mean", "max"]),
    ]),
    "tech": ("tech_id", [
        ("actual_minutes", ["mean", "std"]),
        ("duration_ratio", ["mean", "std"]),
        ("snag_count", ["mean", "sum"]),
        ("concurrent_tasks", ["mean", "max"]),
    ]),
}

FRAME_7D = 7 * 86_400_000_000 - 1
FRAME_30D = 30 * 86_400_000_000 - 1

TASKS = """
ev AS (
  SELECT event_id AS eid, user_id AS uid, event_type, value,
         date_trunc('hour', ts) AS ps,
         60 + (event_id % 7) * 30 AS pm,
         CASE WHEN event_id % 13 = 3 THEN 250 ELSE 80 + event_id % 50 END AS pct,
         event_id % 30 + CASE WHEN event_id % 26 = 3 THEN 600 ELSE 0 END AS delay
  FROM events),
ev2 AS (SELECT *, CAST((pm * pct - (pm * pct) % 100) / 100 AS BIGINT) AS am FROM ev),
tasks AS (
  SELECT 'WO' || eid AS task_id, 'WO' || eid AS wo_id,
         'E' || (uid % 10) AS engine_id, 'M' || (uid % 20) AS module_id,
         'S' || (uid % 100) AS submodule_id, 'P' || (eid % 400) AS part_id,
         CAST(NULL AS VARCHAR) AS serial_no, event_type AS task_name,
         'B' || (eid % 5) AS bay_id,
         ps AS planned_start_ts,
         ps + to_minutes(CAST(pm AS BIGINT)) AS planned_end_ts,
         ps + to_minutes(CAST(delay AS BIGINT)) AS actual_start_ts,
         ps + to_minutes(CAST(delay + am AS BIGINT)) AS actual_end_ts,
         CAST(pm AS BIGINT) AS planned_minutes,
         am AS actual_minutes,
         'T' || uid AS tech_id,
         substr('ABC', CAST(uid % 3 + 1 AS INTEGER), 1) AS tech_grade,
         CAST(eid % 4 + 1 AS INTEGER) AS concurrent_tasks,
         CAST(CASE WHEN eid % 13 = 3 THEN 9 ELSE eid % 3 END AS INTEGER) AS snag_count,
         CAST(CASE WHEN eid % 13 = 3 THEN 3 ELSE eid % 2 END AS INTEGER) AS snag_severity,
         CAST(value AS DOUBLE) AS tat_hours_engine,
         CAST(eid % 25 + 5 AS INTEGER) AS wip_count_shop,
         CAST(value AS DOUBLE) / 4.0::DOUBLE AS mttr_hours_engine,
         CASE WHEN eid % 2 = 0 THEN 'D' ELSE 'N' END AS shift,
         CAST(isodow(ps) - 1 AS INTEGER) AS weekday,
         CAST(CASE WHEN eid % 13 = 3 THEN 1 ELSE 0 END AS INTEGER) AS is_anomaly
  FROM ev2)"""

ROW_FEATURES = """
rf1 AS (
  SELECT *,
    CAST(epoch_us(planned_end_ts) - epoch_us(planned_start_ts) AS DOUBLE) / 60000000.0::DOUBLE AS planned_duration_minutes,
    CAST(epoch_us(actual_end_ts) - epoch_us(actual_start_ts) AS DOUBLE) / 60000000.0::DOUBLE AS actual_duration_minutes,
    CAST(epoch_us(actual_start_ts) - epoch_us(planned_start_ts) AS DOUBLE) / 60000000.0::DOUBLE AS start_lag_minutes,
    CAST(epoch_us(actual_end_ts) - epoch_us(planned_end_ts) AS DOUBLE) / 60000000.0::DOUBLE AS end_lag_minutes,
    CAST(actual_minutes AS DOUBLE) / NULLIF(CAST(planned_minutes AS DOUBLE), 0) AS duration_ratio,
    CAST(actual_minutes - planned_minutes AS DOUBLE) AS duration_variance,
    CAST(hour(planned_start_ts) AS INTEGER) AS hour_of_day,
    CAST(isodow(planned_start_ts) - 1 AS INTEGER) AS day_of_week,
    CAST(month(planned_start_ts) AS INTEGER) AS month,
    CAST(day(planned_start_ts) AS INTEGER) AS day_of_month
  FROM tasks),
rf2 AS (
  SELECT *,
    CAST(dense_rank() OVER (ORDER BY tech_grade) - 1 AS INTEGER) AS tech_grade_encoded,
    CAST(coalesce(shift = 'D', false) AS INTEGER) AS shift_D,
    CAST(coalesce(shift = 'N', false) AS INTEGER) AS shift_N,
    CAST(CASE tech_grade WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'C' THEN 1 END AS INTEGER) AS tech_grade_ordinal,
    sin(2 * pi() * weekday / 7) AS weekday_sin, cos(2 * pi() * weekday / 7) AS weekday_cos,
    sin(2 * pi() * hour_of_day / 24) AS hour_sin, cos(2 * pi() * hour_of_day / 24) AS hour_cos,
    sin(2 * pi() * day_of_week / 7) AS day_sin, cos(2 * pi() * day_of_week / 7) AS day_cos,
    sin(2 * pi() * month / 12) AS month_sin, cos(2 * pi() * month / 12) AS month_cos
  FROM rf1),
rf AS (
  SELECT *,
    CAST(coalesce(concurrent_tasks >= 3, false) AS INTEGER) AS tech_overload,
    CAST(concurrent_tasks * tech_grade_ordinal AS DOUBLE) AS tech_load_score,
    planned_minutes / (CAST(actual_minutes AS DOUBLE) + 1e-6::DOUBLE) AS tech_efficiency,
    CAST(snag_count * snag_severity AS DOUBLE) AS snag_severity_weighted,
    CAST(coalesce(snag_count > 0, false) AS INTEGER) AS has_snags,
    CAST(coalesce(snag_severity >= 2, false) AS INTEGER) AS high_severity_snags,
    snag_count / (actual_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) AS snag_rate,
    (snag_count * snag_severity) / (actual_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) AS snag_intensity,
    tat_hours_engine / (planned_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) AS tat_efficiency,
    wip_count_shop / 20.0::DOUBLE AS wip_density,
    mttr_hours_engine / (planned_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) AS mttr_efficiency,
    CAST(coalesce(tat_hours_engine / (planned_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) > 1.5, false)
         OR coalesce(wip_count_shop / 20.0::DOUBLE > 0.8, false)
         OR coalesce(mttr_hours_engine / (planned_minutes / 60.0::DOUBLE + 1e-6::DOUBLE) > 1.2, false) AS INTEGER) AS kpi_stress,
    CAST(coalesce(hour_of_day >= 18, false) AS INTEGER) AS is_overtime,
    CAST(coalesce(day_of_week >= 5, false) AS INTEGER) AS is_weekend,
    CAST(coalesce(hour_of_day >= 22, false) OR coalesce(hour_of_day <= 6, false) AS INTEGER) AS is_night_shift,
    CAST(coalesce(hour_of_day >= 8 AND hour_of_day <= 17, false) AS INTEGER) AS is_peak_hours,
    CAST(coalesce(duration_ratio > 2.0, false) OR coalesce(duration_ratio < 0.3, false) AS INTEGER) AS duration_outlier,
    CAST(coalesce(start_lag_minutes > 60, false) OR coalesce(end_lag_minutes > 120, false) AS INTEGER) AS extreme_delay,
    abs(start_lag_minutes) + abs(end_lag_minutes) AS schedule_deviation
  FROM rf2)"""

P_COLS = ["planned_duration_minutes", "actual_duration_minutes", "start_lag_minutes",
          "end_lag_minutes", "duration_ratio", "duration_variance", "hour_of_day",
          "day_of_week", "month", "day_of_month"]
N_COLS = ["tech_grade_encoded", "shift_D", "shift_N", "tech_grade_ordinal",
          "weekday_sin", "weekday_cos", "hour_sin", "hour_cos", "day_sin", "day_cos",
          "month_sin", "month_cos"]
X_COLS = ["tech_overload", "tech_load_score", "tech_efficiency", "snag_severity_weighted",
          "has_snags", "high_severity_snags", "snag_rate", "snag_intensity", "tat_efficiency",
          "wip_density", "mttr_efficiency", "kpi_stress", "is_overtime", "is_weekend",
          "is_night_shift", "is_peak_hours", "duration_outlier", "extreme_delay",
          "schedule_deviation"]

_SQL_AGG = {"mean": "avg", "std": "stddev_samp", "median": "median", "min": "min",
            "max": "max", "sum": "sum"}


def rolling_cte(prefix: str, key: str | None = None, spec=None, frame: int = FRAME_7D,
                source: str = "rf") -> str:
    """Row-level RANGE windows, then forward fill in (start, task_id) order, then 0."""
    if spec is None:
        key, spec = ROLLING_SPEC[prefix]
    names, raw = [], []
    for col, aggs in spec:
        for agg in aggs:
            n = f"{prefix}_{col}_{agg}"
            names.append(n)
            raw.append(f"CAST({_SQL_AGG[agg]}(CAST({col} AS DOUBLE)) OVER w AS DOUBLE) AS {n}")
    filled = [f"coalesce({n}, last_value({n} IGNORE NULLS) OVER v, 0) AS {n}" for n in names]
    return f"""
r_{prefix}_raw AS (
  SELECT task_id, {key}, planned_start_ts, {', '.join(raw)}
  FROM {source}
  WINDOW w AS (PARTITION BY {key} ORDER BY epoch_us(planned_start_ts)
               RANGE BETWEEN {frame} PRECEDING AND CURRENT ROW)),
r_{prefix} AS (
  SELECT task_id, {', '.join(filled)}
  FROM r_{prefix}_raw
  WINDOW v AS (PARTITION BY {key} ORDER BY planned_start_ts, task_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


GROUP_MEANS_CTE = """
gm AS (
  SELECT task_id,
    avg(CAST(concurrent_tasks AS DOUBLE)) OVER (PARTITION BY bay_id) AS bay_utilization,
    avg(CAST(actual_minutes AS DOUBLE)) OVER (PARTITION BY module_id) AS module_complexity,
    avg(CAST(actual_minutes AS DOUBLE)) OVER (PARTITION BY task_name) AS task_complexity
  FROM rf)"""

# The ordered feature names.
FEATURES = (
    "planned_minutes actual_minutes planned_duration_minutes actual_duration_minutes start_lag_minutes "
    "end_lag_minutes duration_ratio duration_variance task_actual_minutes_mean task_actual_minutes_std "
    "task_actual_minutes_median task_actual_minutes_min task_actual_minutes_max task_duration_ratio_mean "
    "task_duration_ratio_std task_duration_ratio_min task_duration_ratio_max task_snag_count_mean "
    "task_snag_count_sum task_snag_count_max task_concurrent_tasks_mean task_concurrent_tasks_max "
    "task_concurrent_tasks_std task_snag_severity_mean task_snag_severity_max task_start_lag_minutes_mean "
    "task_start_lag_minutes_std task_start_lag_minutes_max task_end_lag_minutes_mean "
    "task_end_lag_minutes_std task_end_lag_minutes_max module_actual_minutes_mean "
    "module_actual_minutes_std module_actual_minutes_median module_actual_minutes_min "
    "module_actual_minutes_max module_duration_ratio_mean module_duration_ratio_std "
    "module_duration_ratio_min module_duration_ratio_max module_snag_count_mean module_snag_count_sum "
    "module_snag_count_max module_snag_severity_mean module_snag_severity_max "
    "module_concurrent_tasks_mean module_concurrent_tasks_max tech_actual_minutes_mean "
    "tech_actual_minutes_std tech_duration_ratio_mean tech_duration_ratio_std tech_snag_count_mean "
    "tech_snag_count_sum tech_concurrent_tasks_mean tech_concurrent_tasks_max concurrent_tasks "
    "tech_grade_encoded tech_overload tech_load_score tech_efficiency snag_count snag_severity "
    "snag_severity_weighted has_snags high_severity_snags snag_rate snag_intensity tat_hours_engine "
    "wip_count_shop mttr_hours_engine tat_efficiency wip_density mttr_efficiency kpi_stress hour_of_day "
    "day_of_week month day_of_month hour_sin hour_cos day_sin day_cos month_sin month_cos is_overtime "
    "is_weekend is_night_shift is_peak_hours duration_outlier extreme_delay schedule_deviation "
    "bay_utilization module_complexity task_complexity shift_D shift_N "
).split()


def feature_matrix_cte() -> str:
    cols = ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0) AS {f}" for f in FEATURES)
    return (rolling_cte("task") + "," + rolling_cte("module") + "," + rolling_cte("tech")
            + "," + GROUP_MEANS_CTE + f""",
fm AS (
  SELECT rf.task_id, rf.is_anomaly, rf.planned_start_ts, {cols}
  FROM rf JOIN r_task USING (task_id) JOIN r_module USING (task_id)
          JOIN r_tech USING (task_id) JOIN gm USING (task_id))""")


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def rounded(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" if c in doubles else c for c in cols)


BASE = (TASKS, ROW_FEATURES)


def scaler_cte() -> str:
    parts = []
    for f in FEATURES:
        parts.append(f"SELECT '{f}' AS feature, quantile_cont({f}, 0.25) AS q1, "
                     f"quantile_cont({f}, 0.5) AS q2, quantile_cont({f}, 0.75) AS q3 FROM fm")
    return """
sq AS (""" + "\nUNION ALL ".join(parts) + """),
sc AS (SELECT feature, q2 AS median, CASE WHEN q3 - q1 = 0 THEN 1.0 ELSE q3 - q1 END AS scale FROM sq)"""


def scaled_body() -> str:
    cols = ", ".join(
        f"round((fm.{f} - (SELECT median FROM sc WHERE feature = '{f}')) / "
        f"(SELECT scale FROM sc WHERE feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATURES)
    return f"SELECT task_id, {cols} FROM fm"


RULE_SCORES_CTE = """
rs AS (
  SELECT task_id, engine_id, actual_end_ts, is_anomaly,
         coalesce(duration_ratio, 0.0) AS if_score,
         schedule_deviation / 60.0::DOUBLE AS ae_score,
         duration_outlier AS if_flag, extreme_delay AS ae_flag
  FROM rf)"""


def ensemble_cte(static: bool = False, thr: float = 0.2, factor: float = 0.7,
                 w_if: float = 0.5, w_ae: float = 0.5, ranges: str | None = None) -> str:
    agree = repr(thr * factor)
    if static:
        blend = f"{w_if}::DOUBLE * if_n + {w_ae}::DOUBLE * ae_n"
    else:
        blend = (f"(abs(if_n - {thr}::DOUBLE) / (abs(if_n - {thr}::DOUBLE) + abs(ae_n - {thr}::DOUBLE) + 1e-6::DOUBLE)) * if_n"
                 f" + (abs(ae_n - {thr}::DOUBLE) / (abs(if_n - {thr}::DOUBLE) + abs(ae_n - {thr}::DOUBLE) + 1e-6::DOUBLE)) * ae_n")
    ranges = ranges or "SELECT min(if_score) AS if_lo, max(if_score) AS if_hi, min(ae_score) AS ae_lo, max(ae_score) AS ae_hi FROM rs"
    return f"""
rng AS ({ranges}),
nrm AS (
  SELECT rs.*,
    CASE WHEN if_hi = if_lo THEN 0.0 ELSE least(greatest((if_score - if_lo) / (if_hi - if_lo), 0.0), 1.0) END AS if_n,
    CASE WHEN ae_hi = ae_lo THEN 0.0 ELSE least(greatest((ae_score - ae_lo) / (ae_hi - ae_lo), 0.0), 1.0) END AS ae_n
  FROM rs, rng),
ens AS (
  SELECT nrm.*, {blend} AS anomaly_score FROM nrm),
ens2 AS (
  SELECT ens.*,
    CAST(anomaly_score > {thr}::DOUBLE AS INTEGER) AS primary_flag,
    CAST(anomaly_score > {agree}::DOUBLE AND coalesce(if_flag, 0) = 1 AND coalesce(ae_flag, 0) = 1 AS INTEGER) AS agreement_flag
  FROM ens),
scored AS (
  SELECT ens2.*, CAST(primary_flag = 1 OR agreement_flag = 1 AS INTEGER) AS anomaly_flag FROM ens2)"""


LONG_SCORES_CTE = """
lg AS (
  SELECT 'ensemble' AS model, anomaly_score AS score, CAST(is_anomaly AS BIGINT) AS label FROM scored
  UNION ALL SELECT 'isolation_forest', if_n, CAST(is_anomaly AS BIGINT) FROM scored
  UNION ALL SELECT 'autoencoder', ae_n, CAST(is_anomaly AS BIGINT) FROM scored
  UNION ALL SELECT 'flags', CAST(anomaly_flag AS DOUBLE), CAST(is_anomaly AS BIGINT) FROM scored),
cnt AS (
  SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM lg
  WHERE label IS NOT NULL AND score IS NOT NULL GROUP BY model, score),
cum AS (
  SELECT model, score, pos, neg,
    sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
    sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg,
    sum(neg) OVER (PARTITION BY model ORDER BY score ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg_asc,
    sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N
  FROM cnt)"""
