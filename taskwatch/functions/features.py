"""The ordered feature list (F1) and the identity columns."""

from __future__ import annotations

from taskwatch.operators.rolling import all_rolling_columns

# Non-rolling feature names of the reference, in its order.
CORE_FEATURES = [
    "planned_minutes", "actual_minutes", "planned_duration_minutes", "actual_duration_minutes",
    "start_lag_minutes", "end_lag_minutes", "duration_ratio", "duration_variance",
]
CONTEXT_FEATURES = [
    "concurrent_tasks", "tech_grade_encoded", "tech_overload", "tech_load_score", "tech_efficiency",
    "snag_count", "snag_severity", "snag_severity_weighted", "has_snags", "high_severity_snags",
    "snag_rate", "snag_intensity",
    "tat_hours_engine", "wip_count_shop", "mttr_hours_engine",
    "tat_efficiency", "wip_density", "mttr_efficiency", "kpi_stress",
]
TIMING_FEATURES = [
    "hour_of_day", "day_of_week", "month", "day_of_month",
    "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos",
    "is_overtime", "is_weekend", "is_night_shift", "is_peak_hours",
]
INDICATOR_FEATURES = ["duration_outlier", "extreme_delay", "schedule_deviation"]
RESOURCE_FEATURES = ["bay_utilization", "module_complexity", "task_complexity"]
ONE_HOT_PREFIX = "shift_"


def feature_names(shift_categories: list[str]) -> list[str]:
    """96 names for the reference's two shifts: 94 fixed + one per shift."""
    return (CORE_FEATURES + all_rolling_columns() + CONTEXT_FEATURES + TIMING_FEATURES
            + INDICATOR_FEATURES + RESOURCE_FEATURES
            + [f"{ONE_HOT_PREFIX}{v}" for v in shift_categories])
