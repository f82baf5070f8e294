"""Context, workload and KPI features.

Comparisons against missing values are false in the reference, so every
predicate is wrapped in ``coalesce(p, false)`` and emitted as 0/1.

Fixed values: the thresholds below are the reference's feature rules.
    overload at 3 concurrent tasks; high severity at 2; epsilon 1e-6;
    wip density divisor 20; kpi stress: tat eff > 1.5, wip density > 0.8,
    mttr eff > 1.2; overtime hour >= 18; weekend day >= 5; night hour >= 22
    or <= 6; peak hours 8..17; duration outlier ratio > 2.0 or < 0.3;
    extreme delay start lag > 60 or end lag > 120 minutes
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6


def flag(p: Column) -> Column:
    return F.coalesce(p, F.lit(False)).cast("int")


def context_features() -> dict[str, Column]:
    c = F.col
    per_hour_actual = c("actual_minutes") / F.lit(60.0) + F.lit(EPS)
    per_hour_planned = c("planned_minutes") / F.lit(60.0) + F.lit(EPS)
    tat_eff = c("tat_hours_engine") / per_hour_planned
    wip_density = c("wip_count_shop") / F.lit(20.0)
    mttr_eff = c("mttr_hours_engine") / per_hour_planned
    hour = c("hour_of_day")
    return {
        "tech_overload": flag(c("concurrent_tasks") >= 3),
        "tech_load_score": (c("concurrent_tasks") * c("tech_grade_ordinal")).cast("double"),
        "tech_efficiency": c("planned_minutes") / (c("actual_minutes") + F.lit(EPS)),
        "snag_severity_weighted": (c("snag_count") * c("snag_severity")).cast("double"),
        "has_snags": flag(c("snag_count") > 0),
        "high_severity_snags": flag(c("snag_severity") >= 2),
        "snag_rate": c("snag_count") / per_hour_actual,
        "snag_intensity": (c("snag_count") * c("snag_severity")) / per_hour_actual,
        "tat_efficiency": tat_eff,
        "wip_density": wip_density,
        "mttr_efficiency": mttr_eff,
        "kpi_stress": flag(F.coalesce(tat_eff > 1.5, F.lit(False))
                           | F.coalesce(wip_density > 0.8, F.lit(False))
                           | F.coalesce(mttr_eff > 1.2, F.lit(False))),
        "is_overtime": flag(hour >= 18),
        "is_weekend": flag(c("day_of_week") >= 5),
        "is_night_shift": flag(F.coalesce(hour >= 22, F.lit(False)) | F.coalesce(hour <= 6, F.lit(False))),
        "is_peak_hours": flag((hour >= 8) & (hour <= 17)),
        "duration_outlier": flag(F.coalesce(c("duration_ratio") > 2.0, F.lit(False))
                                 | F.coalesce(c("duration_ratio") < 0.3, F.lit(False))),
        "extreme_delay": flag(F.coalesce(c("start_lag_minutes") > 60, F.lit(False))
                              | F.coalesce(c("end_lag_minutes") > 120, F.lit(False))),
        "schedule_deviation": F.abs(c("start_lag_minutes")) + F.abs(c("end_lag_minutes")),
    }
