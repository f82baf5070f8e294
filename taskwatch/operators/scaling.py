"""Robust scaler (F7 fit, F8 apply): (x - median) / IQR, IQR 0 -> divide by 1.

The fit takes the exact quantiles of all columns together
(``quantiles.column_quantiles``): two passes over the rows, no shuffle of them.
Only the fitted numbers (two per feature) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskwatch.operators.quantiles import column_quantiles


def fit_robust_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Return {feature: (median, scale)} where scale = IQR, or 1 when IQR is 0."""
    found = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    out = {}
    for c in columns:
        q = found.get(c)
        if q is None or q[0] is None:
            out[c] = (0.0, 1.0)
            continue
        q1, med, q3 = (float(v) for v in q)
        iqr = q3 - q1
        out[c] = (med, iqr if iqr != 0.0 else 1.0)
    return out


def scaled_columns(params: dict[str, tuple[float, float]], columns: list[str]) -> list:
    return [((F.col(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c)
            for c in columns]


def apply_robust_scaler(df: DataFrame, params: dict[str, tuple[float, float]],
                        columns: list[str], keep: list[str] | None = None) -> DataFrame:
    keep = keep or []
    return df.select(*keep, *scaled_columns(params, columns))
