"""Categorical and cyclical encodings.

Category lists are fitted once and saved with the model, so a batch that
only holds day shifts still gets a ``shift_N`` column of zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Technician grade ordinal map of the reference (A best).
GRADE_ORDINAL = {"A": 3, "B": 2, "C": 1}

ONE_HOT_COLUMNS = ["shift"]
LABEL_COLUMNS = ["tech_grade"]


def fit_categories(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column; the result is tiny (categories only)."""
    if not columns:
        return {}
    aggs = [F.array_sort(F.collect_set(F.col(c))).alias(c) for c in columns]
    row = df.agg(*aggs).first()
    return {c: [v for v in (row[c] or [])] for c in columns}


def label_code(col: str, categories: list[str]) -> Column:
    """code = position in the sorted category list; unknown -> NULL."""
    expr = None
    for i, v in enumerate(categories):
        cond = F.col(col) == F.lit(v)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return F.lit(None).cast("int") if expr is None else expr


def one_hot(col: str, categories: list[str]) -> dict[str, Column]:
    """One 0/1 column per saved category."""
    return {f"{col}_{v}": F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0))
            for v in categories}


def grade_ordinal(col: str = "tech_grade") -> Column:
    """A=3, B=2, C=1; unknown grades give NULL."""
    m = F.create_map(*[x for k, v in GRADE_ORDINAL.items() for x in (F.lit(k), F.lit(v))])
    return m[F.col(col)]


def cyclic(col: str, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * F.col(col) / F.lit(period)
    return F.sin(angle), F.cos(angle)


def encoding_features(categories: dict[str, list[str]]) -> dict[str, Column]:
    """N1-N7 over a table that already has the P features."""
    out: dict[str, Column] = {}
    for c in LABEL_COLUMNS:
        out[f"{c}_encoded"] = label_code(c, categories.get(c, []))
    for c in ONE_HOT_COLUMNS:
        out.update(one_hot(c, categories.get(c, [])))
    out["tech_grade_ordinal"] = grade_ordinal()
    for name, src, period in (("weekday", "weekday", 7), ("hour", "hour_of_day", 24),
                              ("day", "day_of_week", 7), ("month", "month", 12)):
        s, c = cyclic(src, period)
        out[f"{name}_sin"] = s
        out[f"{name}_cos"] = c
    return out
