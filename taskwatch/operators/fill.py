"""Forward fill per key (the optional fill of F4).

A missing value takes the last one of its key before it, in order of time,
ties by ``tie``. A hot key may hold a third of all rows, so rows are windowed
per (key, day); what a day inherits comes from a table of each key's last
values per day, one row per key and day, carried forward over days.

Rows without a key or without a time have no place in that order: they keep
their gaps and fill none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from taskwatch.operators.joins import attach


def forward_fill(df: DataFrame, columns: list[str], key: str, time: str, tie: str,
                 broadcast_limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with the gaps of ``columns`` filled; same rows, same columns."""
    placed = F.col(key).isNotNull() & F.col(time).isNotNull()
    day = F.to_date(time)
    ends = df.where(placed).groupBy(F.col(key).alias("_key"), day.alias("_day")).agg(*[
        F.max(F.when(F.col(c).isNotNull(), F.struct(time, tie, F.col(c).alias("v")))).alias(f"_e{i}")
        for i, c in enumerate(columns)])
    before = Window.partitionBy("_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_day", *[F.last(f"_e{i}.v", ignorenulls=True).over(before).alias(f"_c{i}")
                                            for i in range(len(columns))])
    within = Window.partitionBy("_key", "_day").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    own = df.where(placed).withColumns({"_key": F.col(key), "_day": day}).withColumns(
        {f"_o{i}": F.last(c, ignorenulls=True).over(within) for i, c in enumerate(columns)})
    filled = attach(own, carried, ["_key", "_day"], broadcast_limit_bytes)
    value = {c: F.coalesce(f"_o{i}", f"_c{i}").alias(c) for i, c in enumerate(columns)}
    return filled.select(*[value.get(c, F.col(c)) for c in df.columns]).unionByName(df.where(~placed))
