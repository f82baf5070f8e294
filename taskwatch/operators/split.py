"""Time-ordered train/test split.

The reference sorts by planned start and keeps the first
``int(n * (1 - test_size))`` rows for training. Exact version here:

* count rows per distinct start time (aggregation, bounded by time grain),
* a global running count over those distinct times gives the cutoff time
  ``c`` and how many rows ``r`` tied at ``c`` still belong to training,
* rows before ``c`` train, after ``c`` test; the rows tied at ``c`` are
  ranked by ``task_id`` with the distributed row number and the first ``r``
  train. Only rows of one start time go through that ranking, and even those
  are range-partitioned, never gathered in one task.

A task without a planned start has no place in time: it belongs to neither
part (``is_train`` is NULL) and does not count towards the sizes. The jobs
write such tasks to their reject table before they split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskwatch.operators.prefix import global_prefix, global_row_number
from taskwatch.session import pin

TIME_COL = "planned_start_ts"


def train_size(n: int, test_size: float) -> int:
    return int(n * (1 - test_size))


def time_split(df: DataFrame, test_size: float = 0.2, time_col: str = TIME_COL,
               id_col: str = "task_id") -> DataFrame:
    """Add ``is_train`` (1 for the earliest rows, 0 for the rest)."""
    ts = F.col(time_col)
    per_time = df.where(ts.isNotNull()).groupBy(time_col).agg(F.count(F.lit(1)).alias("n"))
    cum = pin(global_prefix(per_time, [time_col], ["n"]))
    total = cum.agg(F.sum("n")).first()[0] or 0
    k = train_size(total, test_size)
    if k <= 0 or k >= total:
        return df.withColumn("is_train", F.when(ts.isNotNull(), F.lit(int(k > 0))))
    # first distinct time whose running count reaches k
    cut = (cum.where(F.col("cum_n") >= k)
           .agg(F.min_by(F.struct(time_col, "cum_n", "n"), F.col(time_col)).alias("c"))
           .first()["c"])
    cutoff, cum_n, n_at = cut[time_col], cut["cum_n"], cut["n"]
    remaining = k - (cum_n - n_at)
    cutoff = F.lit(cutoff.isoformat(sep=" ")).cast("timestamp_ntz")  # no driver time zone
    tied = global_row_number(df.where(ts == cutoff), [id_col], "__rn")
    tied = tied.withColumn("is_train", (F.col("__rn") <= remaining).cast("int")).drop("__rn")
    apart = df.where(ts.isNull() | (ts != cutoff)).withColumn("is_train", (ts < cutoff).cast("int"))
    return apart.unionByName(tied)


def without_start(df: DataFrame, time_col: str = TIME_COL) -> DataFrame:
    """The tasks that ``time_split`` can put into neither part."""
    return df.where(F.col(time_col).isNull())
