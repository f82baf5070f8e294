"""Exact running totals over a global order, without a one-partition window.

A window ``ORDER BY x`` with no ``PARTITION BY`` moves every row into one
task. Instead:

1. range-partition the rows on the order columns (a sampled, balanced
   split; Spark's range partitioner) and tag each row with its partition id;
2. pin that result in the shared checkpoint folder, so both uses below see
   the same partition assignment even if executors are lost;
3. total each partition (one row per partition), turn the totals into
   offsets with a window over those few rows, and broadcast them (their
   number is the partition count, a proven bound);
4. add a per-partition running total, which runs in parallel.

The order columns must form a unique key (callers first group by the score
or add a tie-breaker), so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taskwatch.session import pin


def _order_exprs(order_cols: list[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]


def global_prefix(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                  descending: bool = False, n_parts: int | None = None,
                  prefix: str = "cum_", group_cols: list[str] | None = None) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over all rows up to and including this one.

    With ``group_cols`` the running totals restart for every group (for
    example one curve per model), still without gathering a group in one task.
    """
    spark = df.sparkSession
    groups = list(group_cols or [])
    if n_parts is None:
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _order_exprs(order_cols, descending)
    ranged = pin(df.repartitionByRange(n_parts, *[F.col(g).asc() for g in groups], *order)
                 .withColumn("__pid", F.spark_partition_id()))
    totals = ranged.groupBy("__pid", *groups).agg(*[F.sum(c).alias(f"__tot_{c}") for c in sum_cols])
    before = Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", *groups, *[
        F.coalesce(F.sum(f"__tot_{c}").over(before), F.lit(0)).alias(f"__off_{c}") for c in sum_cols])
    within = (Window.partitionBy("__pid", *groups).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.join(F.broadcast(offsets), ["__pid", *groups], "left")
    out = out.withColumns({f"{prefix}{c}": F.col(f"__off_{c}") + F.sum(c).over(within)
                           for c in sum_cols})
    return out.drop("__pid", *[f"__off_{c}" for c in sum_cols])


def global_row_number(df: DataFrame, order_cols: list[str], name: str = "row_number",
                      n_parts: int | None = None) -> DataFrame:
    """1-based position of each row in the global order of ``order_cols``."""
    tmp = df.withColumn("__one", F.lit(1).cast("bigint"))
    out = global_prefix(tmp, order_cols, ["__one"], n_parts=n_parts)
    return out.withColumnRenamed("cum___one", name).drop("__one")
