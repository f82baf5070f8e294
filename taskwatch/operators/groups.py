"""Group means broadcast to rows (A1-A3) and the dataset profile (A4).

Group means are fitted once (on training data) and applied by a keyed join;
keys unseen at fit take the global mean. The fitted tables have one row per
key value, so they are small, but ``attach`` still counts them before
deciding to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taskwatch.operators.joins import attach
from taskwatch.session import pin

# Fixed values: (output column, key, averaged column) of the reference.
GROUP_MEANS = [
    ("bay_utilization", "bay_id", "concurrent_tasks"),
    ("module_complexity", "module_id", "actual_minutes"),
    ("task_complexity", "task_name", "actual_minutes"),
]


def fit_group_means(df: DataFrame) -> dict[str, DataFrame]:
    """One small table per output column: (key, mean).

    All three come from one GROUPING SETS aggregation (one scan, one
    shuffle), pinned once in the shared checkpoint folder.
    """
    keys = list(dict.fromkeys(k for _, k, _ in GROUP_MEANS))
    aggs = [F.avg(F.col(val).cast("double")).alias(out) for out, _, val in GROUP_MEANS]
    table = pin(df.groupingSets([[k] for k in keys], *keys)
                .agg(*aggs, F.grouping_id().alias("__g")), "group-means")
    out = {}
    for name, key, _ in GROUP_MEANS:
        gid = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k != key)
        out[name] = table.where(F.col("__g") == gid).select(key, name)
    return out


def table_sizes(tables: dict[str, DataFrame]) -> dict[str, int]:
    parts = [t.select(F.lit(name).alias("t")) for name, t in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    counts = {r["t"]: r["n"] for r in union.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {name: counts.get(name, 0) for name in tables}


def fit_global_means(df: DataFrame) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(val).cast("double")).alias(out)
                   for out, _, val in GROUP_MEANS]).first()
    return {out: row[out] for out, _, _ in GROUP_MEANS}


def apply_group_means(df: DataFrame, tables: dict[str, DataFrame],
                      global_means: dict[str, float] | None = None,
                      broadcast_limit_bytes: int = 64 << 20) -> DataFrame:
    out = df
    # fitted tables are pinned (or read from disk): one small job counts all of them
    sizes = table_sizes(tables)
    for name, key, _ in GROUP_MEANS:
        out = attach(out, tables[name], [key], broadcast_limit_bytes, rows=sizes[name])
        if global_means is not None and global_means.get(name) is not None:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(float(global_means[name]))))
    return out


def dataset_profile(df: DataFrame) -> DataFrame:
    """A4: one row describing a task table."""
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("engine_id").alias("engines"),
        F.countDistinct("module_id").alias("modules"),
        F.countDistinct("tech_id").alias("technicians"),
        F.min("planned_start_ts").alias("first_start"),
        F.max("planned_start_ts").alias("last_start"),
    ]
    if "is_anomaly" in df.columns:
        aggs += [F.sum("is_anomaly").cast("bigint").alias("anomalies"),
                 F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate")]
    return df.agg(*aggs)
