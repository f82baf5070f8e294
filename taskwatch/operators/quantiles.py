"""Exact quantiles per group, distributed.

Spark's ``percentile`` keeps all distinct values of a group in one task. Here
the values are counted per (group, value), the counts get a running total over
a range partitioning (``prefix.global_prefix``), and the values at the wanted
ranks are read off with one aggregation. A group may hold any share of the
rows. The interpolation is that of ``percentile``: linear between the two
neighbouring ranks.

Of whole columns (``column_quantiles``) not even the counted values are moved.
A quantile summary of each column, made in one pass and merged per column (no
task sees the summaries of more than one), brackets every wanted rank between two values; a second pass
counts what lies below each bracket and keeps the values inside it alone, a few
``1 / ACCURACY`` of the rows. The counts say at which rank inside the bracket
the answer lies, and those few values are ranked as above. A bracket is never
trusted: where the counts show that a rank lies outside, that column is ranked
whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskwatch.operators.prefix import global_prefix
from taskwatch.session import pin, ship_package

#: values a column's summary keeps of a batch; a whole task's keeps half of it
ACCURACY = 4_000
#: so many summaries of one level are merged to one of the next
FAN_IN = 8


def exact_quantiles(long: DataFrame, probs: list[float], group: str = "feature",
                    value: str = "value") -> DataFrame:
    """``(group, q)``: the quantiles of each group, in the order of ``probs``.
    Null values do not count; a group without values has no row."""
    counts = pin(long.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")),
                 "quantile-counts")
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    cum = global_prefix(counts, [value], ["n"], group_cols=[group])
    t = cum.join(totals, group)
    exprs = []
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        exprs += [F.min(F.when(F.col("cum_n") > F.floor(pos), F.col(value))).alias(f"lo{i}"),
                  F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col(value))).alias(f"hi{i}")]
    found = t.groupBy(group, "total").agg(*exprs)
    out = []
    for i, p in enumerate(probs):
        pos = (F.col("total") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi))
    return found.select(group, F.array(*out).alias("q"))


def summary(values: np.ndarray, weight: np.ndarray | None, size: int) -> tuple[np.ndarray, np.ndarray, float]:
    """About ``size`` of the distinct ``values``, ascending, each with its weight
    and that of the values passed over since the one before, and the error: by so
    much at most the weight up to any value falls short (it never exceeds it)."""
    order = np.argsort(values, kind="stable") if weight is not None else None
    v = values[order] if weight is not None else np.sort(values)
    last = np.flatnonzero(np.append(v[1:] != v[:-1], True)) if len(v) else np.zeros(0, dtype=np.int64)
    upto = np.cumsum(weight[order])[last] if weight is not None else last + 1
    v = v[last]
    if len(v) <= size:
        return v, np.diff(upto, prepend=0), 0.0
    own = np.diff(upto, prepend=0)
    cell = upto * size // upto[-1]
    kept = np.flatnonzero(np.append(cell[1:] != cell[:-1], True))
    weight = np.diff(upto[kept], prepend=0)
    return v[kept], weight, float((weight - own[kept]).max())


class _Summary:
    """The summary of a stream of batches of one column, merged level by level."""

    def __init__(self):
        self.levels, self.error = [[]], 0.0

    def add(self, values: np.ndarray, weight: np.ndarray | None = None, level: int = 0) -> None:
        v, w, e = summary(values, weight, ACCURACY)
        self.error += e
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append((v, w))
        if len(self.levels[level]) == FAN_IN:
            parts, self.levels[level] = self.levels[level], []
            self.add(*(np.concatenate(x) for x in zip(*parts)), level + 1)

    def whole(self) -> tuple[np.ndarray, np.ndarray, float]:
        parts = [p for level in self.levels for p in level]
        v, w, e = summary(*(np.concatenate(x) for x in zip(*parts)), max(1, ACCURACY // 2))
        return v, w, self.error + e


def _summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value[], weight[], error): per task and column the summary of its values."""

    def summarise(batches):
        held = [_Summary() for _ in columns]
        for b in batches:
            for j, h in enumerate(held):
                x = b.column(j).drop_null().to_numpy(zero_copy_only=False)
                if len(x):
                    h.add(x)
        rows = [(j, *h.whole()) for j, h in enumerate(held) if any(h.levels)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
             pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.float64())],
            names=["feature", "value", "weight", "error"])

    return df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(
        summarise, "feature int, value array<double>, weight array<long>, error double")


def _brackets(df: DataFrame, columns: list[str], probs: list[float]) -> tuple[dict, dict]:
    """Number of values of each column, and per column and probability two
    values between which the wanted rank lies."""
    def bracket(table: pa.Table) -> pa.Table:
        value = table.column("value").combine_chunks().flatten().to_numpy()
        weight = table.column("weight").combine_chunks().flatten().to_numpy()
        error = sum(table.column("error").to_pylist())
        order = np.argsort(value, kind="stable")
        value, upto = value[order], np.cumsum(weight[order])
        ends = []
        for p in probs:
            pos = (int(upto[-1]) - 1) * p
            low = math.floor(pos) - error   # up to ``error`` more values lie before one than their weights say
            ends += [value[np.searchsorted(upto, low, side="right")] if low >= 0 else -math.inf,
                     value[min(np.searchsorted(upto, math.ceil(pos), side="right"), len(value) - 1)]]
        return pa.table({"feature": pa.array([table.column("feature")[0].as_py()], pa.int32()),
                         "n": pa.array([int(upto[-1])], pa.int64()), "q": pa.array([ends], pa.list_(pa.float64()))})

    ship_package(df.sparkSession)
    rows = _summaries(df, columns).groupBy("feature").applyInArrow(
        bracket, "feature int, n long, q array<double>").collect()   # one row a column
    found = {columns[r["feature"]]: (r["n"], r["q"]) for r in rows}
    return ({c: found[c][0] if c in found else 0 for c in columns},
            {c: [(q[2 * i], q[2 * i + 1]) for i in range(len(probs))] for c, (_, q) in sorted(found.items(), key=lambda x: columns.index(x[0]))})


def _inside(df: DataFrame, brackets: dict) -> DataFrame:
    """(feature, i, value, n) of the values inside the brackets; a null value
    stands for all below bracket ``i`` of the feature."""
    columns = list(brackets)
    low = np.array([[b[0] for b in brackets[c]] for c in columns])
    high = np.array([[b[1] for b in brackets[c]] for c in columns])

    def count(batches):
        below = np.zeros(low.shape, dtype=np.int64)
        for b in batches:
            out = []
            for j in range(len(columns)):
                x = b.column(j).drop_null().to_numpy(zero_copy_only=False)
                for i in range(low.shape[1]):
                    less = x < low[j, i]
                    below[j, i] += less.sum()
                    values, n = np.unique(x[~less & (x <= high[j, i])], return_counts=True)
                    out.append((np.full(len(n), j), np.full(len(n), i), values, n))
            yield batch(*(np.concatenate(c) for c in zip(*out)))
        j, i = np.nonzero(below)
        yield batch(j, i, pa.nulls(len(j), pa.float64()), below[j, i])

    def batch(j, i, values, n):
        return pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(i, pa.int32()), pa.array(values, pa.float64()),
                                           pa.array(n, pa.int64())], names=["feature", "i", "value", "n"])

    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in columns]).mapInArrow(
        count, "feature int, i int, value double, n long")
    return rows.groupBy("feature", "i", "value").agg(F.sum("n").alias("n"))


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float] | None]:
    """The exact quantiles of each column, None for a column without values.
    ``df`` is read twice."""
    if not columns:
        return {}
    spark = df.sparkSession
    total, brackets = _brackets(df, columns, probs)
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    if not brackets:
        return out
    names = list(brackets)
    counted = pin(_inside(df, brackets), "quantile-brackets")
    sums = counted.groupBy("feature", "i").agg(   # one row per column and probability
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("below"), F.sum("n").alias("upto")).collect()
    seen = {(r["feature"], r["i"]): (r["below"], r["upto"]) for r in sums}
    wanted, whole = [], set()
    for j, c in enumerate(names):
        for i, p in enumerate(probs):
            pos = (total[c] - 1) * p
            below, upto = seen.get((j, i), (0, 0))
            if not below <= math.floor(pos) <= math.ceil(pos) < upto:
                whole.add(c)
            wanted.append((j, i, math.floor(pos) - below, math.ceil(pos) - below))
    ranks = F.broadcast(spark.createDataFrame(wanted, "feature int, i int, a long, b long"))
    cum = global_prefix(counted.where(F.col("value").isNotNull()), ["value"], ["n"], group_cols=["feature", "i"])
    found = cum.join(ranks, ["feature", "i"]).groupBy("feature", "i").agg(
        F.min(F.when(F.col("cum_n") > F.col("a"), F.col("value"))).alias("lo"),
        F.min(F.when(F.col("cum_n") > F.col("b"), F.col("value"))).alias("hi")).collect()
    at = {(r["feature"], r["i"]): (r["lo"], r["hi"]) for r in found}
    for j, c in enumerate(names):
        if c in whole:
            long = df.select(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
            out[c] = exact_quantiles(long, probs).first()["q"]
            continue
        out[c] = []
        for i, p in enumerate(probs):
            pos, (lo, hi) = (total[c] - 1) * p, at[j, i]
            out[c].append(lo if lo == hi else (math.ceil(pos) - pos) * lo + (pos - math.floor(pos)) * hi)
    return out


def quantile_of(df: DataFrame, column: str, prob: float) -> float | None:
    """One exact quantile of one column."""
    q = column_quantiles(df, [column], [prob])[column]
    return None if q is None else float(q[0])
