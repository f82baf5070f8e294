"""Seven-day rolling statistics per key.

Semantics: for a task with planned start ``t`` the frame holds every task of
the same key whose start lies in ``(t - 7 days, t]`` (microsecond exact), ties
included, so the result does not depend on row order.

Plan (built for a hot key holding a large share of all rows):

1. Per key, one narrow aggregation gives the buckets ``(key, start)`` with
   count, sum, squared deviations from the bucket's mean, min and max of the
   columns this key needs, and, for medians, the triples ``(key, start,
   value)`` with their frequency. Partial aggregation runs map-side, so no task
   ever sees all rows of one key. The result is pinned and counted.
2. Chunks as wide as the frame. A frame that ends in a chunk is the end of the
   previous chunk, from ``t`` less 7 days on, and the beginning of its own, so
   its sums, minima and maxima are those of a suffix and a prefix (van Herk's
   scheme). Each chunk holds its own buckets and those of the previous chunk,
   the latter at the time when they leave the frames. Two running windows per
   chunk, one forwards over its own buckets, one backwards over those not yet
   left, give all statistics: constant work per bucket at any grain, and a
   key with few values still spreads over as many tasks as it has weeks.
   Nothing is subtracted, so nothing cancels; standard deviations add the
   buckets' squared deviations around one value of the chunk. Where no frame
   has more than ``DIRECT`` buckets (measured; hour-grain starts have at most
   168), a RANGE window adds them in order of time instead, as SQL does.
3. Medians: exact, from the triples, in the same chunks. A frame is a stretch
   of the triples in order of (key, time); all middle ranks of a chunk are found
   together in a wavelet matrix over the values (``kth_values``): every triple
   is placed once per bit of the number of distinct values, whatever the number
   of frames that hold it (linear interpolation between the two middle ranks,
   as ``percentile``).
4. Empty results (e.g. the std of a one-task frame) are forward filled from
   the previous bucket of the same key: inside the chunk by a window beside
   those of step 2, and across chunks by each chunk's last values, one row per
   key and chunk, joined only where a chunk still has gaps and an earlier value.
   Then the caller fills 0.

Each stats table is keyed by ``(key, start)`` and joined back to the rows.
Its exact row count is the bucket count from step 1, so the broadcast
decision is made on a measured size. Tasks without a planned start are in no
frame and get no statistics.
"""

from __future__ import annotations

import functools
import operator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from taskwatch.functions.time import US_PER_DAY, epoch_us
from taskwatch.operators.joins import attach
from taskwatch.session import parts_for, pin, ship_package

# Rolling aggregates per key, in the reference's column order.
ROLLING_SPEC: dict[str, tuple[str, list[tuple[str, list[str]]]]] = {
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

TIME_COL = "planned_start_ts"


@dataclass
class Carry:
    """What W17 needs when only the rows from ``since`` less one window on are
    given: each key's last values before ``since``, per prefix. The filled
    tables, exact from ``since`` on, are left in ``filled``."""
    since: Column | None = None
    before: dict[str, DataFrame] = field(default_factory=dict)
    filled: dict[str, DataFrame] = field(default_factory=dict)

    def last(self, prefix: str, key: str, until: Column, time_col: str = TIME_COL) -> DataFrame:
        """Each key's last values before ``until``."""
        t = self.filled[prefix]
        names = [c for c in t.columns if c not in (key, time_col)]
        rows = t.where((F.col(time_col) < until) & F.col(key).isNotNull()).select(
            key, *names, epoch_us(time_col).alias("__t"))
        if prefix in self.before:
            rows = rows.unionByName(self.before[prefix].withColumn("__t", F.lit(None).cast("long")))
        # rows carry filled values, so the latest one has all that is known
        return rows.groupBy(key).agg(*[F.max_by(n, F.coalesce("__t", F.lit(-(1 << 62)))).alias(n) for n in names])


def rolling_columns(prefix: str) -> list[str]:
    _, spec = ROLLING_SPEC[prefix]
    return [f"{prefix}_{col}_{agg}" for col, aggs in spec for agg in aggs]


def all_rolling_columns() -> list[str]:
    return [c for p in ROLLING_SPEC for c in rolling_columns(p)]


def _needs(aggs: list[str]) -> set[str]:
    need = {"n"}
    for a in aggs:
        need |= {"mean": {"s"}, "sum": {"s"}, "min": {"lo"}, "max": {"hi"},
                 "std": {"s", "m2", "lo", "hi"}, "median": set()}[a]
    return need


def _parts(col: str, needs: set[str]) -> list[Column]:
    found = {"n": F.count(col), "s": F.sum(col), "m2": F.var_pop(col) * F.count(col), "lo": F.min(col), "hi": F.max(col)}
    return [e.alias(f"{k}__{col}") for k, e in found.items() if k in needs]


def chunked(df: DataFrame, width: int) -> DataFrame:
    """Every row in its own chunk (``__own`` equals ``__c``) and, as history, in
    the next one; ``__at`` is when it enters the frames of the chunk, or leaves them."""
    copies = df.withColumn("__own", F.floor(F.col("__t") / F.lit(width))).withColumn(
        "__c", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    return copies.withColumn("__at", F.col("__t") + F.when(F.col("__own") == F.col("__c"), 0).otherwise(width))


#: frames of at most so many buckets are evaluated one by one
DIRECT = 512

_COMBINE = {"lo": (F.min, F.least), "hi": (F.max, F.greatest)}


def _source(part: str, col: str) -> Column:
    return F.col(f"__{part}__{col}" if part in ("d", "sq") else f"{part}__{col}")


def _framed(t: DataFrame, need: dict[str, set[str]], chunk, width: int, longest: int) -> DataFrame:
    """``t`` with ``f__<part>__<col>``, the parts of each own bucket's frame.
    Of short frames every bucket is added in order of time; longer ones
    are put together from a running total of the own chunk and one,
    backwards, of what has not left the previous chunk yet."""
    wanted = [(p, c) for c, parts in need.items() for p in sorted(parts | ({"d", "sq"} if "m2" in parts else set()) - {"m2"})]
    own = F.col("__own") == F.col("__c")
    if longest <= DIRECT:
        frame = chunk.orderBy("__t").rangeBetween(-(width - 1), 0)
        return t.withColumns({f"f__{p}__{c}": _COMBINE.get(p, (F.sum,))[0](_source(p, c)).over(frame) for p, c in wanted}).where(own)
    whole = (Window.unboundedPreceding, 0)
    # a bucket that leaves at the very start of an own one has left: backwards it comes after that
    ahead, back = chunk.orderBy("__at").rowsBetween(*whole), chunk.orderBy(F.desc("__at"), F.desc("__own")).rowsBetween(*whole)
    t = t.withColumns({f"p__{p}__{c}": _COMBINE.get(p, (F.sum,))[0](F.when(own, _source(p, c))).over(ahead) for p, c in wanted})
    t = t.withColumns({f"s__{p}__{c}": _COMBINE.get(p, (F.sum,))[0](F.when(~own, _source(p, c))).over(back) for p, c in wanted})

    def both(p, c):
        x, y = F.col(f"p__{p}__{c}"), F.col(f"s__{p}__{c}")
        return _COMBINE[p][1](x, y) if p in _COMBINE else F.coalesce(x + y, x, y)

    return t.where(own).withColumns({f"f__{p}__{c}": both(p, c) for p, c in wanted})


def _rolled(col: str, agg: str) -> Column:
    """One aggregate of one column from the parts of its frame."""
    n, lo, hi = F.col(f"f__n__{col}"), F.col(f"f__lo__{col}"), F.col(f"f__hi__{col}")
    if agg == "mean":
        return F.when(n > 0, F.col(f"f__s__{col}") / n)
    if agg == "sum":
        return F.when(n > 0, F.col(f"f__s__{col}"))
    if agg == "min":
        return lo
    if agg == "max":
        return hi
    if agg == "std":
        s, q = F.col(f"f__d__{col}"), F.col(f"f__sq__{col}")
        # a constant frame has std 0 exactly; rounding must not say otherwise
        return (F.when(n < 2, F.lit(None).cast("double")).when(lo == hi, F.lit(0.0))
                .otherwise(F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))))
    raise ValueError(f"unknown rolling aggregate {agg}")


def kth_values(rank: np.ndarray, weight: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each query the ``k``-th smallest (from 0, counted by ``weight``) of
    ``rank[start:end]``. A wavelet matrix, built and searched bit by bit from the
    highest: a stable split by the bit keeps every stretch together, and running
    sums say how much of it went to either side."""
    found, start, end, k = np.zeros(len(k), dtype=np.int64), start.copy(), end.copy(), k.copy()
    for bit in range(int(rank.max()).bit_length() - 1 if len(rank) else -1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        held = np.concatenate(([0], np.cumsum(np.where(one, 0, weight))))
        below = held[end] - held[start]
        up = k >= below
        k -= np.where(up, below, 0)
        found |= up.astype(np.int64) << bit
        start = np.where(up, zeros[-1] + start - zeros[start], zeros[start])
        end = np.where(up, zeros[-1] + end - zeros[end], zeros[end])
        rank, weight = np.concatenate((rank[~one], rank[one])), np.concatenate((weight[~one], weight[one]))
    return found


def _medians(k, t, v, f, chunk: int, width: int):
    """``(row of the bucket, median)`` of the buckets of ``chunk``; the arrays
    are sorted by (k, t). A bucket without a value (``v`` is NaN) has a frame too;
    the median of no values is NaN."""
    f, v = np.where(np.isnan(v), 0, f), np.where(np.isnan(v), np.inf, v)
    base = t.min()
    at = k * (t.max() - base + width + 1) + (t - base)   # one order over (key, time)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    own = first[np.floor_divide(t[first], width) == chunk]
    start = np.maximum(np.searchsorted(at, at[own] - width, side="right"), np.searchsorted(k, k[own], side="left"))
    end = np.searchsorted(at, at[own], side="right")
    values, rank = np.unique(v, return_inverse=True)
    held = np.concatenate(([0], np.cumsum(f)))
    middle = held[end] - held[start] - 1
    some = middle >= 0
    ranks = (np.where(some, middle // 2, 0), np.where(some, (middle + 1) // 2, 0))
    a, b = (values[np.minimum(kth_values(rank, f, start, end, r), len(values) - 1)] for r in ranks)
    return own, np.where(some, np.where(a == b, a, (a + b) / 2), np.nan)


def frame_medians(triples: DataFrame, key: str, val: str, name: str, days: int, n_buckets: int) -> DataFrame:
    """(key, __t, name): exact frame median per bucket from (key, __t, val, __f) triples.

    Groups are (hash bucket of key, chunk): many small keys share one group
    (one pandas call), a hot key still only brings two weeks of its values.
    """
    width = days * US_PER_DAY
    copies = chunked(triples.where(F.col("__t").isNotNull() & F.col(key).isNotNull()), width)
    copies = copies.select(key, "__t", val, "__f", "__c", F.pmod(F.hash(F.col(key)), F.lit(n_buckets)).alias("__b"))
    key_type = triples.schema[key].dataType.simpleString()

    def medians(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pdf[key])
        t = pdf["__t"].to_numpy()
        order = np.lexsort((t, codes))
        k, t = codes[order].astype("int64"), t[order]
        own, out = _medians(k, t, pdf[val].to_numpy(dtype=float)[order], pdf["__f"].to_numpy(dtype="int64")[order],
                            int(pdf["__c"].iloc[0]), width)
        found = pd.Series(out).astype(object).where(~np.isnan(out), None)   # NaN is no null to Spark
        return pd.DataFrame({key: pd.Series(names.take(k[own]), dtype=object), "__t": t[own], name: found})

    return copies.groupBy("__b", "__c").applyInPandas(medians, f"{key} {key_type}, __t long, {name} double")


def _stats(df: DataFrame, prefix: str, key: str, items: list, days: int, time_col: str,
           carry: Carry | None = None) -> tuple[DataFrame, int]:
    """(stats table, exact number of buckets) of one key."""
    spark, width = df.sparkSession, days * US_PER_DAY
    need: dict[str, set[str]] = {}
    for c, aggs in items:
        need.setdefault(c, set()).update(_needs(aggs))
    narrow = df.select(key, time_col, *[F.col(c).cast("double").alias(c) for c in need])
    buckets = pin(narrow.groupBy(key, time_col).agg(*[e for c, n in need.items() for e in _parts(c, n)])
                  .withColumn("__t", epoch_us(time_col)), "rolling-buckets")
    # the buckets of a key and chunk bound a frame's: those of two chunks at most
    size = (buckets.groupBy(key, F.floor(F.col("__t") / F.lit(width))).count()
            .agg(F.sum("count").alias("rows"), F.max("count").alias("most")).first())
    rows, longest = size["rows"] or 0, 2 * (size["most"] or 0)
    n_parts = parts_for(spark, 2 * rows)
    # this is the windows' own exchange; the explicit count keeps AQE from
    # coalescing the CPU-heavy windows into few tasks
    t = chunked(buckets, width).repartition(n_parts, key, "__c")
    chunk = Window.partitionBy(key, "__c")
    squared = [c for c, n in need.items() if "m2" in n]
    t = t.withColumns({f"__d__{c}": F.col(f"s__{c}") - F.col(f"n__{c}") * F.min(f"lo__{c}").over(chunk) for c in squared})
    t = t.withColumns({
        f"__sq__{c}": F.col(f"m2__{c}") + F.try_divide(F.col(f"__d__{c}") * F.col(f"__d__{c}"), F.col(f"n__{c}")) for c in squared})
    names = [f"{prefix}_{c}_{a}" for c, aggs in items for a in aggs]
    t = _framed(t, need, chunk, width, longest).select(key, time_col, "__t", "__c", *[
        _rolled(c, a).alias(f"{prefix}_{c}_{a}") for c, aggs in items for a in aggs if a != "median"])
    for c, aggs in items:
        if "median" in aggs:
            ship_package(spark)
            triples = (narrow.groupBy(key, time_col, c).agg(F.count(F.lit(1)).alias("__f"))
                       .withColumn("__t", epoch_us(time_col)))
            med = frame_medians(triples, key, c, f"{prefix}_{c}_median", days, n_parts)
            t = t.join(med, [key, "__t"], "left")
    if carry is not None and carry.since is not None:
        t = t.where(F.col(time_col) >= carry.since)   # frames of earlier ones are cut off
    # the fill inside a chunk, on the windows' own partitions and order
    ahead = chunk.orderBy("__t")
    t = t.withColumns({n: F.coalesce(n, F.last(n, ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1))) for n in names}
                      | {"__ends": F.lead("__t").over(ahead).isNull()})
    t = pin(t, "rolling-stats")
    if carry is None:
        return _filled(t, key, time_col, names), rows
    carry.filled[prefix] = pin(_filled(t, key, time_col, names, carry.before.get(prefix)), "rolling-filled")
    return carry.filled[prefix], rows


def _filled(t: DataFrame, key: str, time_col: str, names: list[str], before: DataFrame | None = None) -> DataFrame:
    """W17 across chunks: values still empty in a chunk take the key's latest of an
    earlier one (each chunk's last row has all that is known there), at last that
    of ``before``. Only what chunks with such gaps inherit is joined."""
    def some(found):
        return functools.reduce(operator.or_, found)

    gaps = t.where(some(F.col(n).isNull() for n in names)).select(key, "__c").distinct()
    earlier = Window.partitionBy(key).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    held = t.where("__ends").select(key, "__c", *[F.last(n, ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in names])
    held = held.where(some(F.col(f"__before_{n}").isNotNull() for n in names)).join(gaps, [key, "__c"], "left_semi")
    out = attach(t, held, [key, "__c"], rows=held.count()).withColumns({n: F.coalesce(n, f"__before_{n}") for n in names})
    out = out.select(key, time_col, *names)
    if before is None:
        return out
    old = before.select(key, *[F.col(n).alias(f"__old_{n}") for n in names])
    return out.join(old, key, "left").select(key, time_col, *[F.coalesce(n, f"__old_{n}").alias(n) for n in names])


def rolling_tables(df: DataFrame, specs: dict[str, tuple[str, list]], days: int = 7,
                   time_col: str = TIME_COL, carry: Carry | None = None) -> dict[str, tuple[DataFrame, int, str]]:
    """{prefix: (stats table, exact row count, key)}. The tables do not depend on
    each other, so their jobs are submitted side by side and share the cores."""
    def one(prefix):
        key, items = specs[prefix]
        return (*_stats(df, prefix, key, items, days, time_col, carry), key)

    ship_package(df.sparkSession)
    with ThreadPoolExecutor(max(1, len(specs))) as pool:
        found = {p: pool.submit(inheritable_thread_target(df.sparkSession)(one), p) for p in specs}
        return {p: f.result() for p, f in found.items()}


def rolling_stats(df: DataFrame, prefix: str, days: int = 7,
                  time_col: str = TIME_COL, spec=None) -> DataFrame:
    """Stats table ``(key, time_col, <prefix>_<col>_<agg>...)`` for one key."""
    spec = spec if spec is not None else ROLLING_SPEC[prefix]
    return rolling_tables(df, {prefix: spec}, days, time_col)[prefix][0]


def with_rolling_features(df: DataFrame, prefixes=("task", "module", "tech"), days: int = 7,
                          time_col: str = TIME_COL, broadcast_limit_bytes: int = 64 << 20,
                          specs: dict | None = None, carry: Carry | None = None,
                          onto: DataFrame | None = None) -> DataFrame:
    """Attach every rolling column to its own row (joined on key + start): to
    the rows of ``df``, or of ``onto`` where they are given with fewer columns.
    The largest table comes first: where it takes a shuffle, rows are still narrow."""
    specs = specs or {p: ROLLING_SPEC[p] for p in prefixes}
    out = df if onto is None else onto
    for stats, rows, key in sorted(rolling_tables(df, specs, days, time_col, carry).values(), key=lambda t: -t[1]):
        out = attach(out, stats, [key, time_col], broadcast_limit_bytes, rows=rows)
    return out
