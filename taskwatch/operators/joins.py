"""Keyed attachment of small derived tables to the row table.

``attach`` never broadcasts on faith: the right side is first materialised
in the shared checkpoint folder (which also cuts its lineage), counted, and
its size taken from the row count, the schema and the measured length of its
strings, arrays and maps. Below the limit it is
broadcast (no shuffle of the big side); above it, a plain equi-join lets
Spark shuffle both sides, with AQE splitting skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from taskwatch.session import pin

_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8,
    T.TimestampNTZType: 8,
}


def row_width(schema: T.StructType, string_bytes: int = 32) -> int:
    width = 16
    for f in schema.fields:
        w = next((v for k, v in _FIXED_WIDTH.items() if isinstance(f.dataType, k)), None)
        width += w if w is not None else string_bytes + 8
    return width


def _held(f: T.StructField):
    """Bytes in a value of variable length, as an expression; None for fixed ones."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(t, T.ArrayType):
        inner = next((w for k, w in _FIXED_WIDTH.items() if isinstance(t.elementType, k)), None)
        return F.size(c) * inner if inner else F.octet_length(F.to_json(c))
    if isinstance(t, (T.MapType, T.StructType)):
        return F.octet_length(F.to_json(c))
    return None


def measured(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Pin ``df`` and return it with its exact row count and its bytes."""
    pinned = pin(df)
    held = [e for e in map(_held, pinned.schema.fields) if e is not None]
    row = pinned.agg(F.count(F.lit(1)).alias("n"), *[F.sum(e.cast("long")).alias(f"h{i}") for i, e in enumerate(held)]).first()
    return pinned, row["n"], row["n"] * row_width(pinned.schema, 0) + sum(row[f"h{i}"] or 0 for i in range(len(held)))


def attach(left: DataFrame, right: DataFrame, keys: list[str],
           broadcast_limit_bytes: int = 64 << 20, how: str = "left",
           rows: int | None = None) -> DataFrame:
    """Join ``right`` onto ``left``; ``rows`` is the exact row count of ``right``
    when the caller already measured it (then ``right`` is not pinned again)."""
    if rows is None:
        right, _, size = measured(right)
    else:
        size = rows * row_width(right.schema)
    if size <= broadcast_limit_bytes:
        right = F.broadcast(right)
    return left.join(right, keys, how)
