"""Small column helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: white space between words in every contract of this subpackage
WS = r"[\x20\x09-\x0D]+"
NOT_WS = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of ``text``; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of ``text`` match ``pattern``, a class or a run of one."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the
    body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: column that carries an input row whole where an operator needs names of its own
REC = "_rec"


def carried(df: DataFrame) -> DataFrame:
    """``df`` as one struct column, so that no column of it can clash with an
    operator's; ``REC + ".name"`` reads a column, ``REC + ".*"`` gives all back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(REC))
