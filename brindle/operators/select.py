"""Selections: declared filters and columns, and rows by their number."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.stable import kept

SEQ = "_row_seq"
OPERATORS = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
}


class SelectionError(ValueError):
    """A selection names columns that are not there, or compares what cannot be compared."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str  # eq ne gt ge lt le in not_null
    value: Any = None


def fits(t: T.DataType, value: Any) -> bool:
    """Whether a value compares with a column: numbers with numbers, texts with texts, booleans with booleans."""
    if isinstance(t, T.NumericType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, str) if isinstance(t, T.StringType) else isinstance(value, bool) if isinstance(t, T.BooleanType) else False


def condition(df: DataFrame, f: Filter) -> Column:
    """True or false, never null: a null passes no filter, ne included."""
    if f.column not in df.columns:
        raise SelectionError(f"filter on {f.column!r}, which is not there")
    column, t = F.col(f"`{f.column}`"), df.schema[f.column].dataType
    if f.op == "not_null":
        return column.isNotNull()
    if f.op != "in" and f.op not in OPERATORS:
        raise SelectionError(f"unknown operator {f.op!r}")
    values = [v for v in (f.value if f.op == "in" and isinstance(f.value, (list, tuple)) else [f.value]) if v is not None]
    if isinstance(t, T.NullType) or not values:
        return F.lit(False)
    if not all(fits(t, v) for v in values):
        raise SelectionError(f"{f.column} {f.op} {f.value!r} does not go with {t.simpleString()}")
    return F.coalesce(column.isin(*values) if f.op == "in" else OPERATORS[f.op](column, F.lit(values[0])), F.lit(False))


def select(df: DataFrame, filters: list[Filter] | tuple[Filter, ...] = (), columns: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The rows that pass all filters, and of them the columns listed, in that order (none: all)."""
    if missing := [c for c in columns if c not in df.columns]:
        raise SelectionError(f"no such columns: {missing}")
    for f in filters:
        df = df.where(condition(df, f))
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise SelectionError(f"no such columns to rename: {missing}")
    after = [names.get(c, c) for c in df.columns]
    if len({c.lower() for c in after}) < len(after):
        raise SelectionError("a new name is another column's already")
    return df.toDF(*after)


def numbered(df: DataFrame, order: list[Column] | None = None, name: str = SEQ) -> DataFrame:
    """df with row numbers from 0, by order, or as its partitions lie.

    A global number needs no gathering: rows are sorted by ranges, each range is counted, and a row's number is
    its place in its range after all ranges before, which are as many rows as there are partitions. Ranges
    rest on samples, and may fall out otherwise if they are computed anew, so that the sorted rows are kept.
    """
    placed = kept((df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_at", "_before")


def rows_at(df: DataFrame, indices: list[int], seq: str = SEQ) -> DataFrame:
    """The rows of the given numbers, in the order asked for; a number beyond the table is an error."""
    wanted = df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(indices)], f"`{seq}` long, _asked int")
    found = df.join(F.broadcast(wanted), seq)
    if found.count() != len(indices):
        raise IndexError("a row number lies beyond the table")
    return found.orderBy("_asked").drop("_asked")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`")).agg(F.count("*").alias("count"))
