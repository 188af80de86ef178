"""Pages of rows: filters typed by their columns, sorts with nulls last, row numbers as the last tie-breaker."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTERS, MAX_VALUES, MAX_SORTS, MAX_PAGE = 16, 100, 8, 500
_OPS = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}


class PlanError(ValueError):
    """A request that does not fit the table; no row has been read."""


@dataclass(frozen=True)
class RowFilter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class RowsPlan:
    columns: tuple[str, ...] = ()
    filters: tuple[RowFilter, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    limit: int = 100
    count: str | None = None  # exact or none; by default none where rows are filtered


def parse_filters(items: list[dict]) -> tuple[RowFilter, ...]:
    out = []
    for f in items:
        op, value = f.get("op"), f.get("value")
        if op not in (*_OPS, "in", "is_null", "is_not_null") or set(f) - {"column", "op", "value"}:
            raise PlanError(f"not a filter: {f}")
        if op == "in" and (not isinstance(value, list) or not 1 <= len(value) <= MAX_VALUES):
            raise PlanError(f"in takes 1 to {MAX_VALUES} values")
        if (op in ("is_null", "is_not_null")) != (value is None):
            raise PlanError(f"{op} and a value do not go together" if value is not None else f"{op} needs a value")
        out.append(RowFilter(f["column"], op, tuple(value) if op == "in" else value))
    if len(out) > MAX_FILTERS:
        raise PlanError(f"at most {MAX_FILTERS} filters")
    return tuple(out)


def _typed(df: DataFrame, column: str, values: list[Any]) -> list[Column]:
    """values as literals of the column's type; one that does not fit is refused before the table is read."""
    t = df.schema[column].dataType
    out = [F.lit(v).try_cast(t) for v in values]
    row = df.sparkSession.range(1).select(*(v.isNull().alias(f"n{i}") for i, v in enumerate(out))).first()
    if bad := [v for v, missing in zip(values, row, strict=True) if missing]:
        raise PlanError(f"{bad[0]!r} is no {t.simpleString()}, as {column} is")
    return out


def apply_filters(df: DataFrame, filters: tuple[RowFilter, ...]) -> DataFrame:
    for f in filters:
        if f.column not in df.columns:
            raise PlanError(f"no column {f.column!r}")
        c = F.col(f"`{f.column}`")
        if f.op in ("is_null", "is_not_null"):
            df = df.where(c.isNull() if f.op == "is_null" else c.isNotNull())
        else:
            values = _typed(df, f.column, list(f.value) if f.op == "in" else [f.value])
            df = df.where(c.isin(*values) if f.op == "in" else _OPS[f.op](c, values[0]))
    return df


def page(df: DataFrame, plan: RowsPlan, seq: str, beyond: int = 0) -> DataFrame:
    """The page's rows, and so many beyond it: sorted, nulls last in either direction, ties by seq; a top-k, not a sort of the table."""
    if len(plan.sort) > MAX_SORTS or not 1 <= plan.limit <= MAX_PAGE or plan.offset < 0:
        raise PlanError("too many sort keys, or a page of no or too many rows")
    if len(set(plan.columns)) < len(plan.columns) or (missing := [c for c in (*plan.columns, *(c for c, _ in plan.sort)) if c not in df.columns]):
        raise PlanError(f"columns repeat or are not there: {missing if len(set(plan.columns)) == len(plan.columns) else plan.columns}")
    order = [F.desc_nulls_last(f"`{c}`") if down else F.asc_nulls_last(f"`{c}`") for c, down in plan.sort]
    rows = apply_filters(df, plan.filters).orderBy(*order, F.asc(f"`{seq}`")).offset(plan.offset).limit(plan.limit + beyond)
    return rows.select(*(F.col(f"`{c}`") for c in plan.columns)) if plan.columns else rows


def read_page(df: DataFrame, plan: RowsPlan, seq: str) -> tuple[list, int | None, bool]:
    """(rows, exact count or None, whether more follow); one row more than asked for tells the last."""
    wide = page(df, plan, seq, beyond=1).collect()
    counted = plan.count or ("none" if plan.filters else "exact")
    total = apply_filters(df, plan.filters).count() if counted == "exact" else None
    return wide[: plan.limit], total, len(wide) > plan.limit


def capped(df: DataFrame, limit: int, max_bytes: int | None = None) -> tuple[list, bool]:
    """(rows, truncated): at most limit rows, and refused where their texts alone exceed max_bytes."""
    rows = df.limit(limit + 1)
    if max_bytes is not None:
        size = rows.select(sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns), F.lit(0)).alias("b")).agg(F.sum("b")).first()[0]
        if (size or 0) > max_bytes:
            raise PlanError(f"the result is of at least {size} bytes; at most {max_bytes} are returned")
    found = rows.collect()
    return found[:limit], len(found) > limit


def preview(df: DataFrame, n: int, seq: str) -> DataFrame:
    return df.orderBy(seq).limit(n)


def sample(df: DataFrame, n: int, seed: int, seq: str) -> DataFrame:
    """n rows picked by a seeded generator over row numbers, in ascending order."""
    import random

    total = df.count()
    picked = sorted(random.Random(seed).sample(range(total), min(n, total)))
    return df.where(F.col(seq).isin(*picked)).orderBy(seq) if picked else df.limit(0)
