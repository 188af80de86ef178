"""Validated aggregates: a plan is parsed and checked against the schema before any row is read.

Sums are exact: integers are added in 128 bits, decimals at their scale. Numbers of different units are not
added up unseen: a group that mixes units refuses the whole result, or the unit becomes a group key.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.rows import PlanError, RowFilter, apply_filters, parse_filters

MAX_GROUPS, MAX_GROUP_COLUMNS, MAX_MEASURES, MAX_ORDER, MAX_LIMIT = 100_000, 4, 16, 8, 1000
FUNCTIONS = ("count_rows", "count", "count_null", "count_distinct", "sum", "avg", "min", "max")
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NESTED = (T.ArrayType, T.StructType, T.MapType, T.BinaryType)


@dataclass(frozen=True)
class Measure:
    fn: str
    column: str | None
    alias: str
    additive: bool = False


@dataclass(frozen=True)
class AggregatePlan:
    measures: tuple[Measure, ...]
    group_by: tuple[str, ...] = ()
    filters: tuple[RowFilter, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()  # alias or group column, descending
    limit: int = 100
    unit_column: str | None = None
    unit_policy: str = "reject"  # or split


@dataclass(frozen=True)
class Outcome:
    rows: DataFrame  # at most the limit, and so at most MAX_LIMIT
    group_count: int


class MixedUnits(ValueError):
    """Groups hold values of more than one unit."""

    def __init__(self, samples: list[tuple]) -> None:
        super().__init__(f"groups mix units: {samples}")
        self.samples = samples


def parse(body: dict[str, Any]) -> AggregatePlan:
    unknown = set(body) - {"measures", "group_by", "filters", "order", "limit", "unit_column", "unit_policy"}
    if unknown:
        raise PlanError(f"unknown fields: {sorted(unknown)}")
    measures = []
    for m in body.get("measures") or ():
        fn, column = m.get("fn"), m.get("column")
        if fn not in FUNCTIONS or (fn == "count_rows") != (column is None):
            raise PlanError(f"not a measure: {m}")
        if fn == "sum" and m.get("additive") is not True:
            raise PlanError("a sum needs additive: true")
        measures.append(Measure(fn, column, m.get("alias") or (fn if column is None else f"{fn}_{column}"), fn == "sum"))
    plan = AggregatePlan(tuple(measures), tuple(body.get("group_by") or ()), parse_filters(body.get("filters") or []), tuple((o["by"], bool(o.get("desc"))) for o in body.get("order") or ()), body.get("limit", 100), body.get("unit_column"), body.get("unit_policy", "reject"))
    names = [*plan.group_by, *(m.alias for m in plan.measures)]
    if not plan.measures or len(plan.measures) > MAX_MEASURES or len(plan.group_by) > MAX_GROUP_COLUMNS or len(plan.order) > MAX_ORDER:
        raise PlanError("too few or too many measures, group columns or order keys")
    if len(set(names)) < len(names) or not isinstance(plan.limit, int) or not 1 <= plan.limit <= MAX_LIMIT:
        raise PlanError("aliases are unique, and a limit lies between 1 and 1000")
    if plan.unit_policy not in ("reject", "split") or any(by not in names for by, _ in plan.order):
        raise PlanError("unknown unit policy or order key")
    return plan


def check(plan: AggregatePlan, schema: T.StructType) -> None:
    types = {f.name: f.dataType for f in schema.fields}
    for name in (*plan.group_by, *(m.column for m in plan.measures if m.column), *((plan.unit_column,) if plan.unit_column else ())):
        if name not in types:
            raise PlanError(f"no column {name!r}")
    if any(isinstance(types[g], _NESTED) for g in plan.group_by):
        raise PlanError("groups are of plain columns")
    for m in plan.measures:
        if m.fn in ("sum", "avg") and not isinstance(types[m.column], T.NumericType) or m.fn in ("min", "max", "count_distinct") and isinstance(types[m.column], _NESTED):
            raise PlanError(f"{m.fn} does not go with {types[m.column].simpleString()}")


def measure(m: Measure, t: T.DataType | None) -> Column:
    c = F.col(f"`{m.column}`") if m.column else F.lit(1)
    if m.fn in ("count_rows", "count"):
        out = F.count(c)
    elif m.fn == "count_null":
        out = F.count_if(c.isNull())
    elif m.fn == "count_distinct":
        out = F.count_distinct(c)
    elif m.fn == "sum":
        out = F.sum(c.cast("decimal(38,0)")) if isinstance(t, _INTEGERS) else F.sum(c)
    elif m.fn == "avg":
        out = F.avg(c.cast("double"))
    else:
        out = (F.min if m.fn == "min" else F.max)(c)
    return out.alias(m.alias)


def run(df: DataFrame, plan: AggregatePlan) -> Outcome:
    """The plan's rows: all groups are made, counted and sorted (nulls last, ties by group), then cut."""
    check(plan, df.schema)
    df = apply_filters(df, plan.filters)
    keys = [*plan.group_by, *([plan.unit_column] if plan.unit_column and plan.unit_policy == "split" and plan.unit_column not in plan.group_by else [])]
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [measure(m, types.get(m.column)) for m in plan.measures]
    watch = plan.unit_column and plan.unit_policy == "reject"
    if watch:
        u = F.col(f"`{plan.unit_column}`")
        parts += [(F.count_distinct(u) + F.max(F.when(u.isNull(), 1).otherwise(0))).alias("_units")]
    groups = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(*parts)
    # All groups are counted, and checked, on their way to the sort: the table is read once.
    told = Observation()
    order = [F.desc_nulls_last(by) if down else F.asc_nulls_last(by) for by, down in plan.order]
    seen = groups.observe(told, F.count(F.lit(1)).alias("n"), F.count_if(F.col("_units") > 1 if watch else F.lit(False)).alias("mixed"))
    cut = seen.drop("_units").orderBy(*order, *(F.asc_nulls_last(k) for k in keys)).limit(plan.limit)
    found = cut.collect()
    counts = told.get
    if counts["mixed"]:
        raise MixedUnits([tuple(r) for r in groups.where("_units > 1").select(*keys, "_units").orderBy(*keys).limit(5).collect()])
    if counts["n"] > MAX_GROUPS:
        raise PlanError(f"{counts['n']} groups; at most {MAX_GROUPS} are returned, and none is left out unseen")
    return Outcome(df.sparkSession.createDataFrame(found, cut.schema).coalesce(1), counts["n"])
