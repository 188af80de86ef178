"""Quality rules, drift between two runs, and what a verdict rests on.

Rules are evaluated together: every count of every rule comes from one aggregate over the table. A rule that
cannot be evaluated says so; it is never counted as passed.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.select import OPERATORS
from brindle.operators.summary import table_statistics


@dataclass(frozen=True)
class Rule:
    kind: str  # required_column dtype max_null_ratio max_duplicate_rate min_rows range compare
    column: str | None = None
    other: str | None = None
    op: str = "le"
    limit: float | None = None
    low: float | None = None
    high: float | None = None
    dtype: str | None = None
    severity: str = "fail"  # or warn


@dataclass(frozen=True)
class Result:
    rule: Rule
    status: str  # pass warn fail not_evaluated
    actual: float | None = None
    affected: int | None = None
    evaluated: int | None = None
    detail: str = ""


def _verdict(rule: Rule, broken: bool, **more: Any) -> Result:
    return Result(rule, rule.severity if broken else "pass", **more)


def evaluate(df: DataFrame, rules: list[Rule]) -> list[Result]:
    schema = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.count("*").alias("rows")]
    for i, r in enumerate(rules):
        if r.column not in schema:
            continue
        c = F.col(f"`{r.column}`")
        if r.kind == "max_null_ratio":
            parts.append(F.count_if(c.isNull()).alias(f"a{i}"))
        elif r.kind == "range":
            parts.append(F.count(c).alias(f"e{i}"))
            if isinstance(schema[r.column], T.NumericType):
                within = F.lit(True)
                within = within & (c >= r.low) if r.low is not None else within
                within = within & (c <= r.high) if r.high is not None else within
                parts.append(F.count_if(c.isNotNull() & ~within).alias(f"a{i}"))
        elif r.kind == "compare" and _comparable(schema, r):
            o = F.col(f"`{r.other}`")
            both = c.isNotNull() & o.isNotNull()
            parts += [F.count_if(both).alias(f"e{i}"), F.count_if(both & ~OPERATORS[r.op](c, o)).alias(f"a{i}")]
    row = df.agg(*parts).first().asDict()
    rows = row["rows"]
    copies = table_statistics(df).first()["duplicate_rate"] if any(r.kind == "max_duplicate_rate" for r in rules) and rows else None
    return [_result(r, i, schema, row, rows, copies) for i, r in enumerate(rules)]


def _comparable(schema: dict[str, T.DataType], r: Rule) -> bool:
    one, two = schema.get(r.column), schema.get(r.other)
    return one is not None and two is not None and (one == two or isinstance(one, T.NumericType) and isinstance(two, T.NumericType))


def _result(r: Rule, i: int, schema: dict[str, T.DataType], row: dict, rows: int, copies: float | None) -> Result:
    there = r.column in schema
    if r.kind == "required_column":
        return _verdict(r, not there, detail="" if there else "missing")
    if r.kind == "dtype":
        if not there:
            return Result(r, "not_evaluated", detail="missing")
        found = schema[r.column].simpleString()
        return _verdict(r, found != r.dtype, detail=found)
    if r.kind == "min_rows":
        return _verdict(r, rows < r.limit, actual=rows)
    if r.kind == "max_duplicate_rate":
        return Result(r, "not_evaluated", detail="no rows") if copies is None else _verdict(r, copies > r.limit, actual=copies)
    if not there or r.kind == "compare" and r.other not in schema:
        return Result(r, "not_evaluated", detail="missing")
    if r.kind == "max_null_ratio":
        return _verdict(r, row[f"a{i}"] / rows > r.limit, actual=row[f"a{i}"] / rows, affected=row[f"a{i}"], evaluated=rows) if rows else Result(r, "not_evaluated", detail="no rows")
    if r.kind == "compare" and not _comparable(schema, r):
        return _verdict(r, True, detail="not comparable")
    n = row[f"e{i}"]
    if r.kind == "range" and f"a{i}" not in row:
        return _verdict(r, n > 0, affected=n, evaluated=n, detail="not comparable") if n else Result(r, "not_evaluated", detail="no values")
    if not n:
        return Result(r, "not_evaluated", affected=0, evaluated=0, detail="no values")
    return _verdict(r, row[f"a{i}"] > 0, actual=row[f"a{i}"] / n, affected=row[f"a{i}"], evaluated=n)


def availability(results: list[Result]) -> str:
    """unavailable, partial or available, by how many of the rules were evaluated."""
    done = sum(r.status != "not_evaluated" for r in results)
    return "unavailable" if not done else "available" if done == len(results) else "partial"


#: A change of the row count by more than this share is a finding.
ROW_JUMP = 0.5


def schema_diff(before: T.StructType, after: T.StructType) -> list[tuple[str, str, str]]:
    """(kind, column, detail): columns added, removed, and of another type."""
    old, new = ({f.name: f.dataType.simpleString() for f in s.fields} for s in (before, after))
    return [
        *(("column_added", c, new[c]) for c in sorted(new.keys() - old.keys())),
        *(("column_removed", c, old[c]) for c in sorted(old.keys() - new.keys())),
        *(("dtype_changed", c, f"{old[c]} -> {new[c]}") for c in sorted(new.keys() & old.keys()) if old[c] != new[c]),
    ]


def drift(before: T.StructType, before_rows: int, after: T.StructType, after_rows: int) -> list[tuple[str, str | None, str]]:
    jump = before_rows > 0 and abs(after_rows - before_rows) / before_rows > ROW_JUMP
    return [*schema_diff(before, after), *([("row_count_jump", None, f"{before_rows} -> {after_rows}")] if jump else [])]


@dataclass(frozen=True)
class Run:
    run_id: str
    owner: str
    finished: str
    status: str = "success"
    coverage: str | None = None
    contract: str | None = None


def baseline(current: Run, history: list[Run], volume: bool = False) -> tuple[Run | None, str | None]:
    """The latest earlier success of the same owner, or a reason why there is none.

    A finding about volume needs a run that gathered the same coverage under the same contract.
    """
    earlier = [r for r in history if r.run_id != current.run_id and r.status == "success" and r.finished < current.finished]
    if not earlier:
        return None, "no_earlier_run"
    own = [r for r in earlier if r.owner == current.owner]
    if not own:
        return None, "other_owner"
    if volume:
        if None in (current.coverage, current.contract):
            return None, "unknown_coverage"
        if not (own := [r for r in own if r.coverage == current.coverage]):
            return None, "other_coverage"
        if not (own := [r for r in own if r.contract == current.contract]):
            return None, "other_contract"
    return max(own, key=lambda r: (r.finished, r.run_id)), None
