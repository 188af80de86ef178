"""Derived columns of the normalisation step: null tokens, aliases, dates in parts, joint keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_tokens(value: Column, tokens: list[str]) -> Column:
    """Null where the text is one of tokens."""
    return F.when(~value.isin(*tokens), value) if tokens else value


def conflict(values: list[Column]) -> Column:
    """Whether the values that are there differ from one another."""
    present = F.array_distinct(F.array_compact(F.array(*values)))
    return F.size(present) > 1


def date_parts(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts, as texts; null where one is missing or they make no date."""
    y, m, d = (F.lpad(F.trim(p.cast("string")), n, "0") for p, n in ((year, 4), (month, 2), (day, 2)))
    sound = (F.length(F.trim(year.cast("string"))) <= 4) & (F.length(F.trim(month.cast("string"))) <= 2) & (F.length(F.trim(day.cast("string"))) <= 2)
    joined = F.concat(y, F.lit("-"), m, F.lit("-"), d)
    return F.when(sound & joined.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), joined.try_cast("date"))


def join_key(values: list[Column]) -> Column:
    """The texts joined by a pipe, with backslashes and pipes in them escaped by a backslash; null where one is null."""
    escaped = [F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for v in values]
    return reduce(lambda a, b: F.concat(a, F.lit("|"), b), escaped)


def concat_date(parts: list[Column], separator: str = "-") -> Column:
    """Parts joined, those that are null left out."""
    return F.concat_ws(separator, *parts)


def csv_guard(value: Column) -> Column:
    """A text that a spreadsheet would take for a formula, with ' in front."""
    return F.when(value.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
