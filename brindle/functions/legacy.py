"""Forms of the older configuration files: filters as text, text templates, and variants of a table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FILTER = re.compile(r"\s*(\w+)\s*(>=|<=|==|!=|>|<)\s*(.+?)\s*", re.S)
_COMPARE: dict[str, Callable[[Column, Any], Column]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
# Texts that stand for nothing.
NULL_TOKENS = ("", "-", "N/A", "null", "None")


def condition(df: DataFrame, text: str) -> Column:
    """A comparison such as "year >= 2020" or "kind != 'x'"; one that cannot be read, or names no column, is an error."""
    m = _FILTER.fullmatch(text)
    if not m or m[1] not in df.columns:
        raise ValueError(f"not a filter of this table: {text!r}")
    value: Any = m[3].strip("'\"")
    for kind in (int, float):
        try:
            value = kind(m[3])
            break
        except ValueError:
            continue
    return _COMPARE[m[2]](F.col(m[1]), F.lit(value))


def nullify(value: Column) -> Column:
    """The stripped text, or null where it stands for nothing."""
    text = F.trim(value.cast("string"))
    return F.when(~text.isin(*NULL_TOKENS), text)


def template(text: str, columns: list[Column]) -> Column:
    """text with each {} replaced by the next column; null where one is null."""
    pieces = text.split("{}")
    if len(pieces) != len(columns) + 1:
        raise ValueError(f"{len(pieces) - 1} places for {len(columns)} columns")
    parts: list[Column] = [F.lit(pieces[0])]
    for c, p in zip(columns, pieces[1:], strict=True):
        parts += [c.cast("string"), F.lit(p)]
    return F.concat(*parts)


def variants(df: DataFrame, config: dict[str, dict[str, Any]], romanize: Callable[[str], str] | None = None) -> dict[str, DataFrame]:
    """Tables by name: columns renamed, texts written in Latin letters by a function that is given."""
    if not config:
        return {"default": df}
    out = {}
    for name, options in config.items():
        one = df
        columns = [c for c in options.get("romanize_columns", []) if c in df.columns]
        if columns and romanize is None:
            raise ValueError("no function to write texts in Latin letters is given")
        if columns:

            @F.pandas_udf("string")
            def latin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for b in batches:
                    yield b.map(romanize, na_action="ignore")

            one = one.withColumns({c: latin(F.col(f"`{c}`")) for c in columns})
        out[name] = one.withColumnsRenamed({a: b for a, b in options.get("column_rename", {}).items() if a in df.columns})
    return out
