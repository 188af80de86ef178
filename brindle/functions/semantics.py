"""What columns mean: kind, display and unit, each with where it comes from, kept in the schema's metadata.

Spark writes field metadata into Parquet footers and reads it back, so that a table carries its meanings.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Origins, the strongest first, and the kinds of values.
ORIGINS = ("user_annotation", "core_spec", "catalog", "engine_inferred")
KINDS = ("code", "measure", "date", "period", "text", "flag")
KEY = "brindle.semantics"


@dataclass(frozen=True)
class Hint:
    """One part of a column's meaning: kind (value: one of KINDS), label, description, format, unit, or scale."""

    part: str
    value: str | float
    origin: str


def resolve(hints: list[Hint]) -> dict[str, Hint]:
    """Per part the hint of the strongest origin; of equal ones the first."""
    out: dict[str, Hint] = {}
    for h in sorted(hints, key=lambda h: ORIGINS.index(h.origin)):
        out.setdefault(h.part, h)
    return out


def annotate(df: DataFrame, hints: dict[str, list[Hint]]) -> DataFrame:
    """df whose columns carry what hints, and what they carried already, say of them."""
    known = meanings(df)
    after = {c: [asdict(h) for h in resolve([*hints.get(c, []), *known.get(c, {}).values()]).values()] for c in {*hints, *known}}
    columns = []
    for c in df.columns:
        column = F.col(f"`{c}`")
        columns.append(column.alias(c, metadata=dict(df.schema[c].metadata) | {KEY: after[c]}) if c in after else column)
    return df.select(*columns)


def meanings(df: DataFrame) -> dict[str, dict[str, Hint]]:
    return {f.name: {h["part"]: Hint(**h) for h in f.metadata[KEY]} for f in df.schema.fields if KEY in (f.metadata or {})}
