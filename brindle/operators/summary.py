"""Schema summaries, table statistics and column profiles, with exact counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import pii

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
#: Columns of one aggregate: each distinct count expands the rows once.
COLUMNS_AT_ONCE = 16
#: Rows dropped at either end of a range, and values below which a range is withheld.
TRIM, LEAST_VALUES = 5, 10


def schema_summary(df: DataFrame) -> DataFrame:
    """(column, type, nullable, distinct, min, max): distinct counts null as a value, bounds are of integers."""
    out: DataFrame | None = None
    for at in range(0, len(df.columns), COLUMNS_AT_ONCE):
        fields = df.schema.fields[at : at + COLUMNS_AT_ONCE]
        parts: list[Column] = []
        for i, f in enumerate(fields):
            c = F.col(f"`{f.name}`")
            nulls = F.count_if(c.isNull())
            bound = lambda fn, f=f, c=c: fn(c).cast("bigint") if isinstance(f.dataType, _INTEGERS) else F.lit(None).cast("bigint")
            parts += [nulls.alias(f"n{i}"), F.count_distinct(c).alias(f"d{i}"), bound(F.min).alias(f"l{i}"), bound(F.max).alias(f"h{i}")]
        row = df.agg(*parts)
        listed = F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), (F.col(f"n{i}") > 0).alias("nullable"), (F.col(f"d{i}") + F.when(F.col(f"n{i}") > 0, 1).otherwise(0)).alias("distinct"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, f in enumerate(fields)))
        part = row.select(F.inline(listed))
        out = part if out is None else out.union(part)
    return out


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), from one pass."""
    row = df.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)))))


def table_statistics(df: DataFrame) -> DataFrame:
    """One row: row_count, distinct_rows, duplicate_rate (1 - distinct / rows, 0 for an empty table)."""
    # Equal rows are counted per group, so that one shuffle gives both numbers.
    groups = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.count("*").alias("distinct_rows"))
    return groups.withColumn("duplicate_rate", F.when(F.col("row_count") == 0, 0.0).otherwise(1 - F.col("distinct_rows") / F.col("row_count")))


def _has_range(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _finite(c: Column, t: T.DataType) -> Column:
    return (c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) if isinstance(t, _FLOATS) else c.isNotNull()


def _nth(df: DataFrame, column: str, nth: int, ascending: bool) -> object:
    """The nth least or greatest finite value: a top-k per partition, never a sort of the table."""
    c, t = F.col(f"`{column}`"), df.schema[column].dataType
    rows = df.where(_finite(c, t)).select(c.alias("v")).orderBy(F.asc("v") if ascending else F.desc("v")).limit(nth).collect()
    return rows[-1][0] if len(rows) == nth else None


def profile(df: DataFrame, trim: int = TRIM, allow: frozenset[str] = frozenset()) -> list[dict]:
    """Per column: type, exact counts of nulls, NaN and infinities, and a range without its extremes.

    A range is withheld where personal data is suspected (and the column is not allowed), where fewer than
    LEAST_VALUES values or no more than twice the trimmed ones are there.
    """
    parts: list[Column] = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        parts += [F.count_if(c.isNull()).alias(f"n{i}"), F.count_if(_finite(c, f.dataType)).alias(f"f{i}")]
        if isinstance(f.dataType, _FLOATS):
            parts += [F.count_if(F.isnan(c)).alias(f"a{i}"), F.count_if(F.abs(c) == float("inf")).alias(f"b{i}")]
        if isinstance(f.dataType, T.StringType):
            parts += [F.coalesce(F.bool_or(pii.holds(c, k)), F.lit(False)).alias(f"p{i}{k}") for k in pii.KINDS]
    row = df.agg(*parts).first()
    out = []
    for i, f in enumerate(df.schema.fields):
        kinds = [k for k in pii.KINDS if isinstance(f.dataType, T.StringType) and row[f"p{i}{k}"]]
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and "string" in f.dataType.simpleString():
            kinds.append("unchecked_values")
        if (hint := pii.suspect_kind(f.name)) and hint not in kinds:
            kinds.append(hint)
        entry = {"column": f.name, "type": f.dataType.simpleString(), "rows": row["rows"], "nulls": row[f"n{i}"], "suspected": kinds}
        if isinstance(f.dataType, _FLOATS):
            entry |= {"nan": row[f"a{i}"], "infinite": row[f"b{i}"]}
        values = row[f"f{i}"]
        if not _has_range(f.dataType):
            entry["range"] = "not_applicable"
        elif kinds and f.name not in allow:
            entry["range"] = "withheld"
        elif not values:
            entry["range"] = "no_values"
        elif values < LEAST_VALUES or values <= 2 * trim:
            entry["range"] = "withheld"
        else:
            entry["range"] = (_nth(df, f.name, trim + 1, True), _nth(df, f.name, trim + 1, False))
        out.append(entry)
    return out


def trimmed_range(df: DataFrame, column: str, by: list[str], trim: int = TRIM) -> DataFrame:
    """Per group of by: low and high, the values just inside the trim least and greatest rows; null if there are too few."""
    c = F.col(f"`{column}`")
    rows = df.where(_finite(c, df.schema[column].dataType)).select(*by, c.alias("v"))
    up, down = Window.partitionBy(*by).orderBy(F.asc("v")), Window.partitionBy(*by).orderBy(F.desc("v"))
    # A rank limit below the exchange keeps trim + 1 rows per group and task.
    pick = lambda w, name: rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= trim + 1).groupBy(*by).agg(F.max(F.when(F.col("r") == trim + 1, F.col("v"))).alias(name))
    return pick(up, "low").join(pick(down, "high"), by)


def describe(df: DataFrame) -> DataFrame:
    """(column, mean, std, min, max) of the numeric columns, nulls left out."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    row = df.agg(*(fn(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(names) for k, fn in (("m", F.avg), ("s", F.stddev), ("l", F.min), ("h", F.max))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i, c in enumerate(names)))))
