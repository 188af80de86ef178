"""How values leave the engine: per column one of number, decimal_string, string, boolean and json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import casts

SAFE_INTEGER = 2**53 - 1
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def encode(value: Column, t: T.DataType) -> Column:
    """The text form of a value: decimals without exponent, bytes as hex, times in ISO form, null for NaN and infinities."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), casts.float_text(value.cast("double")))
    if isinstance(t, T.BinaryType):
        return F.lower(F.hex(value))
    if isinstance(t, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        shown = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        return F.concat(shown, F.lit("+00:00")) if isinstance(t, T.TimestampType) else shown
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def wire_types(df: DataFrame) -> dict[str, str]:
    """The wire type of each column; integers beyond 2^53 - 1 anywhere make a column a decimal_string."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, _INTEGERS)]
    wide = df.agg(*(F.max(F.abs(F.col(f"`{c}`").cast("decimal(20,0)"))).alias(f"m{i}") for i, c in enumerate(ints))).first() if ints else []
    beyond = {c for c, m in zip(ints, wide, strict=True) if m is not None and m > SAFE_INTEGER}

    def of(f: T.StructField) -> str:
        if isinstance(f.dataType, T.DecimalType) or f.name in beyond:
            return "decimal_string"
        if isinstance(f.dataType, (*_INTEGERS, T.FloatType, T.DoubleType)):
            return "number"
        if isinstance(f.dataType, T.BooleanType):
            return "boolean"
        return "json" if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else "string"

    return {f.name: of(f) for f in df.schema.fields}


def key_text(value: Column, t: T.DataType) -> Column:
    """A partition's label."""
    if isinstance(t, T.BooleanType):
        return F.when(value, "true").when(~value, "false")
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return casts.text(value, t)


def canonical_lines(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with sorted keys, nulls kept."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns))), {"ignoreNullFields": "false"}).alias("line"))
