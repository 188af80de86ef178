"""Strict type inference over all records, and a load with the types decided.

Evidence (path, kind, widest integer, largest scale, first place seen) is gathered per partition and merged by
min and max, which is commutative and associative; the driver sees one row per path and kind. Types are not
widened over conflicts: mixed kinds, integers beyond 2^53 beside floats, and names that differ only in
case are refused. There is no sampling window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAFE_INTEGER = 2**53
ROOT = "$"


class InferenceError(ValueError):
    """Records whose types do not agree, or that no type can hold."""


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    return "struct" if isinstance(value, dict) else "list"


def _digits(value: Any) -> tuple[bool, int]:
    return (abs(value) > SAFE_INTEGER, len(str(abs(value)))) if isinstance(value, int) and not isinstance(value, bool) else (False, 0)


def _walk(value: Any, path: tuple[str, ...], place: int, out: dict) -> None:
    kind = _kind(value)
    wide, whole = _digits(value)
    old = out.get((path, kind))
    out[path, kind] = (wide or bool(old and old[0]), max(whole, old[1] if old else 0), min(place, old[2]) if old else place)
    if kind == "struct":
        for i, (k, v) in enumerate(value.items()):
            _walk(v, (*path, k), place + i, out)
    elif kind == "list":
        for v in value:
            _walk(v, (*path, "[]"), place, out)


def _unify(path: str, seen: dict[str, tuple]) -> str:
    kinds = set(seen) - {"null"}
    if kinds == {"int", "float"}:
        if seen["int"][0]:
            raise InferenceError(f"{path}: integers beyond 2^53 stand beside floats")
        return "float"
    if len(kinds) > 1:
        raise InferenceError(f"{path}: values are of different types: {sorted(kinds)}")
    return kinds.pop() if kinds else "null"


def schema_of(evidence: list[tuple]) -> T.StructType:
    """The schema of (path as JSON, kind, wide, whole digits, first place) rows; fields in first-seen order."""
    tree: dict[tuple, dict[str, tuple]] = {}
    for path, kind, wide, whole, first in evidence:
        tree.setdefault(tuple(json.loads(path)), {})[kind] = (wide, whole, first)

    def node(path: tuple) -> T.DataType:
        seen = tree[path]
        kind = _unify(".".join(path) or ROOT, seen)
        if kind == "struct":
            fields = sorted((p for p in tree if len(p) == len(path) + 1 and p[: len(path)] == path), key=lambda p: (min(s[2] for s in tree[p].values()), p))
            names = [p[-1] for p in fields]
            if len({n.lower() for n in names}) < len(names):
                raise InferenceError(f"names differ only in case: {sorted(names)}")
            return T.StructType([T.StructField(p[-1], node(p)) for p in fields])
        if kind == "list":
            inner = (*path, "[]")
            return T.ArrayType(node(inner) if inner in tree else T.NullType())
        if kind == "int":
            whole = seen["int"][1]
            if whole > 38:
                return T.StringType()
            return T.LongType() if whole <= 18 else T.DecimalType(38, 0)
        return {"null": T.NullType(), "boolean": T.BooleanType(), "float": T.DoubleType(), "string": T.StringType()}[kind]

    if not tree:
        return T.StructType([])
    found = node(())
    if not isinstance(found, T.StructType):
        raise InferenceError("records are objects")
    return found


def infer(lines: DataFrame) -> T.StructType:
    """The schema of lines(seq, value): one JSON object per line, numbered in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for batch in batches:
            for seq, line in zip(batch.column("seq").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    value = json.loads(line, parse_constant=float)
                except ValueError as error:
                    raise InferenceError(f"line {seq + 1} is no JSON: {error}") from error
                if not isinstance(value, dict):
                    raise InferenceError(f"line {seq + 1} is no object")
                _walk(value, (), seq << 20, out)
        rows = [(json.dumps(p), k, w, n, f) for (p, k), (w, n, f) in out.items()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["path", "kind", "wide", "whole", "first"])

    found = lines.select("seq", "value").mapInArrow(run, "path string, kind string, wide boolean, whole long, first long")
    merged = found.groupBy("path", "kind").agg(F.bool_or("wide"), F.max("whole"), F.min("first"))
    return schema_of([tuple(r) for r in merged.collect()])


def load(lines: DataFrame, schema: T.StructType | None = None, read_as: dict[str, str] | None = None) -> DataFrame:
    """The records of lines(seq, value) with column _row_seq; read_as names fields that stay text ("str")."""
    schema = schema or infer(lines)
    fixed = T.StructType([T.StructField(f.name, T.StringType() if (read_as or {}).get(f.name) == "str" else f.dataType) for f in schema.fields])
    if not fixed.fields:
        return lines.select(F.col("seq").alias("_row_seq"))
    if "_row_seq" in fixed.names:
        raise InferenceError("a column is called _row_seq")
    # Spark has no parser for an all-null field; it is added as the null it is.
    real = T.StructType([f for f in fixed.fields if not isinstance(f.dataType, T.NullType)])
    parsed = lines.select("seq", F.from_json("value", real, {"mode": "FAILFAST", "allowNonNumericNumbers": "true"}).alias("r")) if real.fields else lines.select("seq")
    return parsed.select(F.col("seq").alias("_row_seq"), *(F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"r.`{f.name}`").alias(f.name) for f in fixed.fields))


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """lines(seq, value) of records at hand."""
    return spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False, default=str)) for i, r in enumerate(rows)], "seq long, value string")
