"""Readers of CSV, JSON, JSONL and Parquet that refuse what they would have to guess."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.select import SEQ, numbered
from brindle.operators.stable import kept
from brindle.sources import infer, pieces
from brindle.sources.pieces import SourceError


# -- CSV


def csv_names(header: list[str]) -> list[str]:
    """Repeated names become <name>_duplicated_<n>; a result that is there already is refused."""
    out, seen = [], {}
    for name in header:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_duplicated_{n - 1}" if n else name)
    if len({c.lower() for c in out}) < len(out):
        raise SourceError("column names are there twice")
    return out


def csv_records(text: str) -> list[list[str | None]]:
    """The records of a CSV text: an unquoted empty field is null, a quoted one empty; blank lines are left out.

    A quote that is not closed and text behind a closing quote are refused with their line.
    """
    out, row, field, line = [], [], [], 1
    state, quoted = "start", False  # start, plain, quoted, closed
    for c in itertools.chain(text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n"), "\n" if text and text[-1] not in "\r\n" else ""):
        if state == "quoted":
            if c == '"':
                state = "closed"
            else:
                field.append(c)
        elif c == '"' and state == "start":
            state, quoted = "quoted", True
        elif c == '"' and state == "closed":
            field.append(c)
            state = "quoted"
        elif c in ",\n":
            row.append("".join(field) if quoted or field else None)
            field, state, quoted = [], "start", False
            if c == "\n":
                if row != [None]:
                    out.append(row)
                row = []
        elif state == "closed":
            raise SourceError(f"line {line}: text behind a closing quote")
        else:
            field.append(c)
            state = "plain"
        line += c == "\n"
    if state == "quoted":
        raise SourceError(f"line {line - 1}: a quote is not closed")
    return out


def file_lines(spark: SparkSession, path: str, name: str = SEQ) -> DataFrame:
    """(name, value): the lines of a file, or of a folder's files by their paths, numbered in order.

    A scan packs pieces of files by size, so that order is taken from the file, the piece's offset, and the place in it.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    return numbered(raw, [F.col("_file"), F.col("_block"), F.col("_line")], name).select(name, "value")


def read_csv(spark: SparkSession, path: str, read_as: dict[str, str] | None = None) -> DataFrame:
    """A CSV file, or a folder of them in the order of their paths, each with the same header; each column is typed
    by all of its values, and _row_seq numbers the rows.

    A record may begin anywhere, as quotes hold line breaks; pieces of files are read by as many tasks all the same.
    Files with other headers are refused.
    """
    fmt = pieces.Csv()
    found = pieces.find(spark, path, fmt, header=True)
    whole, across, folded = pieces.whole(found, fmt), found.crossing, "seq long, f array<string>"
    if found.cut is None:
        raise SourceError("the file is empty")

    def batch(rows):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([seq for seq, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.list_(pa.string()))], ["seq", "f"])

    def parse(batches):
        for some in whole(batches):
            yield batch([(seq, pieces.csv_fields(text)) for seq, first, text in some if not first])

    def join(batches):
        for b in batches:
            yield batch([(rec, pieces.csv_fields(text)) for rec, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    joined = kept(found.cut.mapInArrow(join, folded)).withColumnRenamed("seq", "rec")
    # A file's first record is its header; the mark that a file may begin with is cleared by Spark.
    numbers = spark.createDataFrame([(i, None if c.header else c.seq, c.file) for i, c in enumerate(across)], "rec long, seq long, file string")
    joined = joined.join(F.broadcast(numbers), "rec")
    said = joined.where("seq is null").select("f").distinct().limit(2).collect()
    if len(said) != 1:
        raise SourceError("the files have different headers")
    names = csv_names([c or "" for c in said[0].f])
    wide = [file for width, file in found.widest if width > len(names)]
    wide += [r.file for r in joined.where((F.size("f") > len(names)) & F.col("seq").isNotNull()).select("file").distinct().collect()]
    if wide:
        raise SourceError(f"{min(wide)}: a record has a field too many")
    body = found.units.mapInArrow(parse, folded).unionByName(joined.where("seq is not null").select("seq", "f"))
    return typed(body.select(F.col("seq").alias(SEQ), *(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names))), names, read_as)


def typed(df: DataFrame, names: list[str], read_as: dict[str, str] | None = None) -> DataFrame:
    """Text columns as boolean, bigint, double or text, by all of their values; one pass decides for all."""
    free = [n for n in names if (read_as or {}).get(n) != "str"]
    if not free:
        return df
    col = lambda n: F.col(f"`{n}`")
    tests = {"boolean": lambda c: c.isin("true", "false", "True", "False", "TRUE", "FALSE"), "bigint": lambda c: c.rlike(r"^[+-]?(0|[1-9][0-9]*)\z") & c.try_cast("bigint").isNotNull(), "double": lambda c: c.rlike(r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")}
    row = df.agg(*(F.bool_and(test(col(n))).alias(f"{k}{i}") for i, n in enumerate(free) for k, test in tests.items())).first()
    kind = {n: next((k for k in tests if row[f"{k}{i}"]), "string") for i, n in enumerate(free)}
    return df.withColumns({n: F.lower(col(n)).cast(k) if k == "boolean" else col(n).cast(k) for n, k in kind.items() if k != "string"})


# -- JSON


def read_jsonl(spark: SparkSession, path: str, read_as: dict[str, str] | None = None) -> DataFrame:
    """One object per line; blank lines are left out, a bad line is reported by its number."""
    lines = file_lines(spark, path, "seq").where(F.trim("value") != "")
    if not lines.limit(1).count():
        raise SourceError("the file holds no record")
    return infer.load(lines, read_as=read_as)


def read_json(spark: SparkSession, path: str, read_as: dict[str, str] | None = None) -> DataFrame:
    """Top-level arrays of objects, a file or a folder of them in the order of their paths; a file is read by many tasks."""
    fmt = pieces.Json()
    found = pieces.find(spark, path, fmt, header=False)
    whole, across = pieces.whole(found, fmt), found.crossing

    def parse(batches):
        import pyarrow as pa

        for some in whole(batches):
            yield pa.RecordBatch.from_arrays([pa.array([seq for seq, _, _ in some], pa.int64()), pa.array([text[pieces.element_at(text, first) :] for _, first, text in some], pa.string())], ["seq", "value"])

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, value, bad = across[rec], None, None
                try:
                    if c.closed:
                        text += "}"
                        fmt.width(text, c.number == 0)
                        value = text[pieces.element_at(text, c.number == 0) :]
                    elif not pieces.ENDS[c.number > 0].fullmatch(text):
                        raise ValueError("not the end of an array of objects")
                except ValueError as error:
                    bad = f"{c.file}: element {c.number + 1}: {error}"
                yield pa.RecordBatch.from_arrays([pa.array([rec], pa.int64()), pa.array([c.seq], pa.int64()), pa.array([value], pa.string()), pa.array([bad], pa.string())], ["rec", "seq", "value", "bad"])

    joined = kept(found.cut.mapInArrow(join, "rec long, seq long, value string, bad string"))
    if wrong := joined.where("bad is not null").orderBy("rec").limit(1).collect():
        raise SourceError(wrong[0].bad)
    lines = found.units.mapInArrow(parse, "seq long, value string").unionByName(joined.where("value is not null").select("seq", "value"))
    return infer.load(lines, read_as=read_as)


# -- Parquet


@dataclass(frozen=True)
class ParquetLimits:
    cells: int = 50_000_000
    columns: int = 1000
    depth: int = 8
    row_groups: int = 10_000


def _depth(t: T.DataType) -> int:
    if isinstance(t, T.StructType):
        return 1 + max([0, *(_depth(f.dataType) for f in t.fields)])
    return 1 + _depth(t.elementType) if isinstance(t, T.ArrayType) else 1 + max(_depth(t.keyType), _depth(t.valueType)) if isinstance(t, T.MapType) else 0


def read_parquet(spark: SparkSession, path: str, limits: ParquetLimits | None = None) -> DataFrame:
    """A Parquet table in file order, _row_seq numbering its rows; footers alone are held against limits first."""
    limits = limits or ParquetLimits()
    df = spark.read.parquet(path)
    if len(df.columns) > limits.columns or _depth(df.schema) - 1 > limits.depth:
        raise SourceError("too many columns, or too deep")
    if df.count() * max(1, len(df.columns)) > limits.cells:  # a count reads footers
        raise SourceError(f"more than {limits.cells} cells")
    bad = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.BinaryType, T.DayTimeIntervalType))]
    if bad:
        raise SourceError(f"binary and duration columns are refused: {bad}")
    order = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    placed = df.select(*(F.col(f"`{c}`") for c in df.columns), order[0].alias("_file"), order[1].alias("_index"))
    return numbered(placed, [F.col("_file"), F.col("_index")]).select(SEQ, *(F.col(f"`{c}`") for c in df.columns))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, types and column metadata as written."""
    return spark.read.parquet(path)


# -- calls

MAX_COMBINATIONS = 10_000


def param_grid(params: dict[str, Any], grid: dict[str, list[Any]]) -> list[dict[str, Any]]:
    """All combinations of grid over params: names sorted, the last varies fastest, values as declared."""
    if overlap := params.keys() & grid.keys():
        raise SourceError(f"in both params and grid: {sorted(overlap)}")
    if any(not v for v in grid.values()):
        raise SourceError("an axis of the grid is empty")
    names, total = sorted(grid), 1
    for n in names:
        total *= len(grid[n])
    if total > MAX_COMBINATIONS:
        raise SourceError(f"{total} combinations; at most {MAX_COMBINATIONS}")
    return [params | dict(zip(names, values, strict=True)) for values in itertools.product(*(grid[n] for n in names))]


def read_any(spark: SparkSession, path: str, fmt: str, read_as: dict[str, str] | None = None) -> DataFrame:
    readers = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl}
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt not in readers:
        raise SourceError(f"unknown format {fmt!r}")
    return readers[fmt](spark, path, read_as)

