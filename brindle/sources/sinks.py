"""Writers. A table becomes one file where the layout asks for one, and a folder of part files otherwise.

Single files are written by Spark into a folder beside their place and moved there at the end, so that no
reader meets half a file; the table never passes through the driver, but for the few rows of a card.
"""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from importlib.metadata import entry_points
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import pii, wire
from brindle.functions.derive import csv_guard

_NESTED = (T.ArrayType, T.StructType, T.MapType)


class ExportError(ValueError):
    """A table that a layout cannot hold."""


class Files:
    """Files of whatever store a path names (none: local files), by the Hadoop interface that Spark itself uses."""

    def __init__(self, df_or_spark: DataFrame | SparkSession, path: str | Path) -> None:
        spark = df_or_spark if isinstance(df_or_spark, SparkSession) else df_or_spark.sparkSession
        text = str(path)
        self.path = text if "://" in text else f"file://{Path(text).absolute()}"
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at(self.path).getFileSystem(conf)

    def _at(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def beside(self, name: str) -> str:
        return f"{self.path.rsplit('/', 1)[0]}/{name}"

    def delete(self, path: str | None = None) -> None:
        self._fs.delete(self._at(path or self.path), True)

    def size(self) -> int:
        return self._fs.getFileStatus(self._at(self.path)).getLen()

    def parts(self, folder: str) -> list[str]:
        return sorted(p for s in self._fs.listStatus(self._at(folder)) if (p := s.getPath().toString()).rsplit("/", 1)[-1].startswith("part-"))

    def put(self, part: str) -> None:
        """Moves a finished file to the path; one that is there goes."""
        self._fs.mkdirs(self._at(self.path).getParent())
        self._fs.delete(self._at(self.path), False)
        if not self._fs.rename(self._at(part), self._at(self.path)):
            raise ExportError(f"{self.path} cannot be put in place")

    def write(self, text: str) -> None:
        draft = self.beside(f".{self.path.rsplit('/', 1)[-1]}.draft")
        out = self._fs.create(self._at(draft), True)
        out.write(text.encode())
        out.close()
        self.put(draft)


def _one_file(df: DataFrame, to: str | Path, fmt: str, options: dict[str, Any] | None = None) -> Path:
    files = Files(df, to)
    draft = files.beside(f".{files.path.rsplit('/', 1)[-1]}.draft")
    files.delete(draft)
    df.coalesce(1).write.format(fmt).options(**(options or {})).save(draft)
    parts = files.parts(draft)
    if parts:
        files.put(parts[0])
    else:
        files.write("")
    files.delete(draft)
    return Path(to) if "://" not in str(to) else to


def write_parquet(df: DataFrame, to: str | Path) -> Path:
    return _one_file(df, to, "parquet")


def empty_like(df: DataFrame, to: str | Path) -> Path:
    """No row, the same columns and metadata."""
    return _one_file(df.limit(0), to, "parquet")


def _cells(df: DataFrame, guard: bool = True) -> list[Column]:
    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return csv_guard(c) if guard else c
        if isinstance(f.dataType, _NESTED):
            return F.to_json(c)
        return wire.encode(c, f.dataType)

    return [cell(f).alias(f.name) for f in df.schema.fields]


_CSV = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, to: str | Path, guard: bool = True) -> Path:
    """Texts that a spreadsheet would run get ' in front; nested values are JSON; nulls are empty and empty texts quoted."""
    return _one_file(df.select(*_cells(df, guard)), to, "csv", _CSV)


def write_csv_parts(df: DataFrame, folder: str | Path, guard: bool = True) -> Path:
    """The same as a folder of files with a header each, one by each task, whose paths are in the order of the rows."""
    df.select(*_cells(df, guard)).write.format("csv").options(**_CSV).save(Files(df, folder).path)
    return folder


def refuse_non_finite(df: DataFrame) -> None:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return
    row = df.agg(*(F.count_if(F.isnan(F.col(f"`{c}`")) | (F.abs(F.col(f"`{c}`")) == float("inf"))).alias(f"n{i}") for i, c in enumerate(floats))).first()
    if bad := [c for i, c in enumerate(floats) if row[i]]:
        raise ExportError(f"JSON has no NaN or infinity: {bad}")


def write_jsonl(df: DataFrame, to: str | Path) -> Path:
    """One object per line, keys sorted, nulls kept."""
    refuse_non_finite(df)
    return _one_file(wire.canonical_lines(df), to, "text")


def markdown(df: DataFrame, title: str, provenance: dict[str, str] | None = None, samples: int = 5) -> str:
    escape = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "## Schema", "", "| column | type |", "| --- | --- |", *(f"| {escape(f.name)} | {f.dataType.simpleString()} |" for f in df.schema.fields)]
    lines += ["", "## Sample", "", "| " + " | ".join(map(escape, df.columns)) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join(escape(v) for v in row) + " |" for row in df.limit(samples).collect()]
    if provenance:
        lines += ["", "## Provenance", "", *(f"- {k}: {v}" for k, v in provenance.items())]
    return "\n".join(lines) + "\n"


def write_markdown(df: DataFrame, to: str | Path, title: str = "Dataset", provenance: dict[str, str] | None = None) -> Path:
    Files(df, to).write(markdown(df, title, provenance))
    return to


def write_hub_layout(df: DataFrame, folder: str | Path, title: str, fmt: str = "parquet") -> Path:
    """data/train-00000-of-00001.<fmt>, a card, and dataset_infos.json."""
    data = f"{folder}/data/train-00000-of-00001.{fmt}"
    {"parquet": write_parquet, "jsonl": write_jsonl}[fmt](df, data)
    write_markdown(df, f"{folder}/README.md", title)
    infos = {"default": {"features": {f.name: {"dtype": f.dataType.simpleString(), "_type": "Value"} for f in df.schema.fields}, "splits": {"train": {"name": "train", "num_examples": df.count(), "num_bytes": Files(df, data).size()}}}}
    Files(df, f"{folder}/dataset_infos.json").write(json.dumps(infos, indent=2, sort_keys=True))
    return folder


def write_competition_layout(df: DataFrame, folder: str | Path, title: str, licence: str | None, metadata: dict[str, Any] | None = None) -> Path:
    """A CSV file and dataset-metadata.json, merged with what is given; refused without a declared licence."""
    if not licence:
        raise ExportError("this layout needs a declared licence")
    write_csv(df, f"{folder}/data.csv")
    body = {"title": title, "licenses": [{"name": licence}], "resources": [{"path": "data.csv", "schema": {"fields": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]}}]} | (metadata or {})
    Files(df, f"{folder}/dataset-metadata.json").write(json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False))
    return folder


# -- exporters by name

Exporter = Callable[..., Path]
_EXPORTERS: dict[str, Exporter] = {"parquet": write_parquet, "csv": write_csv, "jsonl": write_jsonl, "markdown": write_markdown}


def register(kind: str, exporter: Exporter, override: bool = False) -> None:
    if kind in _EXPORTERS and not override:
        raise ExportError(f"there is an exporter {kind!r} already")
    _EXPORTERS[kind] = exporter


def load_plugins(group: str = "brindle.exporters") -> list[str]:
    """Registers the exporters that installed packages name as entry points."""
    found = entry_points(group=group)
    for point in found:
        register(point.name, point.load())
    return [p.name for p in found]


def export(df: DataFrame, kind: str, to: str | Path, **options: Any) -> Path:
    if kind not in _EXPORTERS:
        raise ExportError(f"unknown exporter {kind!r}; known: {', '.join(sorted(_EXPORTERS))}")
    return _EXPORTERS[kind](df, to, **options)


def publish_local(files: list[Path], folder: str | Path) -> list[Path]:
    """Copies of files in folder, each put in place whole."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for f in files:
        draft = folder / f".{f.name}.draft"
        shutil.copyfile(f, draft)
        out.append(draft.replace(folder / f.name))
    return out


def export_result(df: DataFrame, to: str | Path, fmt: str = "csv", profile: str = "machine", max_rows: int = 100_000, max_bytes: int = 64 << 20) -> dict[str, Any]:
    """All of a result or nothing: refused beyond max_rows or max_bytes.

    The spreadsheet profile guards texts and counts the cells that it changed; personal data that the values
    show is reported.
    """
    n = df.limit(max_rows + 1).count()
    if n > max_rows:
        raise ExportError(f"more than {max_rows} rows")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    altered = 0
    if profile == "spreadsheet" and fmt == "csv" and texts:
        row = df.agg(*(F.count_if(csv_guard(F.col(f"`{c}`")) != F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(texts))).first()
        altered = sum(row)
    file = write_csv(df, to, profile == "spreadsheet") if fmt == "csv" else write_jsonl(df, to)
    size = Files(df, file).size()
    if size > max_bytes:
        Files(df, file).delete()
        raise ExportError(f"more than {max_bytes} bytes")
    return {"rows": n, "bytes": size, "altered_cells": altered, "findings": [tuple(r) for r in pii.scan_values(df).collect()]}
