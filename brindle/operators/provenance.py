"""Checksums and fingerprints of data, and how complete a fetch was."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The multiset checksum multiplies modulo this prime, and hashes under this name.
BITS = 3072
MODULUS = 2**BITS - 1103717
_DOMAIN = b"canonical-multiset-v2\0"


def record_lines(df: DataFrame) -> DataFrame:
    """(line): each row as the JSON text that checksums are of: sorted keys, a space behind colons and commas, and
    what JSON has no type for as text."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_line(r) for r in batch.to_pylist()], pa.string())], ["line"])

    return df.mapInArrow(lines, "line string")


def _line(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False, sort_keys=True, default=str)


def ordered_checksum(lines: DataFrame) -> str:
    """SHA-256 of the JSON array of the lines in order: a stream of sorted partitions, never the table at once."""
    digest, first = hashlib.sha256(b"["), True
    for row in lines.orderBy("line").toLocalIterator(prefetchPartitions=True):
        digest.update((b"" if first else b",") + row.line.encode())
        first = False
    digest.update(b"]")
    return f"sha256:{digest.hexdigest()}"


def _element(line: str) -> int:
    return int.from_bytes(hashlib.shake_256(_DOMAIN + line.encode()).digest(BITS // 8), "big") % MODULUS or 1


def _counted(df: DataFrame) -> DataFrame:
    """The rows of df, equal ones once, and behind them how many there are; rows with nested columns as they are, each as one.

    Grouping takes -0.0 for 0.0, which checksums tell apart, so that the sign of a zero is a key of its own.
    """
    if not df.columns or any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)) for f in df.schema.fields):
        return df.withColumn("_n", F.lit(1).cast("long")) if "_n" not in df.columns else df.select("*", F.lit(1).cast("long").alias("_n_"))
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    signs = {f"s{i}": F.coalesce(F.col(f"c{i}").cast("string") == "-0.0", F.lit(False)) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    found = plain.withColumns(signs).groupBy(*plain.columns, *signs).agg(F.count("*").alias("n"))
    zero = lambda i, f: F.when(F.col(f"s{i}"), F.lit(-0.0).cast(f.dataType)).otherwise(F.col(f"c{i}")) if f"s{i}" in signs else F.col(f"c{i}")
    return found.select(*(zero(i, f).alias(f.name) for i, f in enumerate(df.schema.fields)), F.col("n").alias("_n" if "_n" not in df.columns else "_n_"))


def multiset_checksum(df: DataFrame) -> str:
    """A checksum of rows as a multiset: the product of their hashes, whatever the order or partitions. Equal rows are
    counted first, and hashed once.

    Partitions multiply their own rows, and products of products make a tree, so that no task and not the
    driver sees more than one number per partition of the step before.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, n = {}, 0
        for batch in batches:
            last = batch.num_columns - 1
            records = batch.select(list(range(last))).to_pylist()
            for record, copies in zip(records, batch.column(last).to_pylist(), strict=True):
                products[copies] = products.get(copies, 1) * _element(_line(record)) % MODULUS
                n += copies
        product = 1
        for copies, p in products.items():
            product = product * pow(p, copies, MODULUS) % MODULUS
        yield _one(product, n)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product, n = 1, 0
        for batch in batches:
            for p, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                product, n = product * int.from_bytes(p, "big") % MODULUS, n + k
        yield _one(product, n)

    found = _counted(df).mapInArrow(rows, "product binary, n long").repartition(8).mapInArrow(parts, "product binary, n long").collect()
    product, n = 1, 0
    for r in found:
        product, n = product * int.from_bytes(r.product, "big") % MODULUS, n + r.n
    final = hashlib.sha256(_DOMAIN + n.to_bytes(8, "big") + product.to_bytes(BITS // 8, "big"))
    return f"sha256:{final.hexdigest()}"


def _one(product: int, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([product.to_bytes(BITS // 8, "big")], pa.binary()), pa.array([n], pa.int64())], ["product", "n"])


def digest(value: Any) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def schema_hash(schema: T.StructType) -> str:
    return digest({f.name: f.dataType.simpleString() for f in schema.fields})[:16]


def fingerprints(params: dict, schema: T.StructType, coverage: dict) -> dict[str, str]:
    return {"params": digest(params), "contract": schema_hash(schema), "coverage": digest(coverage)}


def has_changed(checksum: str, params: dict, before: dict | None) -> bool:
    """Whether a run differs from an earlier one {checksum, params}; the first always does."""
    return before is None or before["checksum"] != checksum or digest(before["params"]) != digest(params)


def inputs_fingerprint(checksums: dict[str, str | None]) -> str | None:
    """One digest of all sources' checksums; none if one is unknown."""
    return None if any(c is None for c in checksums.values()) else digest(checksums)


def coverage(calls: list[tuple[int | None, int]]) -> str:
    """complete, partial or unknown, of (reported total, fetched rows) per call; totals are not added up."""
    if not calls or any(t is None for t, _ in calls):
        return "unknown"
    return "complete" if all(n >= t for t, n in calls) else "partial"


def coverage_of(calls: DataFrame) -> DataFrame:
    """(source, coverage) of calls(source, reported, fetched)."""
    return calls.groupBy("source").agg(F.when(F.bool_or(F.col("reported").isNull()), "unknown").when(F.bool_and(F.col("fetched") >= F.col("reported")), "complete").otherwise("partial").alias("coverage"))


def compare_manifests(before: dict[str, str], after: dict[str, str]) -> dict[str, list[str]]:
    """Entries added, removed and modified, by name and checksum."""
    return {"added": sorted(after.keys() - before.keys()), "removed": sorted(before.keys() - after.keys()), "modified": sorted(k for k in after.keys() & before.keys() if after[k] != before[k])}
