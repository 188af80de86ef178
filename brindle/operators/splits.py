"""Reproducible splits, by exact ratios in hash order or by the values of a key."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.cadence import speaks_of_time
from brindle.functions.wire import key_text
from brindle.operators.select import SEQ, numbered

NULL, MISSING = "__null__", "__missing__"


class SplitError(ValueError):
    """Ratios or keys that make no split."""


def check_ratios(ratios: dict[str, float], key: str | None = None) -> None:
    if not ratios or any(not math.isfinite(r) or r <= 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > 1e-6:
        raise SplitError("ratios are finite, positive and add up to 1")
    if key and speaks_of_time(key):
        raise SplitError(f"a split by ratio would leak the future: {key!r} speaks of time")


def shares(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Whole counts that add up to total: the largest remainders are rounded up, ties by name."""
    whole = {n: total * ratios[n] / sum(ratios.values()) for n in sorted(ratios)}
    out = {n: math.floor(x) for n, x in whole.items()}
    rest = sorted(out, key=lambda n: (out[n] - whole[n], n))[: total - sum(out.values())]
    return {n: c + (n in rest) for n, c in out.items()}


def ratio_split(df: DataFrame, ratios: dict[str, float], seed: int = 0, seq: str = SEQ) -> DataFrame:
    """df with column split. Rows in the order of md5("seed:seq") are dealt to the names in their order.

    df has row numbers in seq. Places in the hash order come from a sort by ranges, so that no task sorts the table.
    """
    check_ratios(ratios)
    hashed = df.withColumn("_md5", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(seq).cast("string"))))
    placed = numbered(hashed, [F.col("_md5"), F.col(seq)], "_place")
    counts, at, label = shares(df.count(), ratios), 0, F.lit(None).cast("string")
    for name, n in counts.items():
        label = F.when(F.col("_place").between(at, at + n - 1), name).otherwise(label)
        at += n
    return placed.withColumn("split", label).drop("_md5", "_place")


def key_split(df: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """df with columns split and split_order: a row's label, and the labels' order of first appearance."""
    if key not in df.columns:
        return df.withColumn("split", F.lit(MISSING)).withColumn("split_order", F.lit(0))
    labelled = df.withColumn("split", F.coalesce(key_text(F.col(f"`{key}`"), df.schema[key].dataType), F.lit(NULL)))
    first = numbered(labelled.groupBy("split").agg(F.min(seq).alias("_first")), [F.col("_first")], "split_order").drop("_first")
    return labelled.join(first, "split")


def file_name(label: str) -> str:
    """A file for a label: the label itself where that is safe, else a digest of it."""
    safe = label and len(label) <= 64 and all(c.isascii() and (c.isalnum() or c in "_-.") for c in label) and not label.startswith((".", "key-"))
    return f"{label}.parquet" if safe else f"key-{hashlib.sha256(label.encode()).hexdigest()[:32]}.parquet"
