"""Composition of two tables by an equi-join whose cardinality is observed and checked.

Keys have one type on both sides. NaN equals nothing here (Spark's join would match it), nor does null. Key
counts come from one pass over each side; the join itself is left to Catalyst and AQE, which splits skewed
keys and broadcasts a side that its statistics show to be small.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CompositionError(ValueError):
    """A join that the tables or the rules do not allow."""


@dataclass(frozen=True)
class JoinSpec:
    keys: tuple[tuple[str, str], ...]
    how: str = "inner"  # or left
    right_alias: str = "right"
    cardinality: str | None = None  # one_to_one one_to_many many_to_one many_to_many
    on_duplicate_key: str = "warn"  # or fail
    on_null_key: str = "allow"  # or fail


def check_keys(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...]) -> None:
    for a, b in keys:
        for df, name, side in ((left, a, "left"), (right, b, "right")):
            if name not in df.columns:
                raise CompositionError(f"the {side} table has no key column {name!r}")
        one, two = left.schema[a].dataType, right.schema[b].dataType
        if one != two:
            raise CompositionError(f"keys {a} and {b} differ in type: {one.simpleString()}, {two.simpleString()}")


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    floats = [c for c in columns if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in columns))


def key_counts(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...]) -> DataFrame:
    """(k0, ..., ln, rn): rows per key on each side, keys of either; null keys are left out."""
    names = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, columns: list[str], n: str) -> DataFrame:
        df = nan_to_null(df, columns).where(~_any_null(columns))
        return df.groupBy(*(F.col(f"`{c}`").alias(k) for c, k in zip(columns, names, strict=True))).agg(F.count("*").alias(n))

    return side(left, [a for a, _ in keys], "ln").join(side(right, [b for _, b in keys], "rn"), names, "full").fillna(0, ["ln", "rn"])


def join_stats(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row: distinct keys, unmatched rows and ratios, output rows, cardinality over the keys of both sides."""
    both = (F.col("ln") > 0) & (F.col("rn") > 0)
    met = key_counts(left, right, keys).agg(
        F.count_if(F.col("ln") > 0).alias("left_distinct_keys"), F.count_if(F.col("rn") > 0).alias("right_distinct_keys"),
        F.coalesce(F.sum("ln"), F.lit(0)).alias("left_keyed"), F.coalesce(F.sum("rn"), F.lit(0)).alias("right_keyed"),
        F.coalesce(F.sum(F.when(both, F.col("ln"))), F.lit(0)).alias("left_matched"), F.coalesce(F.sum(F.when(both, F.col("rn"))), F.lit(0)).alias("right_matched"),
        F.coalesce(F.sum(F.when(both, F.col("ln") * F.col("rn"))), F.lit(0)).alias("inner_rows"),
        F.coalesce(F.bool_or(both & (F.col("ln") > 1)), F.lit(False)).alias("left_many"), F.coalesce(F.bool_or(both & (F.col("rn") > 1)), F.lit(False)).alias("right_many"),
        F.coalesce(F.bool_or(both & (F.col("ln") > 1) & (F.col("rn") > 1)), F.lit(False)).alias("duplicate_keys"),
    )
    a, b = nan_to_null(left, [x for x, _ in keys]), nan_to_null(right, [y for _, y in keys])
    rows = a.agg(F.count("*").alias("left_rows"), F.count_if(_any_null([x for x, _ in keys])).alias("left_null_keys")).crossJoin(b.agg(F.count("*").alias("right_rows"), F.count_if(_any_null([y for _, y in keys])).alias("right_null_keys")))
    ratio = lambda side: F.when(F.col(f"{side}_rows") == 0, 0.0).otherwise((F.col(f"{side}_rows") - F.col(f"{side}_matched")) / F.col(f"{side}_rows"))
    named = F.concat(F.when(F.col("left_many"), "many").otherwise("one"), F.lit("_to_"), F.when(F.col("right_many"), "many").otherwise("one"))
    return rows.crossJoin(met).select(
        "left_rows", "right_rows", "left_distinct_keys", "right_distinct_keys", "left_null_keys", "right_null_keys",
        ratio("left").alias("left_unmatched_ratio"), ratio("right").alias("right_unmatched_ratio"), named.alias("observed_cardinality"), "duplicate_keys", "inner_rows",
        (F.col("inner_rows") + F.col("left_rows") - F.col("left_matched")).alias("left_join_rows"),
    )


def worst_key(left: DataFrame, right: DataFrame, keys: tuple[tuple[str, str], ...]) -> DataFrame:
    """The key that repeats on both sides and makes most rows; ties go to the smaller key."""
    names = [f"k{i}" for i in range(len(keys))]
    made = key_counts(left, right, keys).where("ln > 1 and rn > 1").withColumn("rows", F.col("ln") * F.col("rn"))
    return made.orderBy(F.desc("rows"), *names).limit(1)


def output_columns(left: DataFrame, right: DataFrame, spec: JoinSpec) -> list[tuple[str, str]]:
    """(right column, its name): all but the keys; a name that the left has gets the alias behind it."""
    keys, taken = {b for _, b in spec.keys}, {c.lower() for c in left.columns}
    out = []
    for c in right.columns:
        if c in keys:
            continue
        name = f"{c}_{spec.right_alias}" if c.lower() in taken else c
        if name.lower() in taken:
            raise CompositionError(f"column {name!r} is there twice")
        taken.add(name.lower())
        out.append((c, name))
    return out


def compose(left: DataFrame, right: DataFrame, spec: JoinSpec, check: bool = True) -> DataFrame:
    """All of left, and of right what output_columns names, joined on spec.keys."""
    if spec.how not in ("inner", "left") or not spec.keys:
        raise CompositionError("a composition is an inner or left join on at least one key")
    check_keys(left, right, spec.keys)
    names = output_columns(left, right, spec)
    if check and (spec.cardinality or spec.on_duplicate_key == "fail" or spec.on_null_key == "fail"):
        stats = join_stats(left, right, spec.keys).first()
        if spec.on_null_key == "fail" and (stats.left_null_keys or stats.right_null_keys):
            raise CompositionError(f"null keys: {stats.left_null_keys} left, {stats.right_null_keys} right")
        allowed = {"one_to_one": {"one_to_one"}, "one_to_many": {"one_to_one", "one_to_many"}, "many_to_one": {"one_to_one", "many_to_one"}}
        if spec.cardinality in allowed and stats.observed_cardinality not in allowed[spec.cardinality]:
            raise CompositionError(f"declared {spec.cardinality}, observed {stats.observed_cardinality}")
        if spec.on_duplicate_key == "fail" and stats.duplicate_keys:
            w = worst_key(left, right, spec.keys).first()
            raise CompositionError(f"keys repeat on both sides; {tuple(w)[: len(spec.keys)]} makes {w.rows} rows")
    a = nan_to_null(left, [x for x, _ in spec.keys])
    b = nan_to_null(right, [y for _, y in spec.keys]).select(*(F.col(f"`{y}`").alias(f"_key{i}") for i, (_, y) in enumerate(spec.keys)), *(F.col(f"`{c}`").alias(f"_new{i}") for i, (c, _) in enumerate(names)))
    on = [F.col(f"`{x}`") == F.col(f"_key{i}") for i, (x, _) in enumerate(spec.keys)]
    # Left rows keep their NaN keys, which merely match nothing.
    if any(isinstance(left.schema[x].dataType, (T.FloatType, T.DoubleType)) for x, _ in spec.keys):
        a = left
        on = [(F.when(~F.isnan(F.col(f"`{x}`")), F.col(f"`{x}`")) if isinstance(left.schema[x].dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{x}`")) == F.col(f"_key{i}") for i, (x, _) in enumerate(spec.keys)]
    return a.join(b, on, spec.how).select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"_new{i}").alias(n) for i, (_, n) in enumerate(names)))
