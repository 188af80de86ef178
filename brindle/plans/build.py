"""A build from its spec: bronze records, silver normalisation, gates, gold selection or join, export, commit.

Each source is one lazy chain of DataFrames. Counts that gate it (lost casts, conflicting aliases, rules, personal
data) come from a few aggregates over the persisted silver table; a source that fails does not stop others.
"""

from __future__ import annotations

import hashlib
import json
import random
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import casts, derive, pii
from brindle.operators import joins, provenance, quality, select, splits, summary
from brindle.operators.select import SEQ, numbered
from brindle.operators.warehouse import Snapshot, Warehouse
from brindle.plans.spec import BuildSpec, Contract, Source, problems
from brindle.sources import fetch, infer, readers, sinks


class BuildError(ValueError):
    """A build that stopped, and at which step."""


# -- silver


def _violations(df: DataFrame, checks: dict[str, Any]) -> dict[str, int]:
    """Counts of named conditions, from one pass."""
    if not checks:
        return {}
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"v{i}") for i, c in enumerate(checks.values()))).first()
    return {name: row[i] for i, name in enumerate(checks) if row[i]}


def normalize(df: DataFrame, contract: Contract) -> DataFrame:
    """df as contract has it; rows are neither added nor dropped nor moved. Fails with counts by step and column."""
    c = lambda n: F.col(f"`{n}`")
    need = {*contract.column_null_tokens, *contract.rename, *(n for g in contract.coalesce.values() for n in g)}
    if missing := sorted(need - set(df.columns)):
        raise BuildError(f"the contract names columns that are not there: {missing}")
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    if bad := sorted(set(contract.column_null_tokens) - texts):
        raise BuildError(f"null tokens are for text columns: {bad}")
    tokens = {n: [*contract.null_tokens, *contract.column_null_tokens.get(n, ())] for n in texts if n != SEQ}
    df = df.withColumns({n: derive.null_tokens(c(n), ts) for n, ts in tokens.items() if ts})
    for name, group in contract.coalesce.items():
        if len({df.schema[n].dataType.simpleString() for n in group}) > 1:
            raise BuildError(f"{name} is of columns of different types")
    if found := _violations(df, {n: derive.conflict([c(x) for x in g]) for n, g in contract.coalesce.items()}):
        raise BuildError(f"columns to coalesce disagree: {found}")
    for name, group in contract.coalesce.items():
        df = df.withColumn("_merged", F.coalesce(*map(c, group))).drop(*group).withColumnRenamed("_merged", name)
    df = select.rename(df, contract.rename)
    late = {*contract.zfill, *contract.casts, *(n for p in contract.date_parts.values() for n in p), *(n for p in contract.join_keys.values() for n in p)}
    if missing := sorted(late - set(df.columns)):
        raise BuildError(f"the contract names columns that are not there: {missing}")
    if found := _violations(df, {n: F.length(c(n)) > w for n, w in contract.zfill.items()}):
        raise BuildError(f"values are wider than their zero-filled width: {found}")
    df = df.withColumns({n: casts.zfill(c(n).cast("string"), w) for n, w in contract.zfill.items()})
    if lost := {n: k for n, k in casts.losses(df, contract.casts).items() if k}:
        raise BuildError(f"casts would lose values: {lost}")
    df = casts.cast_columns(df, contract.casts, audit=False)
    dates = {n: derive.date_parts(*(c(p) for p in parts)) for n, parts in contract.date_parts.items()}
    broken = {n: c(p[0]).isNotNull() & c(p[1]).isNotNull() & c(p[2]).isNotNull() & dates[n].isNull() for n, p in contract.date_parts.items()}
    if found := _violations(df, broken):
        raise BuildError(f"parts that make no date: {found}")
    return df.withColumns(dates | {n: derive.join_key([c(p).cast("string") for p in parts]) for n, parts in contract.join_keys.items()})


# -- the build


#: The number of a joined row on the right side.
RIGHT_SEQ = "_right_seq"


@dataclass
class SourceOutcome:
    key: str
    status: str = "success"
    error: str | None = None
    rows: int = 0
    checksum: str | None = None
    coverage: str = "unknown"
    fingerprints: dict[str, str] = field(default_factory=dict)
    quality: list[quality.Result] = field(default_factory=list)
    findings: list[tuple] = field(default_factory=list)
    drift: list[tuple] = field(default_factory=list)
    silver: DataFrame | None = None


@dataclass
class Build:
    status: str
    outcomes: list[SourceOutcome]
    gold: DataFrame | None = None
    splits: dict[str, int] = field(default_factory=dict)
    files: list[Path] = field(default_factory=list)
    snapshot: Snapshot | None = None
    manifest: dict[str, Any] = field(default_factory=dict)


def bronze(spark: SparkSession, s: Source, client: fetch.Client | None = None, warehouse: Warehouse | None = None, secrets: list[str] | None = None, fragments: fetch.Fragments | None = None, max_rows: int | None = None) -> tuple[DataFrame, str]:
    """(records with _row_seq, coverage) of a source."""
    if s.kind == "table":
        if warehouse is None:
            raise BuildError("a table source needs a warehouse")
        df = numbered(warehouse.read(s.path))
    elif s.kind == "api":
        if client is None:
            raise BuildError("an API source needs a client")
        got = fetch.fetch(client, readers.param_grid(s.params, s.param_grid), fragments, secrets, max_rows)
        return infer.load(infer.records(spark, got.records), read_as=s.contract.read_as), "partial" if got.stopped_early else provenance.coverage(got.totals)
    else:
        df = readers.read_any(spark, s.path, s.format, s.contract.read_as)
    return (df.orderBy(SEQ).limit(max_rows), "partial") if max_rows is not None else (df, "complete")


def run_source(spark: SparkSession, spec: BuildSpec, s: Source, baseline: dict | None = None, **more: Any) -> SourceOutcome:
    """Bronze and silver of one source, and its gates."""
    out = SourceOutcome(s.key)
    try:
        records, out.coverage = bronze(spark, s, **more)
        df = normalize(records, s.contract).persist(StorageLevel.MEMORY_AND_DISK)
        out.silver, out.rows = df, df.count()
        body = df.drop(SEQ)
        out.checksum = provenance.multiset_checksum(body)
        out.fingerprints = provenance.fingerprints(s.params, body.schema, {"params": s.params, "grid": s.param_grid})
        out.quality = quality.evaluate(body, list(s.rules))
        if any(r.status == "fail" for r in out.quality):
            raise BuildError("quality: " + "; ".join(f"{r.rule.kind} {r.rule.column or ''}".strip() for r in out.quality if r.status == "fail"))
        unmasked = body.drop(*s.mask)
        out.findings = [tuple(r) for r in pii.scan_values(unmasked).collect()]
        if out.findings and spec.pii_mode == "fail":
            raise BuildError(f"personal data in values: {out.findings}")
        if baseline:
            out.drift = quality.drift(baseline["schema"], baseline["rows"], body.schema, out.rows)
    except ValueError as error:
        out.status, out.error = "failed", str(error)
    return out


def run_build(spark: SparkSession, spec: BuildSpec, folder: str | Path | None = None, warehouse: Warehouse | None = None, clients: dict[str, fetch.Client] | None = None, baselines: dict[str, dict] | None = None) -> Build:
    """All sources, gold, exports, and the commit; a source that fails is reported and the rest goes on."""
    if bad := problems(spec):
        raise BuildError("; ".join(bad))
    outcomes = [run_source(spark, spec, s, (baselines or {}).get(s.key), client=(clients or {}).get(s.key), warehouse=warehouse) for s in spec.sources]
    good = {o.key: o for o in outcomes if o.status == "success"}
    build = Build("success" if len(good) == len(outcomes) else "failed", outcomes)
    try:
        if build.status == "success":
            _gold(spark, spec, build, good, folder, warehouse)
    except (ValueError, RuntimeError) as error:
        build.status = "failed"
        build.manifest["error"] = str(error)
    build.manifest |= {
        "dataset": spec.dataset, "status": build.status, "spec": hashlib.sha256(spec.digest_text().encode()).hexdigest(),
        "inputs": provenance.inputs_fingerprint({o.key: o.checksum for o in outcomes}),
        "sources": {o.key: {"status": o.status, "error": o.error, "rows": o.rows, "checksum": o.checksum, "coverage": o.coverage, "fingerprints": o.fingerprints, "quality": [(r.rule.kind, r.rule.column, r.status) for r in o.quality], "drift": o.drift, "findings": o.findings} for o in outcomes},
        "splits": build.splits, "split_algorithm": "hash-sort-v2" if spec.split else None, "snapshot": build.snapshot.snapshot_id if build.snapshot else None,
    }
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        (Path(folder) / "manifest.json").write_text(json.dumps(build.manifest, indent=1, sort_keys=True, default=str, ensure_ascii=False), encoding="utf-8")
    for o in outcomes:
        if o.silver is not None:
            o.silver.unpersist()
    return build


def _gold(spark: SparkSession, spec: BuildSpec, build: Build, good: dict[str, SourceOutcome], folder: str | Path | None, warehouse: Warehouse | None) -> None:
    first = spec.sources[0]
    if spec.composition:
        second, keys = spec.sources[1], spec.composition.keys
        # Columns that are no keys are masked before the join, keys after it.
        left = pii.mask(good[first.key].silver, [c for c in first.mask if c not in {a for a, _ in keys}])
        right = pii.mask(good[second.key].silver.withColumnRenamed(SEQ, RIGHT_SEQ), [c for c in second.mask if c not in {b for _, b in keys}])
        joined = joins.compose(left, right, spec.composition)
        gold = pii.mask(joined, [c for c in first.mask if c in {a for a, _ in keys}])
    else:
        gold = pii.mask(select.select(good[first.key].silver, first.filters), list(first.mask))
        if first.columns:
            gold = select.select(gold, columns=[*first.columns, SEQ])
    # Rows that one left row met follow the right side's order; those without a right row have none to follow.
    order = [F.col("_source_seq"), *([F.col(RIGHT_SEQ)] if RIGHT_SEQ in gold.columns else [])]
    gold = numbered(gold.withColumnRenamed(SEQ, "_source_seq"), order).drop("_source_seq", RIGHT_SEQ)
    if spec.split:
        gold = splits.ratio_split(gold, spec.split, spec.split_seed)
    elif spec.split_key:
        gold = splits.key_split(gold, spec.split_key).drop("split_order")
    build.gold = gold.drop(SEQ)
    if "split" in build.gold.columns and (spec.split or spec.split_key):
        build.splits = {r["split"]: r["n"] for r in build.gold.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if folder:
        body = gold.orderBy(SEQ).drop(SEQ)
        if build.splits:
            build.files += [sinks.write_parquet(body.where(F.col("split") == n).drop("split"), Path(folder) / "gold" / splits.file_name(n)) for n in sorted(build.splits)]
        build.files += [sinks.export(body, e.kind, Path(folder) / e.path) for e in spec.exports]
    if warehouse:
        build.snapshot = warehouse.materialize(build.gold, spec.dataset, allow_empty=all(s.allow_empty for s in spec.sources))


# -- preview


@dataclass(frozen=True)
class Preview:
    rows: list
    total_seen: int
    changes: list[tuple[int, str, Any, Any]]
    change_counts: dict[str, int]
    statistics: dict[str, Any]
    quality: list[quality.Result]


def preview(spark: SparkSession, spec: BuildSpec, key: str, limit: int = 20, max_rows: int = 1000, seed: int | None = None, **more: Any) -> Preview:
    """A bounded run of one source: a sample of silver rows, and cells that normalisation changed, with exact counts.

    Row numbers tie both sides together, as no step adds, drops or moves a row.
    """
    s = next(x for x in spec.sources if x.key == key)
    before, _ = bronze(spark, s, max_rows=max_rows, **more)
    after = normalize(before, s.contract)
    n = after.count()
    picked = sorted(random.Random(seed).sample(range(n), min(limit, n))) if seed is not None else list(range(min(limit, n)))
    names = [c for c in before.columns if c in after.columns and c != SEQ]
    text = lambda df: df.select(SEQ, *(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)))
    both = text(before).alias("b").join(text(after).alias("a"), SEQ)
    differ = {c: ~F.col(f"b.c{i}").eqNullSafe(F.col(f"a.c{i}")) for i, c in enumerate(names)}
    counts = both.agg(*(F.count_if(d).alias(f"n{i}") for i, d in enumerate(differ.values()))).first() if names else ()
    cells = both.select(SEQ, F.explode(F.filter(F.array(*(F.when(d, F.struct(F.lit(c).alias("column"), F.col(f"b.c{i}").alias("before"), F.col(f"a.c{i}").alias("after"))) for i, (c, d) in enumerate(differ.items()))), lambda x: x.isNotNull())).alias("x")).select(SEQ, "x.*").orderBy(SEQ, "column").limit(limit) if names else None
    body = after.drop(SEQ)
    return Preview(after.where(F.col(SEQ).isin(*picked)).orderBy(SEQ).drop(SEQ).collect() if picked else [], n, [tuple(r) for r in cells.collect()] if cells is not None else [], {c: counts[i] for i, c in enumerate(names) if counts[i]}, summary.table_statistics(body).first().asDict(), quality.evaluate(body, list(s.rules)))

