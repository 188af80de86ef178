"""The declarative spec of a build, and its structural rules, which are checked before any data is read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from brindle.functions.casts import NAMES
from brindle.operators.joins import JoinSpec
from brindle.operators.quality import Rule
from brindle.operators.select import Filter
from brindle.operators.splits import SplitError, check_ratios
from brindle.sources.readers import SourceError, param_grid

KINDS, FORMATS = ("file", "url", "api", "table"), ("csv", "json", "jsonl", "parquet")


@dataclass(frozen=True)
class Contract:
    """Applied in this order: read_as, null tokens, coalesce, rename, zfill, casts, derived."""

    read_as: dict[str, str] = field(default_factory=dict)
    null_tokens: tuple[str, ...] = ()
    column_null_tokens: dict[str, tuple[str, ...]] = field(default_factory=dict)
    coalesce: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rename: dict[str, str] = field(default_factory=dict)
    zfill: dict[str, int] = field(default_factory=dict)
    casts: dict[str, str] = field(default_factory=dict)
    date_parts: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    join_keys: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    key: str
    kind: str = "file"
    path: str | None = None
    format: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    param_grid: dict[str, list[Any]] = field(default_factory=dict)
    contract: Contract = Contract()
    rules: tuple[Rule, ...] = ()
    filters: tuple[Filter, ...] = ()
    columns: tuple[str, ...] = ()
    mask: tuple[str, ...] = ()
    allow_empty: bool = False
    refresh_cadence: str | None = None


@dataclass(frozen=True)
class Export:
    kind: str
    path: str


@dataclass(frozen=True)
class BuildSpec:
    dataset: str
    sources: tuple[Source, ...]
    composition: JoinSpec | None = None  # of the first source with the second
    split: dict[str, float] | None = None
    split_key: str | None = None
    split_seed: int = 0
    exports: tuple[Export, ...] = ()
    pii_mode: str = "fail"  # or warn or allow
    publish: bool = False

    def digest_text(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, ensure_ascii=False, default=str)


def problems(spec: BuildSpec) -> list[str]:
    """What is wrong with a spec; empty if nothing is."""
    out = []
    if not spec.sources:
        out.append("a build has at least one source")
    keys = [s.key for s in spec.sources]
    if len(set(keys)) < len(keys) or any(not k.isidentifier() for k in keys):
        out.append("source keys are unique names")
    for s in spec.sources:
        out += [f"{s.key}: {p}" for p in _source_problems(s)]
    out += _split_problems(spec) + _composition_problems(spec) + _export_problems(spec)
    if spec.pii_mode not in ("fail", "warn", "allow"):
        out.append("pii mode is fail, warn or allow")
    if spec.pii_mode == "allow" and spec.publish:
        out.append("personal data that is allowed is not published")
    return out


def _source_problems(s: Source) -> list[str]:
    out, c = [], s.contract
    if s.kind not in KINDS:
        out.append(f"unknown kind {s.kind!r}")
    if s.kind in ("file", "url") and (not s.path or s.format not in FORMATS):
        out.append("a file or URL has a path and a known format")
    if s.kind == "url" and s.path and not s.path.startswith("https://"):
        out.append("URLs are https")
    out += [f"unknown cast {t!r} of {n}" for n, t in c.casts.items() if t.strip().lower() not in NAMES]
    if any(not isinstance(t, str) for t in (*c.null_tokens, *(t for ts in c.column_null_tokens.values() for t in ts))):
        out.append("null tokens are texts")
    named = [n for group in c.coalesce.values() for n in group]
    if len(set(named)) < len(named) or any(len(g) < 2 for g in c.coalesce.values()):
        out.append("coalesce groups have two columns or more and share none")
    out += [f"zfill width of {n} is at least 1" for n, w in c.zfill.items() if w < 1]
    if len(set(c.rename.values())) < len(c.rename):
        out.append("two columns are renamed alike")
    made = [*c.coalesce, *c.date_parts, *c.join_keys]
    if len(set(made)) < len(made) or any(len(p) != 3 for p in c.date_parts.values()) or any(not p for p in c.join_keys.values()):
        out.append("derived columns have names of their own, dates three parts, keys at least one")
    for r in s.rules:
        if r.kind == "range" and (r.low is None and r.high is None or r.low is not None and r.high is not None and r.low > r.high):
            out.append("a range has a bound, and its low is not above its high")
        if r.severity not in ("warn", "fail"):
            out.append(f"unknown severity {r.severity!r}")
    try:
        param_grid(s.params, s.param_grid)
    except SourceError as error:
        out.append(str(error))
    return out


def _split_problems(spec: BuildSpec) -> list[str]:
    if spec.split is None:
        return []
    try:
        check_ratios(spec.split, spec.split_key)
    except SplitError as error:
        return [str(error)]
    return []


def _composition_problems(spec: BuildSpec) -> list[str]:
    if spec.composition is None:
        return []
    out = []
    if len(spec.sources) != 2:
        out.append("a composition joins two sources")
    if any(s.filters or s.columns for s in spec.sources):
        out.append("sources of a composition have no selection of their own")
    pairs = spec.composition.keys
    if not pairs or any(not a.strip() or not b.strip() for a, b in pairs) or len({a for a, _ in pairs}) < len(pairs) or len({b for _, b in pairs}) < len(pairs):
        out.append("key columns have names and do not repeat")
    return out


def _export_problems(spec: BuildSpec) -> list[str]:
    paths = [PurePosixPath(e.path) for e in spec.exports]
    out = [f"export path {p} leaves the build" for p in paths if p.is_absolute() or ".." in p.parts]
    for i, a in enumerate(paths):
        if a.parts[:1] == ("gold",):
            out.append(f"export path {a} is the build's own")
        out += [f"export paths {a} and {b} overlap" for b in paths[i + 1 :] if a == b or a in b.parents or b in a.parents]
    return out


def load(path: str | Path) -> BuildSpec:
    """A spec from a JSON file of its fields."""
    body = json.loads(Path(path).read_text(encoding="utf-8"))
    tuples = lambda d, names: d | {n: tuple(d[n]) for n in names if n in d}
    sources = []
    for s in body.get("sources", []):
        c = tuples(s.get("contract", {}), ["null_tokens"])
        for n in ("column_null_tokens", "coalesce", "date_parts", "join_keys"):
            if n in c:
                c[n] = {k: tuple(v) for k, v in c[n].items()}
        sources.append(Source(**tuples(s, ["columns", "mask"]) | {"contract": Contract(**c), "rules": tuple(Rule(**r) for r in s.get("rules", [])), "filters": tuple(Filter(**f) for f in s.get("filters", []))}))
    j = body.get("composition")
    join = JoinSpec(**j | {"keys": tuple(map(tuple, j["keys"]))}) if j else None
    return BuildSpec(**body | {"sources": tuple(sources), "composition": join, "exports": tuple(Export(**e) for e in body.get("exports", []))})
