"""Secret scans: an Aho-Corasick keyword prefilter, anchored expressions at its hits, checksum validation.

One pass over a text's ASCII-lower-cased copy yields every place a keyword starts. Only there is the
expression of that keyword's kind tried, anchored, from left to right and never inside an earlier match
of its kind, which gives the same matches as searching the whole text. Runs of hex digits hold no
keyword and are searched for as runs. Access tokens that end in a CRC-32 of their own payload count
only if that checksum holds.

Offsets are code points, ends exclusive. A null text has no spans; copies of a row are each scanned;
null ids stay. Nothing is shuffled and texts are handled one at a time, whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import small_batches, table

#: Kinds in the order in which spans with one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
# Keywords, expressions and least lengths of the kinds.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def base62_crc(payload: str) -> str:
    value, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def _assign(text: str, at: int) -> tuple[int, bool] | None:
    m = ASSIGN.match(text, at)
    return m and (m.end(), m.end(2) - m.start(2) >= 6)


def _access(text: str, at: int) -> tuple[int, bool] | None:
    m = ACCESS.match(text, at)
    return m and (m.end(), m.end() - at >= 20)


def _checked(text: str, at: int) -> tuple[int, bool] | None:
    m = CHECKED.match(text, at)
    return m and (m.end(), base62_crc(m[1]) == m[2])


_RULES = {"assign": _assign, "access": _access, "github": _checked, "npm": _checked}


@lru_cache(maxsize=1)
def _prefilter() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of text, by start and then by kind as listed."""
    if not text:
        return []
    spans = [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    # bytes.lower() touches A-Z alone, so that offsets in the copy are offsets in the text.
    hits = [(end + 1 - n, kind) for end, (kind, n) in _prefilter().iter(text.encode().lower().decode())]
    past = dict.fromkeys(_RULES, 0)
    for start, kind in sorted(hits):
        if start >= past[kind] and (found := _RULES[kind](text, start)):
            past[kind] = found[0]
            if found[1]:
                spans.append((kind, start, found[0]))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def redact_text(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with every span, overlapping ones as one, replaced by mark."""
    out, past = [], 0
    for _, start, end in spans:
        if start >= past:
            out += [text[past:start], mark]
        past = max(past, end)
    return "".join(out) + text[past:]


def scan(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with the array of (kind, start, end) of its texts. An existing column named spans is refused."""
    if spans in df.columns:
        raise ValueError(f"column {spans} is there already")
    schema = T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end")
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = pa.array([[dict(zip(names, s, strict=True)) for s in find_spans(t.as_py())] for t in part.column(text)], _ARROW_SPANS)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, spans])

    return small_batches(df).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the secrets of its texts replaced; other columns and null texts stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                i = part.schema.get_field_index(text)
                fresh = [t if t is None else redact_text(t, find_spans(t)) for t in (x.as_py() for x in part.column(i))]
                yield pa.RecordBatch.from_arrays([*part.columns[:i], pa.array(fresh, part.schema.field(i).type), *part.columns[i + 1 :]], part.schema.names)

    return small_batches(df).mapInArrow(run, df.schema)


def _of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", spread="doc_id").select("doc_id", "text"))
    spans = F.col("spans")
    counts = [F.size(_of_kinds(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = _of_kinds(spans, *BASE_KINDS)
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))
