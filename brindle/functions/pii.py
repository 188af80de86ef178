"""Personal data: patterns in values, hints in column names, and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "[masked]"
# What a value is asked, and the parts of column names that hint at a kind.
PATTERNS = {
    "phone": r"(?U)\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b",
    "email": r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "business_no": r"(?U)\b\d{3}-\d{2}-\d{5}\b",
}
RRN_DASHED, RRN_JOINED = r"(?U)\b\d{6}-[1-4]\d{6}\b", r"(?U)\b\d{6}[1-4]\d{6}\b"
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
NAME_PARTS = {
    "name": ("NM", "NAME", "성명", "이름"),
    "phone": ("TEL", "TELNO", "PHONE", "HP", "MOBILE", "연락처"),
    "addr": ("ADDR", "ADRES", "주소"),
    "email": ("EMAIL", "이메일"),
    "rrn": ("RRN", "JUMIN", "주민", "SSN"),
}
KINDS = ("rrn", *PATTERNS)
#: What a text of each kind cannot do without, and what is cheap to look for.
NEEDS = {"phone": "01", "email": "@", "business_no": "-"}


def _issued(number: Column) -> Column:
    """Whether thirteen joined digits are a birthday and a number that could have been issued for it."""
    digit = lambda i: F.substr(number, F.lit(i + 1), F.lit(1)).try_cast("int")
    month, day = F.substr(number, F.lit(3), F.lit(2)).try_cast("int"), F.substr(number, F.lit(5), F.lit(2)).try_cast("int")
    longest = F.when(month == 2, 29).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    total = sum((digit(i) * w for i, w in enumerate(RRN_WEIGHTS)), F.lit(0))
    checks = digit(12) == (F.lit(11) - total % 11) % 10
    # Numbers given out lately, to those born in this century, carry no check.
    return F.coalesce(month.between(1, 12) & (day >= 1) & (day <= longest) & (digit(6).isin(3, 4) | checks), F.lit(False))


def holds(value: Column, kind: str) -> Column:
    """Whether a text holds this kind of personal data."""
    if kind != "rrn":
        return F.coalesce(value.contains(NEEDS[kind]) & value.rlike(PATTERNS[kind]), F.lit(False))
    joined = F.regexp_extract_all(value, F.lit(RRN_JOINED), F.lit(0))
    dashed = value.rlike("-[1-4]") & value.rlike(RRN_DASHED)
    return F.coalesce(dashed | (value.rlike(r"\p{Nd}{6}[1-4]\p{Nd}{6}") & F.exists(joined, _issued)), F.lit(False))


def scan_values(df: DataFrame) -> DataFrame:
    """(column, kind, count) of text columns with values that hold personal data; one pass over df."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = [(n, k) for n in names for k in KINDS]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, kind string, count long")
    counts = df.agg(*(F.count_if(holds(F.col(f"`{n}`"), k)).alias(f"p{i}") for i, (n, k) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(k).alias("kind"), F.col(f"p{i}").alias("count")) for i, (n, k) in enumerate(pairs)))
    return counts.select(F.inline(rows)).where("count > 0")


def suspect_kind(column: str) -> str | None:
    """The kind of personal data that a column's name hints at, the first that fits."""
    name = column.upper()
    return next((kind for kind, parts in NAME_PARTS.items() if any(p in name for p in parts)), None)


def scan_names(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, k) for c in df.columns if (k := suspect_kind(c))]


def mask(df: DataFrame, columns: list[str]) -> DataFrame:
    """Texts become [masked], nulls stay null; every other type becomes null of its type."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns to mask: {missing}")

    def masked(c: str) -> Column:
        t = df.schema[c].dataType
        return F.when(F.col(f"`{c}`").isNotNull(), F.lit(MASK)) if isinstance(t, T.StringType) else F.lit(None).cast(t)

    return df.withColumns({c: masked(c) for c in columns})
