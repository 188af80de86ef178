"""Build history: hourly buckets, trailing windows, the latest run of each dataset, nearest-rank percentiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_buckets(runs: DataFrame, start: datetime, hours: int, statuses: tuple[str, ...], at: str = "ts", status: str = "status") -> DataFrame:
    """(hour, total, one column per status): half-open hours from start, empty ones included.

    Rows whose time is null or no time fall in no hour; excluded() counts them.
    """
    begin = F.lit(start).cast("timestamp_ntz")
    hour = F.date_trunc("hour", F.col(at)).cast("timestamp_ntz")
    within = runs.where((F.col(at) >= begin) & (F.col(at) < begin + F.expr(f"INTERVAL {hours} HOURS")))
    counts = within.groupBy(hour.alias("hour")).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s) for s in statuses))
    spine = runs.sparkSession.range(hours).select((begin + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("hour"))
    # Both sides have so many hours at most.
    return spine.join(counts, "hour", "left").fillna(0)


def excluded(runs: DataFrame, at: str = "ts") -> DataFrame:
    """(excluded, availability): rows that buckets leave out for their time, which may be text; partial if there are any."""
    n = F.count_if(F.col(at).try_cast("timestamp_ntz").isNull())
    return runs.agg(n.alias("excluded")).select("excluded", F.when(F.col("excluded") > 0, "partial").otherwise("available").alias("availability"))


def window_summary(runs: DataFrame, now: datetime, hours: int = 24, at: str = "ts", status: str = "status") -> DataFrame:
    """(evaluated, one count per status) over (now - hours, now]."""
    end = F.lit(now).cast("timestamp_ntz")
    return runs.where((F.col(at) > end - F.expr(f"INTERVAL {hours} HOURS")) & (F.col(at) <= end)).groupBy(status).agg(F.count("*").alias("runs"))


def latest_per_key(runs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's row that is greatest in order: one aggregate, without a sort of a key's rows."""
    columns = [F.col(c) for c in runs.columns]
    return runs.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")


#: Half the width, as a share of a group's rows, of the band that an exact rank is sought in, and the accuracy of its ends.
_BAND, _ACCURACY = 0.001, 10_000


def nearest_rank(df: DataFrame, column: str, by: list[str], share: float = 0.95) -> DataFrame:
    """(by, value): the least value that at least share of a group's values do not exceed.

    Approximate percentiles with a bounded error give a band around the rank; what lies below it is counted, and only
    the band's distinct values, with their counts, are sorted: no task sorts a group. Nulls are no values.
    """
    v = F.col(column)
    ends = F.percentile_approx(v, [max(0.0, share - _BAND), min(1.0, share + _BAND)], _ACCURACY)
    rows = df.where(v.isNotNull()).select(*by, v.alias("value"))
    bands = df.where(v.isNotNull()).groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count("*").alias("_n"), ends.alias("_ends"))
    met = rows.join(bands, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else rows.crossJoin(F.broadcast(bands))
    # All that is below a band counts as one row of the value null, which sorts first.
    inside = met.where(F.col("value") <= F.col("_ends")[1]).groupBy(*by, "_n", F.when(F.col("value") >= F.col("_ends")[0], F.col("value")).alias("value")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("value")))
    reached = inside.withColumn("_upto", upto).where(F.col("value").isNotNull() & (F.col("_upto") >= F.ceil(F.lit(share) * F.col("_n"))))
    return reached.groupBy(*by).agg(F.min("value").alias("value"))


def status_axes(finished: datetime | None, now: datetime, cadence: str | None, coverage: str, failed: int, warned: int) -> dict[str, str]:
    """refresh (fresh, stale, unknown), completeness and health of a dataset's last run."""
    from brindle.functions.cadence import is_stale

    stale = is_stale(cadence, finished, now)
    return {"refresh": "unknown" if stale is None else "stale" if stale else "fresh", "completeness": coverage, "health": "fail" if failed else "warn" if warned else "pass"}
