"""The library's registered queries, one or more per operator, each with the DuckDB SQL that gives the same rows.

No table of the driver holds a null or a NaN, so that queries about those make them on both sides alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import casts, derive, legacy, pii, wire
from brindle.operators import aggregate, history, joins, provenance, quality, rows, select, splits, summary, warehouse
from brindle.operators.stable import shared_folder
from brindle.plans import build, spec, validator
from brindle.sources import infer, readers, sinks, tagged
from brindle.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE_SQL[name or fn.__name__] = sql
        return fn

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- D: aggregates


def _aggregate(table: str, body: dict) -> Query:
    return lambda spark, d: aggregate.run(t(spark, d, table), aggregate.parse(body)).rows


query("""SELECT l_returnflag, l_linestatus, count(*) AS count_rows, CAST(count(l_partkey) AS BIGINT) AS parts, round(avg(l_discount), 8) AS avg_discount, min(l_quantity) AS low, max(l_extendedprice) AS high
FROM lineitem GROUP BY 1, 2 ORDER BY high DESC NULLS LAST, 1, 2 LIMIT 3""", "agg_pricing_topn")(
    lambda spark, d: _aggregate("lineitem", {"group_by": ["l_returnflag", "l_linestatus"], "measures": [{"fn": "count_rows"}, {"fn": "count", "column": "l_partkey", "alias": "parts"}, {"fn": "avg", "column": "l_discount", "alias": "avg_discount"}, {"fn": "min", "column": "l_quantity", "alias": "low"}, {"fn": "max", "column": "l_extendedprice", "alias": "high"}], "order": [{"by": "high", "desc": True}], "limit": 3})(spark, d).withColumn("avg_discount", F.round("avg_discount", 8))
)


@query("""SELECT event_type, count(*) AS n, count(v) AS with_value, count(*) - count(v) AS without, count(DISTINCT user_id) AS users
FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events) GROUP BY 1""")
def agg_count_family(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    body = {"group_by": ["event_type"], "measures": [{"fn": "count_rows", "alias": "n"}, {"fn": "count", "column": "v", "alias": "with_value"}, {"fn": "count_null", "column": "v", "alias": "without"}, {"fn": "count_distinct", "column": "user_id", "alias": "users"}]}
    return aggregate.run(e, aggregate.parse(body)).rows


query("SELECT l_returnflag, CAST(sum(l_orderkey) AS DECIMAL(38,0)) AS keys FROM lineitem GROUP BY 1", "agg_sum_int128")(_aggregate("lineitem", {"group_by": ["l_returnflag"], "measures": [{"fn": "sum", "column": "l_orderkey", "alias": "keys", "additive": True}]}))
query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10", "agg_unit_split")(_aggregate("orders", {"group_by": ["o_orderpriority"], "unit_column": "o_orderstatus", "unit_policy": "split", "measures": [{"fn": "count_rows", "alias": "n"}], "order": [{"by": "n", "desc": True}], "limit": 10}))


@query("SELECT o_orderpriority, count(DISTINCT o_orderstatus) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) AS units FROM orders GROUP BY 1 HAVING units > 1 ORDER BY 1 LIMIT 5")
def agg_unit_mixed(spark: SparkSession, d: str) -> DataFrame:
    plan = aggregate.parse({"group_by": ["o_orderpriority"], "unit_column": "o_orderstatus", "measures": [{"fn": "count_rows"}]})
    try:
        aggregate.run(t(spark, d, "orders"), plan)
    except aggregate.MixedUnits as refused:
        return spark.createDataFrame(refused.samples, "o_orderpriority string, units long")
    raise AssertionError("mixed units were not refused")


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS type, false AS nullable, count(DISTINCT o_orderkey) AS "distinct", min(o_orderkey) AS min, max(o_orderkey) AS max FROM orders
UNION ALL SELECT 's', 'string', true, count(DISTINCT nullif(o_orderstatus, 'F')) + 1, NULL, NULL FROM orders""")
def schema_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.schema_summary(t(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s")))


@query("SELECT 5 * 2 * count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)) AS distinct_rows, 1 - (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)) / (10 * count(*))::DOUBLE AS duplicate_rate FROM nation")
def table_stats(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").select("n_regionkey")
    return summary.table_statistics(n.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(10)))).select("n_regionkey"))


@query("""SELECT 'value' AS "column", count(*) FILTER (v IS NULL) AS nulls FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)
UNION ALL SELECT 'event_type', count(*) FILTER (nullif(event_type, 'error') IS NULL) FROM events""")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.null_counts(t(spark, d, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.nullif("event_type", F.lit("error")).alias("event_type")))


@query("""SELECT 'value' AS "column", count(*) AS rows, count(*) FILTER (event_id % 7 = 0) AS nulls, count(*) FILTER (event_id % 7 = 1) AS nan, count(*) FILTER (event_id % 7 = 2) AS infinite,
(SELECT v FROM (SELECT value AS v, row_number() OVER (ORDER BY value) AS r FROM events WHERE event_id % 7 > 2) WHERE r = 6) AS low,
(SELECT v FROM (SELECT value AS v, row_number() OVER (ORDER BY value DESC) AS r FROM events WHERE event_id % 7 > 2) WHERE r = 6) AS high FROM events""")
def profile_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    e = t(spark, d, "events").select(F.when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).when(k > 2, F.col("value")).alias("value"))
    p = summary.profile(e)[0]
    return spark.createDataFrame([(p["column"], p["rows"], p["nulls"], p["nan"], p["infinite"], *p["range"])], "column string, rows long, nulls long, nan long, infinite long, low double, high double")


@query("""SELECT event_type, max(CASE WHEN a = 6 THEN value END) AS low, max(CASE WHEN b = 6 THEN value END) AS high FROM (
SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS a, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS b FROM events) GROUP BY 1""")
def profile_range_trimmed(spark: SparkSession, d: str) -> DataFrame:
    return summary.trimmed_range(t(spark, d, "events"), "value", ["event_type"])


@query("""SELECT 'c_acctbal' AS "column", round(avg(c_acctbal), 6) AS mean, round(stddev(c_acctbal), 6) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer""")
def describe_numeric(spark: SparkSession, d: str) -> DataFrame:
    return summary.describe(t(spark, d, "customer").select("c_acctbal")).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_STATUSES = ("click", "error", "purchase", "signup", "view")
_START = datetime(2024, 1, 1)


@query("""WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01' + INTERVAL 47 HOUR, INTERVAL 1 HOUR)) AS hour)
SELECT hour, count(event_id) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
FROM s LEFT JOIN events ON date_trunc('hour', ts) = hour GROUP BY 1""")
def hourly_buckets(spark: SparkSession, d: str) -> DataFrame:
    return history.hourly_buckets(t(spark, d, "events"), _START, 48, _STATUSES, status="event_type")


@query("SELECT event_type, count(*) AS runs FROM events WHERE ts > TIMESTAMP '2024-01-01 12:00:00' AND ts <= TIMESTAMP '2024-01-02 12:00:00' GROUP BY 1")
def window_24h(spark: SparkSession, d: str) -> DataFrame:
    return history.window_summary(t(spark, d, "events"), datetime(2024, 1, 2, 12), status="event_type")


@query("SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return history.latest_per_key(t(spark, d, "events").drop("props"), "user_id", ["ts", "event_id"])


@query("SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def p95_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return history.nearest_rank(t(spark, d, "events"), "value", ["event_type"])


QUERIES |= {"join_nan_keys_whole": lambda spark, d: QUERIES["join_nan_keys"](spark, d), "union_by_name_whole": lambda spark, d: QUERIES["union_by_name"](spark, d)}


@query("SELECT count(*) FILTER (event_id % 5 = 0 OR event_id % 7 = 0) AS excluded, 'partial' AS availability FROM events")
def hourly_excluded(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return history.excluded(t(spark, d, "events").select(F.when(i % 5 != 0, F.when(i % 7 == 0, F.lit("no time")).otherwise(F.col("ts").cast("string"))).alias("ts")))


# The shape of the published measure of the engine that this library is held against: 200 000 rows, 200 groups.
query("SELECT k, count(*) AS n, CAST(sum(l_linenumber) AS DECIMAL(38,0)) AS s FROM (SELECT l_orderkey % 200 AS k, l_linenumber FROM lineitem) GROUP BY 1 ORDER BY k LIMIT 1000", "agg_200k_by_200")(
    lambda spark, d: aggregate.run(t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") % 200), aggregate.parse({"group_by": ["k"], "limit": 1000, "measures": [{"fn": "count_rows", "alias": "n"}, {"fn": "sum", "column": "l_linenumber", "alias": "s", "additive": True}]})).rows
)

# -- F, B: pages, selections

query("SELECT o_orderkey, o_custkey, s FROM (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS s FROM orders) ORDER BY s DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20", "rows_page")(
    lambda spark, d: rows.page(t(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))), rows.RowsPlan(columns=("o_orderkey", "o_custkey", "s"), sort=(("s", True),), offset=20, limit=50), "o_orderkey")
)
_FILTERS = [{"column": "event_type", "op": "in", "value": ["click", "view"]}, {"column": "value", "op": "gte", "value": 20}, {"column": "user_id", "op": "ne", "value": "7"}, {"column": "props", "op": "is_not_null"}]
query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view') AND value >= 20 AND user_id <> 7 AND props IS NOT NULL ORDER BY value NULLS LAST, event_id LIMIT 100", "rows_filtered_page")(
    lambda spark, d: rows.page(t(spark, d, "events"), rows.RowsPlan(columns=("event_id", "event_type", "value"), filters=rows.parse_filters(_FILTERS), sort=(("value", False),)), "event_id")
)
query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 25", "preview_head")(lambda spark, d: rows.preview(t(spark, d, "events").select("event_id", "value"), 25, "event_id"))
query("SELECT * FROM (VALUES (5), (2), (11)) v(event_id)", "rows_at_indices")(lambda spark, d: select.rows_at(t(spark, d, "events").select("event_id"), [5, 2, 11], "event_id"))
query("SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS n FROM events", "row_numbers")(lambda spark, d: select.numbered(t(spark, d, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], "n").select("event_id", "n"))


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    return rows.sample(t(spark, d, "events").select("event_id", "value"), 40, 11, "event_id")


query(None, "seeded_sample")(_sampled)

for _op, _value, _sql in (("eq", 10, "= 10"), ("ne", 10, "<> 10"), ("gt", 25, "> 25"), ("ge", 25, ">= 25"), ("lt", 5, "< 5"), ("le", 5, "<= 5"), ("in", [1, 2, 3], "IN (1, 2, 3)"), ("not_null", None, "IS NOT NULL")):
    query(f"SELECT s, p_partkey FROM (SELECT *, nullif(p_size, 7) AS s FROM part) WHERE coalesce(s {_sql}, false)", f"gold_select_filter_{_op}")(
        lambda spark, d, op=_op, value=_value: select.select(t(spark, d, "part").withColumn("s", F.nullif("p_size", F.lit(7))), [select.Filter("s", op, value)], ["s", "p_partkey"])
    )
query("SELECT c_mktsegment AS segment, count(*) AS count FROM customer GROUP BY 1", "distinct_text_values")(lambda spark, d: select.distinct_values(select.rename(t(spark, d, "customer"), {"c_mktsegment": "segment"}), "segment"))

# -- C: joins

_ORDERS = "(SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)"
_CUSTOMERS = "(SELECT * FROM customer WHERE c_custkey % 3 <> 0)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = t(spark, d, "orders").withColumn("k", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")))
    return left, t(spark, d, "customer").where("c_custkey % 3 <> 0")


def _composed(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        left, right = _sides(spark, d)
        return joins.compose(left.select("o_orderkey", "k", "o_totalprice"), right.withColumnRenamed("c_acctbal", "o_totalprice").select("c_custkey", "c_name", "o_totalprice"), joins.JoinSpec((("k", "c_custkey"),), how, "c"))

    return run


query(f"SELECT o_orderkey, k, o.o_totalprice, c_name, c_acctbal AS o_totalprice_c FROM {_ORDERS} o JOIN {_CUSTOMERS} c ON k = c_custkey", "join_inner")(_composed("inner"))
query(f"SELECT o_orderkey, k, o.o_totalprice, c_name, c_acctbal AS o_totalprice_c FROM {_ORDERS} o LEFT JOIN {_CUSTOMERS} c ON k = c_custkey", "join_left")(_composed("left"))


@query("""WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_linenumber = 1), b AS (SELECT l_suppkey AS s, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, n FROM a JOIN b ON l_suppkey = s AND l_returnflag = f""")
def join_composite(spark: SparkSession, d: str) -> DataFrame:
    line = t(spark, d, "lineitem")
    a = line.where("l_linenumber = 1").select("l_suppkey", "l_returnflag").distinct()
    b = line.groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")).agg(F.count("*").alias("n"))
    return joins.compose(a, b, joins.JoinSpec((("l_suppkey", "s"), ("l_returnflag", "f"))))


@query("SELECT e.event_id, n FROM events e JOIN (SELECT value, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY value) f ON e.value = f.value WHERE e.event_id % 3 <> 0")
def join_nan_keys(spark: SparkSession, d: str) -> DataFrame:
    """All events; the other side is one row per value, NaN included, so that the result grows with the table."""
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return joins.compose(e, e.groupBy("v").agg(F.count("*").alias("n")), joins.JoinSpec((("v", "v"),))).select("event_id", "n")


_STATS = f"""WITH o AS {_ORDERS}, c AS {_CUSTOMERS}, l AS (SELECT k, count(*) AS ln FROM o WHERE k IS NOT NULL GROUP BY 1), r AS (SELECT c_custkey AS k, count(*) AS rn FROM c GROUP BY 1),
m AS (SELECT k, coalesce(ln, 0) AS ln, coalesce(rn, 0) AS rn FROM l FULL JOIN r USING (k))"""


@query(f"""{_STATS} SELECT (SELECT count(*) FROM o) AS left_rows, (SELECT count(*) FROM c) AS right_rows, (SELECT count(*) FROM l) AS left_distinct_keys, (SELECT count(*) FROM r) AS right_distinct_keys,
(SELECT count(*) FROM o WHERE k IS NULL) AS left_null_keys, 0 AS right_null_keys,
((SELECT count(*) FROM o) - sum(ln) FILTER (ln > 0 AND rn > 0))::DOUBLE / (SELECT count(*) FROM o) AS left_unmatched_ratio, ((SELECT count(*) FROM c) - sum(rn) FILTER (ln > 0 AND rn > 0))::DOUBLE / (SELECT count(*) FROM c) AS right_unmatched_ratio,
'many_to_one' AS observed_cardinality, false AS duplicate_keys, CAST(sum(ln * rn) AS BIGINT) AS inner_rows, CAST(sum(ln * rn) + (SELECT count(*) FROM o) - sum(ln) FILTER (ln > 0 AND rn > 0) AS BIGINT) AS left_join_rows FROM m""")
def join_stats(spark: SparkSession, d: str) -> DataFrame:
    return joins.join_stats(*_sides(spark, d), (("k", "c_custkey"),))


@query("""SELECT k AS k0, ln, rn FROM (SELECT o_custkey AS k, count(*) AS ln FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS rn FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b USING (k)
WHERE ln > 0 AND rn > 0""")
def join_cardinality(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return joins.key_counts(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), (("o_custkey", "o_custkey"),)).where("ln > 0 and rn > 0")


@query("""SELECT k AS k0, ln, rn, ln * rn AS rows FROM (SELECT o_custkey AS k, count(*) AS ln FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) JOIN (SELECT o_custkey AS k, count(*) AS rn FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) USING (k)
WHERE ln > 1 AND rn > 1 ORDER BY rows DESC, k LIMIT 1""")
def join_worst_key(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    return joins.worst_key(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), (("o_custkey", "o_custkey"),))


@query("SELECT o_orderkey, c_name, row_number() OVER (ORDER BY o_orderkey, c_custkey) - 1 AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def join_stable_order(spark: SparkSession, d: str) -> DataFrame:
    j = joins.compose(t(spark, d, "orders"), t(spark, d, "customer"), joins.JoinSpec((("o_custkey", "c_custkey"),)))
    return select.numbered(j.select("o_orderkey", "c_name", "o_custkey"), [F.col("o_orderkey"), F.col("o_custkey")], "n").select("o_orderkey", "c_name", "n")


# -- J: splits


@query("SELECT o_orderkey, CASE WHEN p < 1500 THEN 'test' WHEN p < 12000 THEN 'train' ELSE 'valid' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS p FROM orders)".replace("1500", "(SELECT count(*) // 10 FROM orders)").replace("12000", "(SELECT count(*) * 8 // 10 FROM orders)"))
def split_ratio_members(spark: SparkSession, d: str) -> DataFrame:
    return splits.ratio_split(t(spark, d, "orders").select("o_orderkey"), {"train": 0.7, "valid": 0.2, "test": 0.1}, 7, "o_orderkey")


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN p < (SELECT count(*) // 10 FROM orders) THEN 'test' WHEN p < (SELECT count(*) * 8 // 10 FROM orders) THEN 'train' ELSE 'valid' END AS split FROM (SELECT row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) - 1 AS p FROM orders)) GROUP BY 1")
def split_ratio_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_ratio_members(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '__null__') AS split FROM customer), f AS (SELECT split, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS split_order FROM k GROUP BY 1)
SELECT c_custkey, split, split_order FROM k JOIN f USING (split)""")
def split_key(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return splits.key_split(c, "seg", "c_custkey").select("c_custkey", "split", "split_order")


# -- H: scalar functions


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """A text per event, of many forms."""
    v, i = F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id").cast("string")
    k = F.col("event_id") % 8
    return t(spark, d, "events").select("event_id", F.when(k == 0, i).when(k == 1, F.concat(F.lit("-"), i)).when(k == 2, F.concat(F.lit(" "), i)).when(k == 3, F.lit("")).when(k == 4, F.concat(i, F.lit("x"))).when(k == 5, F.concat(F.lit("+"), i)).when(k == 6, v).alias("s"))


_TEXTS = """(SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '-' || event_id WHEN 2 THEN ' ' || event_id WHEN 3 THEN '' WHEN 4 THEN event_id || 'x' WHEN 5 THEN '+' || event_id WHEN 6 THEN value::DECIMAL(18,2)::VARCHAR END AS s FROM events)"""
_STRING = T.StringType()
query(f"SELECT event_id, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN TRY_CAST(s AS BIGINT) END AS v FROM {_TEXTS}", "cast_int")(lambda spark, d: _texts(spark, d).select("event_id", casts.cast(F.col("s"), _STRING, "int").alias("v")))
query(f"SELECT event_id, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+(\\.[0-9]*)?') THEN TRY_CAST(s AS DOUBLE) END AS v FROM {_TEXTS}", "cast_float")(lambda spark, d: _texts(spark, d).select("event_id", casts.cast(F.col("s"), _STRING, "float").alias("v")))
query("SELECT event_id, CAST(trunc(CASE WHEN event_id % 2 = 0 THEN -value ELSE value END) AS BIGINT) AS v FROM events", "cast_float_to_int_truncates")(lambda spark, d: t(spark, d, "events").select("event_id", casts.cast(F.when(F.col("event_id") % 2 == 0, -F.col("value")).otherwise(F.col("value")), T.DoubleType(), "int").alias("v")))
query("SELECT event_id, CAST(trunc(CAST(value AS DECIMAL(18,2)) * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END) AS BIGINT) AS v FROM events", "cast_decimal_to_int_truncates")(lambda spark, d: t(spark, d, "events").select("event_id", casts.cast((F.col("value").cast("decimal(18,2)") * F.when(F.col("event_id") % 2 == 0, -1).otherwise(1)).cast("decimal(18,2)"), T.DecimalType(18, 2), "int").alias("v")))
_DATES = """(SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 3 THEN strftime(o_orderdate, '%Y-02-30') WHEN 4 THEN ' +' || strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y') END AS s FROM orders)"""


def _dates(spark: SparkSession, d: str) -> DataFrame:
    f, k = lambda p: F.date_format("o_orderdate", p), F.col("o_orderkey") % 6
    return t(spark, d, "orders").select("o_orderkey", F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy/MM/dd")).when(k == 2, f("yyyy-M-d")).when(k == 3, F.concat(f("yyyy"), F.lit("-02-30"))).when(k == 4, F.concat(F.lit(" +"), f("yyyy-MM-dd"))).otherwise(f("yyyy")).alias("s"))


query(f"SELECT o_orderkey, CASE WHEN regexp_full_match(s, '\\s*\\+?[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}\\s*') THEN TRY_CAST(ltrim(trim(s), '+') AS DATE) END AS v FROM {_DATES}", "cast_date")(lambda spark, d: _dates(spark, d).select("o_orderkey", casts.cast(F.col("s"), _STRING, "date").alias("v")))
query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('minute', ts) END AS v FROM events", "cast_datetime")(
    lambda spark, d: t(spark, d, "events").select("event_id", casts.cast(F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+09:00'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:'60'")), _STRING, "datetime").alias("v"))
)
query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 4 THEN false END AS v FROM events", "cast_bool")(
    lambda spark, d: t(spark, d, "events").select("event_id", casts.cast(F.element_at(F.array(*map(F.lit, (" Yes", "f", "1", "maybe", "NO ", "2"))), (F.col("event_id") % 6 + 1).cast("int")), _STRING, "bool").alias("v"))
)
query("SELECT p_partkey, CAST(p_retailprice * 1000 AS BIGINT) AS v, CAST(CAST(p_retailprice * 1000 AS BIGINT) + 0.5 AS DOUBLE) AS w FROM part", "cast_comma")(
    lambda spark, d: t(spark, d, "part").select("p_partkey", casts.cast(F.concat(F.lit(" "), F.format_number((F.col("p_retailprice") * 1000).cast("decimal(20,0)").cast("bigint"), 0)), _STRING, "int_comma").alias("v"), casts.cast(F.concat(F.format_number((F.col("p_retailprice") * 1000).cast("decimal(20,0)").cast("bigint"), 0), F.lit(".5")), _STRING, "float_comma").alias("w"))
)
query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m') END AS v FROM orders", "cast_year_month")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", casts.cast(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy-13")), _STRING, "year_month").alias("v"))
)
query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '1e+' || (16 + event_id % 20) WHEN event_id % 4 = 1 THEN '1e-' || (7 + event_id % 20) WHEN event_id % 4 = 2 THEN event_id || '.5' ELSE '-' || event_id || '.0' END AS v FROM events", "cast_text_floats")(
    lambda spark, d: t(spark, d, "events").select("event_id", casts.float_text(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("1e"), (16 + F.col("event_id") % 20).cast("string")).cast("double")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("1e-"), (7 + F.col("event_id") % 20).cast("string")).cast("double")).when(F.col("event_id") % 4 == 2, F.col("event_id") + 0.5).otherwise(-F.col("event_id").cast("double"))).alias("v"))
)
query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS v, CAST(ts AS DATE)::VARCHAR AS w FROM events", "cast_text_times")(lambda spark, d: t(spark, d, "events").select("event_id", casts.cast(F.col("ts"), T.TimestampNTZType(), "str").alias("v"), casts.cast(F.to_date("ts"), T.DateType(), "str").alias("w")))
query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS a, CASE WHEN c_nationkey < 10 THEN '-0' || c_nationkey ELSE '-' || c_nationkey END AS b, c_name AS c FROM customer", "zfill_key")(lambda spark, d: t(spark, d, "customer").select("c_custkey", casts.zfill(F.col("c_custkey").cast("string"), 8).alias("a"), casts.zfill(F.concat(F.lit("-"), F.col("c_nationkey").cast("string")), 3).alias("b"), casts.zfill(F.col("c_name"), 3).alias("c")))
query("SELECT c_custkey, c_name AS s FROM customer", "strip_text")(lambda spark, d: t(spark, d, "customer").select("c_custkey", casts.strip(F.concat(F.lit("　\t "), F.col("c_name"), F.lit(" \n"))).alias("s")))
query("SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS v FROM events", "null_tokens")(lambda spark, d: t(spark, d, "events").select("event_id", derive.null_tokens(F.col("event_type"), ["error", "view"]).alias("v")))
query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS v, c_custkey % 6 = 0 AS clash FROM customer", "coalesce_alias")(
    lambda spark, d: t(spark, d, "customer").select("c_custkey", F.coalesce(a := F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), b := F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))).alias("v"), derive.conflict([a, b]).alias("clash"))
)
query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 AND NOT (month(o_orderdate) IN (1,3,5,7,8,10,12)) THEN NULL WHEN o_orderkey % 5 = 1 THEN make_date(year(o_orderdate), month(o_orderdate), 31) ELSE CAST(o_orderdate AS DATE) END AS v FROM orders", "date_parts")(
    lambda spark, d: t(spark, d, "orders").select("o_orderkey", derive.date_parts(F.year("o_orderdate"), F.when(F.col("o_orderkey") % 5 != 0, F.month("o_orderdate")), F.when(F.col("o_orderkey") % 5 == 1, F.lit("31")).otherwise(F.dayofmonth("o_orderdate").cast("string"))).alias("v"))
)
query(r"SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name || '\|' || c_mktsegment || '|' || 'a\\b' END AS v FROM customer", "join_key")(
    lambda spark, d: t(spark, d, "customer").select("c_custkey", derive.join_key([F.concat("c_name", F.lit("|"), "c_mktsegment"), F.when(F.col("c_custkey") % 4 > 0, F.lit("a\\b"))]).alias("v"))
)
query("SELECT doc_id, CASE WHEN left(v, 1) IN ('=', '+', '-', '@') THEN '''' || v ELSE v END AS v FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '@' WHEN 2 THEN '-' ELSE '' END || lang AS v FROM documents)", "csv_formula_guard")(
    lambda spark, d: t(spark, d, "documents").select("doc_id", derive.csv_guard(F.concat(F.element_at(F.array(*map(F.lit, ("=", "@", "-", ""))), (F.col("doc_id") % 4 + 1).cast("int")), F.col("lang"))).alias("v"))
)
query("SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS at, lower(hex(event_type)) AS raw, event_type = 'click' AS b FROM events", "wire_encode")(
    lambda spark, d: t(spark, d, "events").select("event_id", wire.encode(F.col("ts"), T.TimestampNTZType()).alias("at"), wire.encode(F.encode("event_type", "UTF-8"), T.BinaryType()).alias("raw"), (F.col("event_type") == "click").alias("b"))
)
query("SELECT * FROM (VALUES ('big', 'decimal_string'), ('small', 'number'), ('d', 'decimal_string'), ('v', 'number'), ('e', 'string')) x(\"column\", wire)", "wire_types")(
    lambda spark, d: spark.createDataFrame(list(wire.wire_types(t(spark, d, "events").select((F.col("event_id") + F.lit(2**53)).alias("big"), F.col("event_id").alias("small"), F.col("value").cast("decimal(18,2)").alias("d"), F.col("value").alias("v"), F.col("event_type").alias("e"))).items()), "column string, wire string")
)
query("SELECT event_id, md5('3:' || event_id) AS h, sha256(event_type) AS s FROM events", "hash_functions")(lambda spark, d: t(spark, d, "events").select("event_id", F.md5(F.concat_ws(":", F.lit("3"), F.col("event_id").cast("string"))).alias("h"), F.sha2("event_type", 256).alias("s")))
query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS b, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t FROM events""", "key_text")(lambda spark, d: t(spark, d, "events").select("event_id", wire.key_text(F.col("event_id") % 2 == 0, T.BooleanType()).alias("b"), wire.key_text(F.col("ts"), T.TimestampNTZType()).alias("t")))
query("SELECT '{\"a\":' || r_regionkey || ',\"b\":\"' || r_name || '\",\"c\":null}' AS line FROM region", "canonical_lines")(lambda spark, d: wire.canonical_lines(t(spark, d, "region").select(F.lit(None).cast("int").alias("c"), F.col("r_name").alias("b"), F.col("r_regionkey").alias("a"))))


# -- H15, H16: personal data

query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN '[masked]' END AS c_name, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer", "mask_pii")(
    lambda spark, d: pii.mask(t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("c_name"), "c_acctbal", "c_mktsegment"), ["c_name", "c_acctbal"])
)
# Java's word characters, for an engine whose own are ASCII alone; a text holds an address if a word stands before its @ and behind a dot of its host.
_W = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}"
_EDGE = (f"(?:^|[^{_W}])", f"(?:$|[^{_W}])")
_NUMBERS = "list_transform(range(1, 13), lambda i: TRY_CAST(substr(w, i, 1) AS INT) * [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5][i])"
_PII_SQL = rf"""WITH d AS (SELECT text || CASE doc_id % 5 WHEN 0 THEN ' 900101-1234567 ' WHEN 1 THEN ' 9001011234' || doc_id % 1000 + 100 || ' ' WHEN 2 THEN ' 0201313' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || ' ' ELSE '' END AS text FROM documents),
hits AS (SELECT CASE WHEN regexp_matches(text, '{_EDGE[0]}\p{{Nd}}{{6}}-[1-4]\p{{Nd}}{{6}}{_EDGE[1]}') OR len(list_filter(regexp_extract_all(text, '[{_W}]+'), lambda w: regexp_full_match(w, '[0-9]{{6}}[1-4][0-9]{{6}}')
  AND TRY_CAST(substr(w, 3, 2) AS INT) BETWEEN 1 AND 12 AND TRY_CAST(substr(w, 5, 2) AS INT) BETWEEN 1 AND CASE WHEN substr(w, 3, 2) = '02' THEN 29 WHEN substr(w, 3, 2) IN ('04', '06', '09', '11') THEN 30 ELSE 31 END
  AND (substr(w, 7, 1) IN ('3', '4') OR TRY_CAST(substr(w, 13, 1) AS INT) = (11 - list_sum({_NUMBERS}) % 11) % 10))) > 0 THEN 1 END AS rrn,
CASE WHEN regexp_matches(text, '{_EDGE[0]}01[016789][- ]?\p{{Nd}}{{3,4}}[- ]?\p{{Nd}}{{4}}{_EDGE[1]}') THEN 1 END AS phone,
CASE WHEN regexp_matches(text, '[{_W}][.+-]*@[{_W}-]+\.[.-]*[{_W}]') THEN 1 END AS email,
CASE WHEN regexp_matches(text, '{_EDGE[0]}\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{5}}{_EDGE[1]}') THEN 1 END AS business_no FROM d)
SELECT 'text' AS "column", kind, count FROM (SELECT 'rrn' AS kind, count(rrn) AS count FROM hits UNION ALL SELECT 'phone', count(phone) FROM hits UNION ALL SELECT 'email', count(email) FROM hits UNION ALL SELECT 'business_no', count(business_no) FROM hits) WHERE count > 0"""


@query(_PII_SQL)
def pii_scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """All five patterns over whole texts, to which numbers with and without a sound check digit are added."""
    i, number = F.col("doc_id"), lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    more = F.when(i % 5 == 0, F.lit(" 900101-1234567 ")).when(i % 5 == 1, number(F.concat(F.lit("9001011234"), (i % 1000 + 100).cast("string")))).when(i % 5 == 2, number(F.concat(F.lit("0201313"), F.lpad((i % 1000000).cast("string"), 6, "0"))))
    return pii.scan_values(t(spark, d, "documents").select(F.concat("text", F.coalesce(more, F.lit(""))).alias("text")))


query("SELECT event_id, event_id % 4 IN (0, 3) AS found FROM events", "pii_check_digit")(
    lambda spark, d: t(spark, d, "events").select("event_id", pii.holds(F.element_at(F.array(*map(F.lit, ("a 900101-1234567", "1234567890123", "9013011234567", "0001013123456"))), (F.col("event_id") % 4 + 1).cast("int")), "rrn").alias("found"))
)

# -- I: quality, drift, provenance


def _quality(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    found = quality.evaluate(e, [quality.Rule("range", "v", low=5, high=80), quality.Rule("compare", "event_id", "user_id", op="ge"), quality.Rule("max_null_ratio", "v", limit=0.2), quality.Rule("min_rows", limit=10), quality.Rule("required_column", "nothing", severity="warn"), quality.Rule("max_null_ratio", "nothing", limit=0)])
    return spark.createDataFrame([(i, r.rule.kind, r.status, r.affected, r.evaluated) for i, r in enumerate(found)], "i int, kind string, status string, affected long, evaluated long")


query("""WITH e AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)
SELECT 0 AS i, 'range' AS kind, CASE WHEN affected > 0 THEN 'fail' ELSE 'pass' END AS status, affected, evaluated FROM (SELECT count(*) FILTER (v < 5 OR v > 80) AS affected, count(v) AS evaluated FROM e)
UNION ALL SELECT 1, 'compare', CASE WHEN affected > 0 THEN 'fail' ELSE 'pass' END, affected, evaluated FROM (SELECT count(*) FILTER (event_id < user_id) AS affected, count(*) AS evaluated FROM e)
UNION ALL SELECT 2, 'max_null_ratio', CASE WHEN affected / evaluated::DOUBLE > 0.2 THEN 'fail' ELSE 'pass' END, affected, evaluated FROM (SELECT count(*) FILTER (v IS NULL) AS affected, count(*) AS evaluated FROM e)
UNION ALL SELECT 3, 'min_rows', 'pass', NULL, NULL UNION ALL SELECT 4, 'required_column', 'warn', NULL, NULL UNION ALL SELECT 5, 'max_null_ratio', 'not_evaluated', NULL, NULL""", "quality_rules")(_quality)
query("SELECT * FROM (VALUES ('s', 3), ('n', 2)) x(\"column\", lost)", "cast_losses")(lambda spark, d: spark.createDataFrame(list(casts.losses(spark.createDataFrame([("1", "1.5"), (" 2", "x"), ("3.0", "y"), ("", "2"), (None, None)], "s string, n string"), {"s": "int", "n": "float"}).items()), "column string, lost long"))


def _drift(spark: SparkSession, d: str) -> DataFrame:
    before = t(spark, d, "events")
    after = before.drop("props").withColumns({"w": F.lit(1), "user_id": F.col("user_id").cast("string")}).where("event_id % 3 = 0")
    found = quality.drift(before.schema, before.count(), after.schema, after.count())
    return spark.createDataFrame([(kind, column) for kind, column, _ in found], "kind string, column string")


query("SELECT kind, \"column\" FROM (VALUES ('column_added', 'w'), ('column_removed', 'props'), ('dtype_changed', 'user_id'), ('row_count_jump', NULL)) x(kind, \"column\")", "drift")(_drift)
query("SELECT event_type AS source, CASE WHEN event_type = 'view' THEN 'unknown' WHEN event_type = 'click' THEN 'partial' ELSE 'complete' END AS coverage FROM events GROUP BY 1", "coverage")(
    lambda spark, d: provenance.coverage_of(t(spark, d, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_type") != "view", F.lit(10)).alias("reported"), F.when(F.col("event_type") == "click", 9).otherwise(10).alias("fetched")))
)


def _checksums(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "nation")
    return spark.createDataFrame([(provenance.multiset_checksum(e), provenance.multiset_checksum(e.orderBy(F.rand(3)).repartition(5)), provenance.ordered_checksum(provenance.record_lines(e)))], "multiset string, reordered string, ordered string")


query(None, "multiset_checksum")(_checksums)

# -- N, G, E, D19, H26: user SQL over one relation called dataset


def _sql(table: str, statement: str) -> Query:
    return lambda spark, d: validator.run(t(spark, d, table), statement)


def _both(name: str, table: str, statement: str, oracle: str | None = None) -> None:
    """Registers a statement over dataset, and the same over the table for DuckDB where the dialects agree."""
    query((oracle or statement).replace("dataset", table), name)(_sql(table, statement))


_both("sql_projection", "orders", "SELECT o_orderkey AS k, CASE WHEN o_totalprice > 1000 THEN 'high' ELSE 'low' END AS band, o_orderstatus || '-' || o_orderpriority AS tag FROM dataset WHERE o_orderkey % 2 = 0")
_both("sql_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM dataset")
_both("sql_cte", "orders", "WITH a AS (SELECT o_custkey AS c, count(*) AS n FROM dataset GROUP BY o_custkey) SELECT n, count(*) AS customers FROM a GROUP BY n")
_both("sql_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM dataset GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_both("sql_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS q FROM dataset GROUP BY CUBE (l_returnflag, l_linestatus)")
_both("sql_grouping_sets", "lineitem", "SELECT l_returnflag, l_shipdate > TIMESTAMP '1995-06-01 00:00:00' AS late, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM dataset GROUP BY GROUPING SETS ((l_returnflag), (l_shipdate > TIMESTAMP '1995-06-01 00:00:00'), ())")
_both("sql_having_filter", "lineitem", "SELECT l_suppkey, count(*) FILTER (WHERE l_discount > 0.05) AS cheap, count(DISTINCT l_partkey) AS parts FROM dataset GROUP BY l_suppkey HAVING count(*) > 10")
_both("sql_window_rank", "orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS d, ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS q FROM dataset")
_both("sql_window_frames", "orders", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS after, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS three, first_value(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS head, max(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS near FROM dataset")
_both("sql_qualify_rewritten", "orders", "SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM dataset) WHERE r = 1")
_both("sql_union_distinct", "customer", "SELECT c_nationkey AS k FROM dataset WHERE c_custkey % 2 = 0 UNION SELECT c_nationkey FROM dataset WHERE c_custkey % 2 = 1")
_both("sql_union_all", "customer", "SELECT c_nationkey AS k FROM dataset WHERE c_custkey % 7 = 0 UNION ALL SELECT c_nationkey FROM dataset WHERE c_custkey % 5 = 0")
_both("sql_intersect", "customer", "SELECT c_nationkey AS k, c_mktsegment AS s FROM dataset WHERE c_custkey % 7 = 0 INTERSECT SELECT c_nationkey, c_mktsegment FROM dataset WHERE c_custkey % 5 = 0")
_both("sql_except", "customer", "SELECT c_nationkey AS k, c_mktsegment AS s FROM dataset EXCEPT SELECT c_nationkey, c_mktsegment FROM dataset WHERE c_custkey % 5 = 0")
_both("sql_self_join", "nation", "SELECT a.n_name AS x, b.n_name AS y FROM dataset a JOIN dataset b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_both("sql_semi_anti", "customer", "SELECT c_custkey FROM dataset c WHERE EXISTS (SELECT 1 FROM dataset o WHERE o.c_nationkey = c.c_nationkey AND o.c_acctbal > c.c_acctbal + 9000) AND NOT EXISTS (SELECT 1 FROM dataset p WHERE p.c_custkey = c.c_custkey + 1 AND p.c_mktsegment = c.c_mktsegment)")
_both("sql_scalar_subquery", "customer", "SELECT c_custkey FROM dataset WHERE c_acctbal > (SELECT avg(c_acctbal) FROM dataset) AND c_nationkey IN (SELECT c_nationkey FROM dataset WHERE c_acctbal > 9900)")
_both("sql_outer_join", "nation", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT * FROM dataset WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM dataset WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
_both("sql_theta_cross_join", "region", "SELECT a.r_name AS x, b.r_name AS y FROM dataset a CROSS JOIN dataset b WHERE a.r_regionkey <= b.r_regionkey")
_both("sql_asof_by_window", "events", "SELECT event_id, user_id, max(CASE WHEN event_type = 'click' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM dataset")
_both("sql_strings", "part", "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, replace(p_name, 'a', '#') AS r, CAST(length(p_name) AS BIGINT) AS n, reverse(p_brand) AS v, split_part(p_name, ' ', 1) AS w, p_name ILIKE '%A%' AS i, CAST(levenshtein(p_name, p_type) AS BIGINT) AS l FROM dataset")
_both("sql_regex", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS all_vowels, regexp_extract(p_type, '([A-Z]+)$', 1) AS tail, p_name RLIKE '^[a-m]' AS early FROM dataset", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS all_vowels, regexp_extract(p_type, '([A-Z]+)$', 1) AS tail, regexp_matches(p_name, '^[a-m]') AS early FROM dataset")
_both("sql_dates", "orders", "SELECT o_orderkey, extract(quarter FROM o_orderdate) AS q, CAST(o_orderdate AS DATE) + 40 AS later, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, datediff(DATE '1999-01-01', CAST(o_orderdate AS DATE)) AS days, dayofweek(o_orderdate) - 1 AS dow, last_day(o_orderdate) AS last, date_format(o_orderdate, 'yyyy/MM') AS ym, add_months(CAST(o_orderdate AS DATE), 1) AS next FROM dataset",
      "SELECT o_orderkey, extract(quarter FROM o_orderdate) AS q, CAST(o_orderdate AS DATE) + 40 AS later, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS days, dayofweek(o_orderdate) AS dow, last_day(o_orderdate) AS last, strftime(o_orderdate, '%Y/%m') AS ym, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS next FROM dataset")
_both("sql_math", "part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, p_partkey % 7 AS m, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, abs(p_size - 25) AS d, greatest(p_size, 10) AS g, least(p_size, 10) AS l, round(ln(p_retailprice), 6) AS n, round(power(p_size, 2), 3) AS p, CAST(sign(p_size - 25) AS BIGINT) AS s FROM dataset")
_both("sql_nulls", "events", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS a, nullif(event_type, 'error') IS DISTINCT FROM 'view' AS b, CASE WHEN nullif(event_type, 'error') IS NULL THEN 1 ELSE 0 END AS c FROM dataset")
_both("sql_json", "events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM dataset", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM dataset")
_both("sql_arrays", "embeddings", "SELECT vec_id, size(embedding) AS n, size(filter(embedding, x -> x > 0)) AS positive, element_at(embedding, 1) AS first, array_contains(transform(slice(embedding, 1, 3), x -> x > 0), true) AS any_positive FROM dataset", "SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS positive, embedding[1] AS first, list_contains(list_transform(embedding[1:3], lambda x: x > 0), true) AS any_positive FROM dataset")
_both("sql_structs_maps", "nation", "SELECT n_nationkey, named_struct('a', n_regionkey, 'b', n_name).b AS b, map('x', n_nationkey)['x'] AS x FROM dataset", "SELECT n_nationkey, {'a': n_regionkey, 'b': n_name}.b AS b, map(['x'], [n_nationkey])['x'] AS x FROM dataset")
_both("sql_more_aggregates", "events", "SELECT event_type, max_by(event_id, value) AS at_max, bool_or(value > 90) AS any_high, round(stddev(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c, round(median(value), 6) AS med, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY value), 6) AS q1 FROM dataset GROUP BY event_type", "SELECT event_type, arg_max(event_id, value) AS at_max, bool_or(value > 90) AS any_high, round(stddev(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c, round(median(value), 6) AS med, round(quantile_cont(value, 0.25), 6) AS q1 FROM dataset GROUP BY event_type")
_both("sql_listagg", "nation", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM dataset GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM dataset GROUP BY n_regionkey")
_both("sql_order_nulls_last", "events", "SELECT event_id, e, row_number() OVER (PARTITION BY user_id ORDER BY e, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY e DESC, event_id) AS down FROM (SELECT *, nullif(event_type, 'error') AS e FROM dataset)",
      "SELECT event_id, e, row_number() OVER (PARTITION BY user_id ORDER BY e NULLS LAST, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY e DESC NULLS LAST, event_id) AS down FROM (SELECT *, nullif(event_type, 'error') AS e FROM dataset)")


# -- H26, E5, G2: the same text on both engines, in DuckDB's dialect


def _duck(name: str, table: str, statement: str) -> None:
    query(statement.replace("dataset", table), name)(lambda spark, d: validator.run(t(spark, d, table), statement, dialect="duckdb"))


_duck("duck_qualify", "orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM dataset QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_duck("duck_qualify_groups", "orders", "SELECT o_custkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM dataset GROUP BY o_custkey QUALIFY r <= 100 ORDER BY sum(o_totalprice)")
_duck("duck_union_by_name", "customer", "WITH a AS (SELECT c_custkey AS k, c_name AS n FROM dataset) SELECT * FROM a UNION ALL BY NAME SELECT c_mktsegment AS s, c_nationkey AS k FROM dataset")
_duck("duck_exclude", "customer", "SELECT * EXCLUDE (c_name, c_acctbal) FROM dataset")
_duck("duck_unnamed", "part", "SELECT count(*), sum(p_size), max(p_name), min(p_retailprice) FROM dataset")
_duck("duck_strings", "part", """SELECT p_partkey, concat(p_name, NULL, '!', p_size) AS c, len(p_name) AS n, strlen(p_name) AS b, p_name[2:4] AS s, starts_with(p_name, 'a') AS st, strpos(p_name, 'e') AS e, len(string_split(p_name, ' ')) AS w, string_split(p_name, ' ')[-1] AS w2,
lpad(p_brand, 12, '*') AS l, position('e' IN p_name) AS pos, ltrim(p_name, 'abc') AS lt, 'it''s \\d' AS q, levenshtein(p_name, p_type) AS lv, sha256(p_name) AS sh, "p_type" AS "Type" FROM dataset""")
_duck("duck_regex", "part", r"""SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS one, regexp_replace(p_name, '([aeiou])(.)', '\2\1', 'g') AS every, regexp_replace(p_name, '([aeiou])(.)', '<\2$\1>') AS turned, regexp_matches(p_name, '^[a-m]') AS m, regexp_full_match(p_name, '[a-z ]+') AS f,
regexp_extract(p_type, '[A-Z]+$') AS x, regexp_extract(p_type, '(\w+) (\w+)', 2) AS g, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_matches(p_type, 'STANDARD|promo', 'i') AS i FROM dataset""")
_duck("duck_dates", "orders", """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m at %H:%M') AS s, date_diff('month', o_orderdate, TIMESTAMP '1999-01-15 00:00:00') AS mo, date_diff('week', o_orderdate, TIMESTAMP '1999-01-15 00:00:00') AS wk, datediff('day', o_orderdate::DATE, DATE '1999-01-15') AS dd, dayofweek(o_orderdate) AS dw, isodow(o_orderdate) AS iso,
date_trunc('month', o_orderdate)::VARCHAR AS mt, (o_orderdate::DATE + INTERVAL 1 MONTH)::VARCHAR AS nx, o_orderdate::DATE + 40 AS later, extract(dow FROM o_orderdate) AS ed, dayname(o_orderdate) AS dn, monthname(o_orderdate) AS mn, epoch(o_orderdate) AS ep FROM dataset""")
_duck("duck_math", "part", "SELECT p_partkey, p_size / 4 AS d0, p_size / (p_partkey % 3 + 1) AS d1, p_size // 7 AS d2, p_size % 7 AS m, p_size ** 2 AS sq, (p_retailprice + 0.5)::INT AS i, round(log(p_retailprice), 6) AS lg, round(ln(p_retailprice), 6) AS l1, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, trunc(p_retailprice) AS t FROM dataset")
_duck("duck_lists", "embeddings", """SELECT vec_id, len(embedding) AS n, embedding[-1] AS z, embedding[0] AS nothing, len(embedding[2:4]) AS s, len(list_filter(embedding, lambda x: x > 0)) AS pos, list_contains([1, 2, vec_id], 7) AS c, array_to_string(list_sort([3, vec_id]), '-') AS so, list_position(['a', 'b'], 'c') AS lp, list_unique([1, 1, vec_id]) AS lu,
list_reduce([1, 2, vec_id], lambda x, y: x + y) AS lr, array_to_string(list_transform(embedding[1:3], lambda x: x > 0), ',') AS t FROM dataset""")
_duck("duck_json", "events", "SELECT event_id, json_extract_string(props, '$.k') AS k, props->>'$.k' AS k2, json_extract(props, '$.k')::VARCHAR AS k3, json_extract_string(props, 'k')::BIGINT + 1 AS k4, json_valid(props) AS v FROM dataset")
_duck("duck_structs_maps", "nation", "SELECT n_nationkey, {'a': n_regionkey, 'b': n_name}.b AS b, struct_pack(x := n_name).x AS sx, MAP {'x': n_nationkey}['x'] AS x, map(['p', 'q'], [1, n_nationkey])['q'] AS mq FROM dataset")
_duck("duck_aggregates", "events", """SELECT event_type, arg_max(event_id, value) AS am, arg_min(event_id, value) AS an, round(quantile_cont(value, 0.25), 6) AS q, quantile_disc(value, 0.5) AS qd, count(DISTINCT user_id) AS u, string_agg(DISTINCT event_type, ';') AS sa, array_to_string(list(event_id ORDER BY value DESC, event_id DESC)[1:3], ',') AS top,
sum(user_id)::BIGINT AS su, count_if(value > 50)::BIGINT AS ci, count(*) FILTER (value > 50) AS fl FROM dataset GROUP BY ALL""")


@query("SELECT c_custkey AS k, c_name AS n, NULL AS s FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    b = t(spark, d, "supplier").select(F.col("s_name").alias("s"), F.col("s_suppkey").alias("k"))
    return a.unionByName(b, allowMissingColumns=True)


# -- A: sources and sinks, by round trips


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster keeps what all its machines share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type, value, CAST(nullif(event_id % 3, 0) AS BIGINT) AS k, event_id - 1 + 1 - (SELECT min(event_id) FROM events) AS _row_seq FROM events")
def infer_roundtrip_json(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.nullif(F.col("event_id") % 3, F.lit(0)).alias("k"))
    lines = e.select((F.col("event_id") - e.agg(F.min("event_id")).first()[0]).alias("seq"), F.to_json(F.struct("*")).alias("value"))
    return infer.load(lines)


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey % 2 = 0 AS even, n_nationkey / 4 AS share, row_number() OVER (ORDER BY n_nationkey) - 1 AS _row_seq FROM nation")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "nation").withColumns({"even": F.col("n_nationkey") % 2 == 0, "share": F.col("n_nationkey") / 4})
    return readers.read_csv(spark, str(sinks.write_csv(n.orderBy("n_nationkey"), f"{_folder(spark, 'csv')}/nation.csv", guard=False)))


@query("SELECT doc_id, replace(text, chr(13), ' ') AS text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS _row_seq FROM documents")
def csv_quoted_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with quotes and line breaks, written and read again."""
    docs = t(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit(" ")).alias("text"), "lang")
    return readers.read_csv(spark, str(sinks.write_csv_parts(docs.orderBy("doc_id"), f"{_folder(spark, 'csv')}/documents", guard=False)), {"text": "str"})


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1 AS _row_seq FROM orders")
def csv_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of three files, each with a header."""
    at, o = _folder(spark, "csvs"), t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    for i in range(3):
        sinks.write_csv(o.where(F.col("o_orderkey") % 3 == i).orderBy("o_orderkey"), f"{at}/part-{i}.csv", guard=False)
    return readers.read_csv(spark, at)


@query("SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS _row_seq FROM events")
def json_array_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """One array of all events as objects, in one file, read by many tasks."""
    at, one = _folder(spark, "json"), F.to_json(F.struct("event_id", "event_type", "value"))
    lines = t(spark, d, "events").select("event_id", one.alias("value")).orderBy("event_id").coalesce(1)
    n = lines.count()
    ends = lines.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "[").otherwise(""), "value", F.when(F.monotonically_increasing_id() == n - 1, "]").otherwise(",")).alias("value"))
    ends.write.text(at)
    return readers.read_json(spark, at)


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN (value / 8)::VARCHAR WHEN 2 THEN (-value)::VARCHAR WHEN 3 THEN '-inf' WHEN 4 THEN (event_id / 4::DOUBLE)::VARCHAR ELSE NULL END AS s FROM events""")
def float_texts(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    x = F.when(i % 6 == 0, float("nan")).when(i % 6 == 1, v / 8).when(i % 6 == 2, -v).when(i % 6 == 3, float("-inf")).when(i % 6 == 4, i / 4.0)
    return t(spark, d, "events").select("event_id", casts.float_text(x).alias("s"))


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS _row_seq FROM customer")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"), "c_acctbal")
    return readers.read_jsonl(spark, str(sinks.write_jsonl(c.orderBy("c_custkey"), f"{_folder(spark, 'jsonl')}/customer.jsonl")))


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row_seq FROM orders")
def parquet_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return readers.read_parquet(spark, str(sinks.write_parquet(o.orderBy("o_orderkey"), f"{_folder(spark, 'parquet')}/orders.parquet")))


@query("SELECT x, a, b FROM (VALUES (0)) p(x), (VALUES ('p'), ('q')) a(a), (VALUES (1), (2), (3)) b(b)")
def param_grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c["x"], c["a"], c["b"]) for c in readers.param_grid({"x": 0}, {"b": [1, 2, 3], "a": ["p", "q"]})], "x int, a string, b int")


@query("SELECT c_custkey, lpad(c_nationkey::VARCHAR, 3, '0') AS code, nullif(c_mktsegment, 'BUILDING') AS segment, lpad(c_nationkey::VARCHAR, 3, '0') || '|' || c_name AS key FROM customer")
def silver_contract(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("string").alias("code"), F.col("c_mktsegment").alias("seg"))
    contract = spec.Contract(null_tokens=("BUILDING",), rename={"seg": "segment"}, zfill={"code": 3}, casts={"c_custkey": "int"}, join_keys={"key": ("code", "c_name")})
    return build.normalize(c, contract).drop("c_name")


# -- K, L, A22-A27, F2, F5, H27, H28, I5, I6, I9, O: stored tables, streams, layouts, pages and builds, over whole tables


def _warehouse(spark: SparkSession) -> warehouse.Warehouse:
    """A new one beside what the cluster shares; its catalogue is a file, so that the folder has to be a mounted one."""
    at = _folder(spark, "warehouse")
    if "://" in at and not at.startswith("file://"):
        raise ValueError(f"a warehouse needs a mounted folder, not {at}")
    return warehouse.Warehouse(spark, at.removeprefix("file://"))


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def warehouse_current(spark: SparkSession, d: str) -> DataFrame:
    """The second snapshot is the current one; an empty third leaves the table as it is."""
    w, o = _warehouse(spark), t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    w.materialize(o.where("o_custkey % 2 = 0"), "orders")
    w.materialize(o, "orders", expected_revision=1)
    w.materialize(o.limit(0), "orders")
    return w.read("orders")


@query("SELECT 1 AS version, c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 2, c_custkey, c_mktsegment FROM customer")
def warehouse_time_travel(spark: SparkSession, d: str) -> DataFrame:
    w, c = _warehouse(spark), t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first, second = w.materialize(c.where("c_mktsegment <> 'BUILDING'"), "customer"), w.materialize(c, "customer")
    return w.read("customer", first.snapshot_id).select(F.lit(1).alias("version"), "*").unionByName(w.read("customer", second.snapshot_id).select(F.lit(2).alias("version"), "*"))


@query("SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS high FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag")
def warehouse_analysis(spark: SparkSession, d: str) -> DataFrame:
    """A kept statement answers from the snapshot that it was asked of, after others have followed and been collected."""
    w, lines = _warehouse(spark), t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    w.materialize(lines.where("l_linestatus = 'F'"), "lineitem")
    kept = w.save_analysis("by flag", "SELECT l_returnflag, count(*) AS n, max(l_extendedprice) AS high FROM dataset GROUP BY l_returnflag", "lineitem")
    w.materialize(lines, "lineitem")
    w.collect(keep=1)
    return w.run_analysis(kept)


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def warehouse_backup(spark: SparkSession, d: str) -> DataFrame:
    w = _warehouse(spark)
    w.materialize(t(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "part")
    copy = w.backup(w.root.with_name(f"{w.root.name}-copy"))
    return warehouse.restore(spark, copy, w.root.with_name(f"{w.root.name}-back")).read("part")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark: SparkSession, d: str) -> DataFrame:
    """One run over all that has arrived; the counts of a later batch replace those of an earlier."""
    at = _folder(spark, "stream")
    stream = ingest.read_stream(spark, f"{d}/event[s].parquet", t(spark, d, "events").schema)
    counted = ingest.hourly_counts(stream, "ts", "event_type")
    done = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/counts")).start()
    done.awaitTermination()
    return spark.read.parquet(f"{at}/counts").select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT event_id, event_type, value::VARCHAR::DOUBLE AS value FROM events")
def stream_appends(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a stream, cast on the way into a folder of batches."""
    at = _folder(spark, "stream")
    stream = ingest.read_stream(spark, f"{d}/event[s].parquet", t(spark, d, "events").schema)
    texts = stream.select("event_id", "event_type", F.col("value").cast("string").alias("value"))
    ingest.append_batches(texts, f"{at}/rows", f"{at}/state", {"value": "float"}).awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("event_id", "event_type", "value")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def hub_layout(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "hub")
    sinks.write_hub_layout(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), at, "Suppliers")
    return readers.read_table(spark, f"{at}/data")


@query("SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_suppkey) - 1 AS _row_seq FROM supplier")
def competition_layout(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark, "competition")
    sinks.write_competition_layout(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").orderBy("s_suppkey"), at, "Suppliers", "CC0-1.0")
    return readers.read_csv(spark, f"{at}/data.csv")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE false")
def empty_like(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(str(sinks.empty_like(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), f"{_folder(spark, 'empty')}/orders.parquet")))


@query("SELECT count(*)::BIGINT AS rows, count_if(left(s, 1) IN ('=', '+', '-', '@'))::BIGINT AS altered FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN '=' WHEN 1 THEN '@' ELSE '' END || c_name AS s FROM customer)")
def export_result(spark: SparkSession, d: str) -> DataFrame:
    marked = t(spark, d, "customer").select("c_custkey", F.concat(F.element_at(F.array(F.lit("="), F.lit("@"), F.lit("")), (F.col("c_custkey") % 3 + 1).cast("int")), "c_name").alias("s"))
    done = sinks.export_result(marked, f"{_folder(spark, 'export')}/customer.csv", profile="spreadsheet", max_rows=2**31 - 2, max_bytes=1 << 62)
    return spark.createDataFrame([(done["rows"], done["altered_cells"])], "rows long, altered long")


@query("SELECT least(count(*), 500)::BIGINT AS rows, count(*)::BIGINT AS total, count(*) > 500 AS more, least(count(*) FILTER (o_totalprice > 1000), 500)::BIGINT AS filtered, count(*) FILTER (o_totalprice > 1000) > 500 AS more_filtered FROM orders")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """The largest page (its rows are a page's, the count is the table's), and one behind a filter, which is not counted."""
    o = t(spark, d, "orders")
    found, total, more = rows.read_page(o, rows.RowsPlan(columns=("o_orderkey",), limit=500), "o_orderkey")
    some, none, more_some = rows.read_page(o, rows.RowsPlan(columns=("o_orderkey",), filters=rows.parse_filters([{"column": "o_totalprice", "op": "gt", "value": 1000}]), limit=500), "o_orderkey")
    if none is not None:
        raise ValueError("a page of filtered rows is not counted unless asked")
    return spark.createDataFrame([(len(found), total, more, len(some), more_some)], "rows long, total long, more boolean, filtered long, more_filtered boolean")


@query("SELECT o_orderkey, 'order ' || o_orderkey || ': ' || nullif(trim(v), '-') AS label, nullif(trim(v), '-') AS v FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN ' - ' ELSE ' ' || o_orderstatus END AS v FROM orders) WHERE o_totalprice >= 1000.5 AND o_orderstatus <> 'P'")
def legacy_forms(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    for text in ("o_totalprice >= 1000.5", "o_orderstatus != 'P'"):
        o = o.where(legacy.condition(o, text))
    v = legacy.nullify(F.when(F.col("o_orderkey") % 3 == 0, " - ").otherwise(F.concat(F.lit(" "), "o_orderstatus")))
    return o.select("o_orderkey", legacy.template("order {}: {}", [F.col("o_orderkey"), v]).alias("label"), v.alias("v"))


@query("SELECT c_custkey, upper(c_name) AS name, c_mktsegment FROM customer")
def legacy_variants(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return legacy.variants(c, {"en": {"romanize_columns": ["c_name"], "column_rename": {"c_name": "name"}}}, str.upper)["en"]


@query("SELECT 's' AS \"column\", count(*) FILTER (event_id % 3 = 1)::BIGINT AS lost FROM events UNION ALL SELECT 'n', count(*) FILTER (event_id % 5 = 0)::BIGINT FROM events")
def cast_losses_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    texts = t(spark, d, "events").select(F.when(i % 3 == 1, "1.5").when(i % 3 == 2, i.cast("string")).alias("s"), F.when(i % 5 == 0, "x").otherwise(F.col("value").cast("string")).alias("n"))
    return spark.createDataFrame(list(casts.losses(texts, {"s": "int", "n": "float"}).items()), "column string, lost long")


@query("""SELECT 'column_added' AS kind, 'w' AS "column" UNION ALL SELECT 'column_removed', 'props' UNION ALL SELECT 'dtype_changed', 'user_id'
UNION ALL SELECT 'row_count_jump', NULL FROM events HAVING abs(count(*) FILTER (event_type = 'click') - count(*)) / count(*) > 0.5""")
def drift_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whether the row count has jumped is told by both counts."""
    before = t(spark, d, "events")
    after = before.drop("props").withColumns({"w": F.lit(1), "user_id": F.col("user_id").cast("string")}).where("event_type = 'click'")
    return spark.createDataFrame([(kind, column) for kind, column, _ in quality.drift(before.schema, before.count(), after.schema, after.count())], "kind string, column string")


@query("""SELECT 'sha256:' || sha256('[' || string_agg(line, ',' ORDER BY line) || ']') AS checksum FROM (SELECT '{"c_custkey": ' || c_custkey || ', "c_mktsegment": "' || c_mktsegment || '"}' AS line FROM customer)""")
def ordered_checksum(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(provenance.ordered_checksum(provenance.record_lines(t(spark, d, "customer").select("c_mktsegment", "c_custkey"))),)], "checksum string")


@query("SELECT field, type FROM (VALUES ('event_id', 'integer'), ('value', 'number'), ('event_type', 'string'), ('props', 'object')) x(field, type) WHERE EXISTS (SELECT 1 FROM events) UNION ALL SELECT 'late', 'integer' FROM events HAVING count(*) FILTER (event_id % 7 = 3) > 0")
def json_structure(spark: SparkSession, d: str) -> DataFrame:
    """Types are those of a field's first value in all lines, here of one that six lines in seven lack."""
    line = F.to_json(F.struct("event_id", "value", "event_type", F.from_json("props", "map<string,string>").alias("props"), F.when(F.col("event_id") % 7 == 3, 1).alias("late")))
    return tagged.structure(t(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("value")))


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def build_gold(spark: SparkSession, d: str) -> DataFrame:
    """A whole build from two files of JSON lines: read, normalised, joined and laid out."""
    at = _folder(spark, "build")
    sinks.write_jsonl(t(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), f"{at}/orders.jsonl")
    sinks.write_jsonl(t(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_mktsegment").orderBy("c_custkey"), f"{at}/customer.jsonl")
    sources = (spec.Source("orders", path=f"{at}/orders.jsonl", format="jsonl"), spec.Source("customer", path=f"{at}/customer.jsonl", format="jsonl"))
    done = build.run_build(spark, spec.BuildSpec("joined", sources, composition=joins.JoinSpec((("o_custkey", "c_custkey"),), "left")))
    if done.status != "success":
        raise ValueError(str(done.manifest))
    return done.gold.select("o_orderkey", "o_custkey", "c_mktsegment")


ORACLE_SQL |= {f"{name}_whole": ORACLE_SQL[name] for name in ("join_nan_keys", "union_by_name")}
