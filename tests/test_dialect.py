"""Statements in DuckDB's dialect: refusals, and meanings that the tables of the registered queries do not show."""

import duckdb
import pytest

from brindle.plans import validator


@pytest.fixture(scope="module")
def tolls(spark):
    return spark.createDataFrame([(1, "north", 4.0, 0), (2, None, -2.5, 2), (3, "a'b", None, None), (4, "", 0.0, 0)], "gate long, lane string, fee double, cars int")


def duck(sql):
    c = duckdb.connect()
    c.execute("CREATE TABLE dataset AS SELECT * FROM (VALUES (1::BIGINT, 'north', 4.0::DOUBLE, 0), (2, NULL, -2.5, 2), (3, 'a''b', NULL, NULL), (4, '', 0.0, 0)) x(gate, lane, fee, cars)")
    found = c.execute(sql)
    return [d[0] for d in found.description], sorted(map(str, found.fetchall()))


SAME = [
    "SELECT gate, fee / cars AS per FROM dataset",
    "SELECT gate, concat(lane, fee IS NULL, NULL) AS c, 'a\\n''b' AS q FROM dataset",
    "SELECT gate, lane FROM dataset QUALIFY rank() OVER (ORDER BY fee DESC) < 3 ORDER BY gate DESC",
    "SELECT DISTINCT cars FROM dataset QUALIFY count(*) OVER (PARTITION BY cars) > 1",
    "SELECT count(*), max(gate) FROM dataset",
    "SELECT gate AS a, lane AS b FROM dataset UNION BY NAME SELECT lane AS b, cars AS c FROM dataset",
    "SELECT list(lane ORDER BY gate) AS l, list(gate ORDER BY fee DESC, gate DESC) AS g FROM dataset",
    "SELECT gate, CASE WHEN fee > 0 THEN CASE cars WHEN 0 THEN 'none' ELSE 'some' END END AS k FROM dataset",
    "SELECT gate, regexp_replace(lane, 'n(o)', '[\\1$]') AS r, regexp_full_match(lane, 'nor') AS m FROM dataset",
    "SELECT gate, [gate, 7][1] AS one, [gate][2] AS none, lane[1] AS c, lane[2:] AS rest FROM dataset",
    "SELECT a.gate FROM dataset a JOIN dataset b USING (gate) WHERE a.gate NOT IN (SELECT cars FROM dataset WHERE cars IS NOT NULL)",
    "SELECT arg_max(lane, gate) AS x, (sum(cars) FILTER (gate > 1))::INT AS s FROM dataset",
    "SELECT gate, 2 * gate / 4 AS h, gate // 2 AS w, -gate ** 2 AS p FROM dataset WHERE gate > 0 -- ; all\n;",
]


@pytest.mark.parametrize("sql", SAME)
def test_both_engines_agree(tolls, sql):
    found = validator.run(tolls, sql, dialect="duckdb")
    names, rows = duck(sql)
    assert found.columns == names and sorted(str(tuple(r)) for r in found.collect()) == rows


TIES = [
    "SELECT cars, arg_min(gate, round(fee / 100)) AS a, arg_max(gate, round(fee / 100)) AS b FROM dataset WHERE lane <> 'x' GROUP BY cars",
    "SELECT cars, list(gate ORDER BY fee DESC)[1:1] AS l, list(gate ORDER BY gate)[2:3] AS m, count(*) AS n FROM dataset d WHERE gate > 0 GROUP BY ALL",
    "SELECT d.cars AS c, len(list(lane ORDER BY gate DESC)[1:2]) AS l, (sum(gate) FILTER (gate > 1))::BIGINT AS n FROM dataset AS d GROUP BY d.cars HAVING count(*) > 0",
]


@pytest.mark.parametrize("sql", TIES)
def test_ties_and_the_first_of_sorted_lists(tolls, sql):
    found = validator.run(tolls, sql, dialect="duckdb")
    names, rows = duck(sql)
    assert found.columns == names and sorted(str(tuple(r)) for r in found.collect()) == rows


def test_ties_of_arg_min_go_to_the_least_argument_however_rows_lie(spark):
    for way in (1, -1):
        rows = spark.createDataFrame([(g, float(g % 2)) for g in range(100)][::way], "gate long, fee double").repartition(5)
        assert tuple(validator.run(rows, "SELECT arg_min(gate, fee) AS a, arg_max(gate, fee) AS b FROM dataset", dialect="duckdb").first()) == (0, 1)


def test_a_list_cut_short_holds_no_whole_group(tolls):
    plan = validator.run(tolls, "SELECT cars, list(gate ORDER BY fee DESC)[1:3] AS l FROM dataset GROUP BY cars", dialect="duckdb")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "<= 3" in plan


@pytest.mark.parametrize("sql", [
    "", "SELECT 1", "SELECT (gate FROM dataset", "SELECT gate FROM dataset; DROP TABLE dataset", "SELECT * FROM '/etc/passwd'", "SELECT * FROM read_parquet('x')", "SELECT current_setting('a') FROM dataset", "SELECT DISTINCT ON (gate) * FROM dataset",
    "SELECT gate FROM dataset UNION ALL BY NAME SELECT gate FROM other", "SELECT unnest([gate]) FROM other", "SELECT random() FROM dataset", "COPY dataset TO 'x'", "SELECT gate FROM dataset QUALIFY random() > 1", "SELECT strftime(gate, lane) FROM dataset",
    "SELECT CASE gate FROM dataset", "SELECT CAST(gate) FROM dataset", "SELECT arg_max(gate) FROM dataset", "SELECT gate / FROM dataset", "SELECT list(gate ORDER BY fee, gate DESC) FROM dataset", "SELECT [java_method('java.lang.System', 'exit')][1] FROM dataset", "SELECT len(java_method('java.lang.System', 'exit')) FROM dataset",
])
def test_all_else_is_refused(tolls, sql):
    with pytest.raises(validator.UnsafeQueryError):
        validator.run(tolls, sql, dialect="duckdb")


def test_masked_columns_stay_masked(tolls):
    assert {r[0] for r in validator.run(tolls, "SELECT lane || '!' AS x FROM dataset WHERE lane <> ''", ("lane",), "duckdb").collect()} == {"[masked]!"}
    with pytest.raises(ValueError):
        validator.run(tolls, "SELECT 1", dialect="other")


def test_exists_with_a_comparison_is_asked_of_the_extremes(spark):
    rows = [(i, i % 3, None if i % 11 == 0 else float("nan") if i % 37 == 0 else float(i * 7 % 40)) for i in range(120)] + [(999, None, 1.0)]
    df = spark.createDataFrame(rows, "i long, k long, x double")
    for mark in (">", ">=", "<", "<="):
        for negated in ("", "NOT "):
            for e in (f"o.x {mark} c.x + 30", f"c.x * 2 {mark} o.x"):
                sql = f"SELECT i FROM dataset c WHERE {negated}EXISTS (SELECT 1 FROM dataset o WHERE o.k = c.k AND {e})"
                df.createOrReplaceTempView("dataset")
                assert "GROUP BY" in validator.extremes(spark, sql)
                assert sorted(validator.run(df, sql).collect()) == sorted(spark.sql(sql).collect())
    for same in ("o.k = c.k AND o.i > k", "o.k = c.k AND o.x > c.x AND o.i < c.i", "o.x > c.x", "o.k = c.k", "o.k = c.k OR o.x > c.x"):
        sql = f"SELECT i FROM dataset c WHERE EXISTS (SELECT 1 FROM dataset o WHERE {same})"
        assert validator.extremes(spark, sql) == sql
