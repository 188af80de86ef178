import hashlib
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.functions import cadence, derive, pii
from brindle.operators import aggregate, joins, provenance, quality, rows, select, splits, summary
from brindle.operators.select import Filter
from brindle.plans import validator


@pytest.fixture
def people(spark):
    data = [("a", 10, "n"), ("a", 20, "n"), ("c", 5, "n"), ("a", 30, "n"), ("c", 1, "n"), ("b", 40, "n"), ("b", 50, "n"), ("b", None, "n")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "seq long, region string, people long, unit string")


def test_selection_follows_filters_then_columns(spark):
    df = spark.createDataFrame([("1", 5, 2021), ("2", None, 2019), ("3", -1, 2022)], "id string, amount long, year long")
    assert [tuple(r) for r in select.select(df, [Filter("amount", "gt", 0), Filter("year", "ge", 2020)], ["id"]).collect()] == [("1",)]
    assert select.select(df, [Filter("amount", "ne", 5)]).count() == 1
    for f in (Filter("amount", "eq", "5"), Filter("id", "eq", 1), Filter("nope", "eq", 1), Filter("amount", "like", 1)):
        with pytest.raises(select.SelectionError):
            select.select(df, [f])
    with pytest.raises(select.SelectionError):
        select.select(df, columns=["nope"])
    with pytest.raises(select.SelectionError):
        select.rename(df, {"id": "YEAR"})


def test_row_numbers_and_rows_at(people):
    n = select.numbered(people, [F.desc_nulls_last("people"), F.col("seq")], "n")
    assert [r.people for r in n.orderBy("n").collect()] == [50, 40, 30, 20, 10, 5, 1, None] and n.agg(F.max("n")).first()[0] == 7
    assert [r.seq for r in select.rows_at(people, [5, 0, 2], "seq").collect()] == [5, 0, 2]
    with pytest.raises(IndexError):
        select.rows_at(people, [99], "seq")


def test_aggregates_sort_all_groups_before_they_cut(people):
    body = {"group_by": ["region"], "unit_column": "unit", "measures": [{"fn": "sum", "column": "people", "alias": "s", "additive": True}, {"fn": "count_null", "column": "people"}], "order": [{"by": "s", "desc": True}], "limit": 1}
    out = aggregate.run(people, aggregate.parse(body))
    assert [tuple(r) for r in out.rows.collect()] == [("b", 90, 1)] and out.group_count == 3
    mixed = people.withColumn("unit", F.when(F.col("people") == 5, F.lit(None)).otherwise("n"))
    with pytest.raises(aggregate.MixedUnits) as refused:
        aggregate.run(mixed, aggregate.parse(body))
    assert refused.value.samples == [("c", 2)]
    big = people.withColumn("people", F.lit(2**62))
    assert int(aggregate.run(big, aggregate.parse(body | {"unit_column": None})).rows.first().s) == 3 * 2**62
    for bad in ({"measures": []}, {"measures": [{"fn": "sum", "column": "people"}]}, {"measures": [{"fn": "median", "column": "people"}]}, {"measures": [{"fn": "count_rows"}], "limit": 0}, {"measures": [{"fn": "count_rows"}], "order": [{"by": "x"}]}, {"measures": [{"fn": "count_rows"}, {"fn": "count_rows"}]}, {"measures": [{"fn": "count_rows"}], "more": 1}):
        with pytest.raises(rows.PlanError):
            aggregate.parse(bad)
    for bad in ({"measures": [{"fn": "avg", "column": "region"}]}, {"measures": [{"fn": "min", "column": "none"}]}):
        with pytest.raises(rows.PlanError):
            aggregate.run(people, aggregate.parse(bad))


def test_pages_put_nulls_last_and_tell_whether_more_follow(people):
    plan = rows.RowsPlan(columns=("people",), sort=(("people", True),), offset=5, limit=2)
    assert (lambda p: ([r.people for r in p[0]], p[1], p[2]))(rows.read_page(people, plan, "seq")) == ([5, 1], 8, True)
    up = rows.read_page(people, rows.RowsPlan(sort=(("people", False),), limit=8), "seq")
    assert up[0][-1].people is None and not up[2]
    found = rows.read_page(people, rows.RowsPlan(filters=rows.parse_filters([{"column": "people", "op": "gte", "value": "30"}])), "seq")
    assert len(found[0]) == 3 and found[1] is None
    for f in ([{"column": "people", "op": "eq", "value": "x"}], [{"column": "none", "op": "is_null"}]):
        with pytest.raises(rows.PlanError):
            rows.apply_filters(people, rows.parse_filters(f))
    for f in ([{"column": "a", "op": "like", "value": 1}], [{"column": "a", "op": "in", "value": []}], [{"column": "a", "op": "eq"}]):
        with pytest.raises(rows.PlanError):
            rows.parse_filters(f)
    assert rows.capped(people, 3)[1] and not rows.capped(people, 8)[1]
    with pytest.raises(rows.PlanError):
        rows.capped(people, 8, 3)
    assert len(rows.sample(people, 3, 1, "seq").collect()) == 3


def test_joins_observe_and_refuse(spark):
    left = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b"), (3, None, "c"), (4, 1.0, "d")], "id int, k double, name string")
    right = spark.createDataFrame([(1.0, "x"), (1.0, "y"), (float("nan"), "z"), (7.0, "w")], "rk double, name string")
    spec = joins.JoinSpec((("k", "rk"),), "left", "r")
    got = joins.compose(left, right, spec)
    assert got.columns == ["id", "k", "name", "name_r"] and sorted((r.id, r.name_r or "") for r in got.collect()) == [(1, "x"), (1, "y"), (2, ""), (3, ""), (4, "x"), (4, "y")]
    s = joins.join_stats(left, right, spec.keys).first()
    assert (s.observed_cardinality, s.duplicate_keys, s.inner_rows, s.left_join_rows, s.left_null_keys, s.right_unmatched_ratio) == ("many_to_many", True, 4, 6, 2, 0.5)
    assert tuple(joins.worst_key(left, right, spec.keys).first()) == (1.0, 2, 2, 4)
    for bad in (joins.JoinSpec((("k", "rk"),), cardinality="one_to_many"), joins.JoinSpec((("k", "rk"),), on_duplicate_key="fail"), joins.JoinSpec((("k", "rk"),), on_null_key="fail"), joins.JoinSpec((("id", "rk"),)), joins.JoinSpec((("none", "rk"),)), joins.JoinSpec(())):
        with pytest.raises(joins.CompositionError):
            joins.compose(left, right, bad)
    empty = joins.join_stats(left.limit(0), right, spec.keys).first()
    assert (empty.left_unmatched_ratio, empty.observed_cardinality) == (0.0, "one_to_one")


def test_ratio_splits_are_exact_and_reproducible(spark):
    df = spark.range(101).withColumnRenamed("id", "_row_seq")
    got = {r._row_seq: r.split for r in splits.ratio_split(df, {"train": 0.7, "test": 0.2, "dev": 0.1}, 3).collect()}
    assert splits.shares(101, {"train": 0.7, "test": 0.2, "dev": 0.1}) == {"dev": 10, "test": 20, "train": 71}
    order = sorted(got, key=lambda i: (hashlib.md5(f"3:{i}".encode()).hexdigest(), i))
    assert [got[i] for i in order] == ["dev"] * 10 + ["test"] * 20 + ["train"] * 71
    for ratios in ({}, {"a": 0.5}, {"a": -1, "b": 2}, {"a": float("nan"), "b": 1}):
        with pytest.raises(splits.SplitError):
            splits.check_ratios(ratios)
    with pytest.raises(splits.SplitError):
        splits.check_ratios({"a": 1.0}, "dealYear")


def test_key_splits_keep_first_seen_order(spark):
    df = spark.createDataFrame(list(enumerate(["b", None, "__null__", "a", "__missing__", "b"])), "_row_seq long, k string")
    got = sorted({(r.split_order, r.split) for r in splits.key_split(df, "k").collect()})
    assert got == [(0, "b"), (1, "__null__"), (2, "a"), (3, "__missing__")]
    assert {r.split for r in splits.key_split(df, "none").collect()} == {"__missing__"}
    assert splits.file_name("a-1") == "a-1.parquet" and splits.file_name("../x").startswith("key-") and splits.file_name("").startswith("key-")


def test_profiles_withhold_what_is_small_or_personal(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("amount"), F.lit(None).cast("long").alias("all_null"), F.concat(F.lit("a"), F.col("id").cast("string"), F.lit("@x.org")).alias("label"), F.col("id").alias("telno"))
    p = {e["column"]: e for e in summary.profile(df)}
    assert p["amount"]["range"] == (5.0, 24.0) and p["all_null"]["range"] == "no_values" and p["label"]["suspected"] == ["email"] and p["telno"]["range"] == "withheld"
    assert summary.profile(df.limit(9))[0]["range"] == "withheld"


def test_quality_never_passes_what_it_did_not_evaluate(spark):
    df = spark.createDataFrame([(0, "a"), (100, "b"), (101, "a"), (None, None)], "price long, t string")
    r = quality.evaluate(df, [quality.Rule("range", "price", low=0, high=100), quality.Rule("range", "t", low=0), quality.Rule("range", "gone", low=0), quality.Rule("dtype", "price", dtype="bigint"), quality.Rule("dtype", "gone", dtype="int"), quality.Rule("compare", "price", "t"), quality.Rule("max_duplicate_rate", limit=0.1)])
    assert [x.status for x in r] == ["fail", "fail", "not_evaluated", "pass", "not_evaluated", "fail", "pass"] and r[0].actual == pytest.approx(1 / 3)
    assert [x.status for x in quality.evaluate(df.limit(0), [quality.Rule("max_null_ratio", "t", limit=0), quality.Rule("min_rows", limit=1, severity="warn")])] == ["not_evaluated", "warn"]
    assert quality.availability(r) == "partial"


def test_baselines_name_why_there_is_none():
    run = lambda i, owner="o", cov="c", con="k", st="success": quality.Run(str(i), owner, f"2024-01-0{i}", st, cov, con)
    assert quality.baseline(run(5), [run(1), run(3), run(4, st="failed")])[0].run_id == "3"
    assert quality.baseline(run(5), [])[1] == "no_earlier_run" and quality.baseline(run(5), [run(1, "x")])[1] == "other_owner"
    assert quality.baseline(run(5), [run(1, cov="d")], True)[1] == "other_coverage" and quality.baseline(run(5), [run(1, con="d")], True)[1] == "other_contract"


def test_multiset_checksums_ignore_order_and_see_copies(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (1, "x")], "a int, b string")
    one = provenance.multiset_checksum(df)
    assert one == provenance.multiset_checksum(df.orderBy("b").repartition(3)) != provenance.multiset_checksum(df.distinct())
    lines = sorted(['{"a": 1, "b": "x"}', '{"a": 2, "b": null}', '{"a": 1, "b": "x"}'])
    assert provenance.ordered_checksum(provenance.record_lines(df)) == "sha256:" + hashlib.sha256(f"[{','.join(lines)}]".encode()).hexdigest()
    product = 1
    for line in lines:
        product = product * int.from_bytes(hashlib.shake_256(b"canonical-multiset-v2\0" + line.encode()).digest(384), "big") % provenance.MODULUS
    assert one == "sha256:" + hashlib.sha256(b"canonical-multiset-v2\0" + (3).to_bytes(8, "big") + product.to_bytes(384, "big")).hexdigest()
    assert provenance.coverage([(5, 5), (3, 2)]) == "partial" and provenance.coverage([(None, 3)]) == "unknown" and provenance.coverage([(5, 5)]) == "complete"
    assert provenance.compare_manifests({"a": "1", "b": "2"}, {"b": "3", "c": "4"}) == {"added": ["c"], "removed": ["a"], "modified": ["b"]}
    assert not provenance.has_changed("x", {"a": 1}, {"checksum": "x", "params": {"a": 1}}) and provenance.has_changed("x", {}, None)


def test_personal_data(spark):
    df = spark.createDataFrame([("tel 010-1234-5678", 1), ("900101-1234567", 2), ("a@b.co", 3), ("123-45-67890", 4), ("9013011234567", 5), (None, 6)], "t string, n int")
    assert {(r.kind, r["count"]) for r in pii.scan_values(df).collect()} == {("phone", 1), ("rrn", 1), ("email", 1), ("business_no", 1)}
    assert pii.suspect_kind("APT_NM") == "name" and pii.suspect_kind("전화연락처") == "phone" and pii.suspect_kind("value") is None
    assert [tuple(r) for r in pii.mask(df, ["t", "n"]).limit(6).collect()] == [("[masked]", None)] * 5 + [(None, None)]


def test_cadences():
    assert cadence.parse_cadence("P1DT12H") == timedelta(hours=36) and cadence.parse_cadence("P1W") == timedelta(7)
    for bad in ("P1M", "P", "PT", "1D", "P0D", ""):
        with pytest.raises(ValueError):
            cadence.parse_cadence(bad)
    now = datetime(2024, 1, 10, tzinfo=UTC)
    assert cadence.is_stale("P1D", now - timedelta(2), now) and cadence.is_stale(None, now, now) is None
    assert cadence.speaks_of_time("dealYear") and cadence.speaks_of_time("base_dt") and not cadence.speaks_of_time("update_by")


def test_derived_columns(spark):
    df = spark.createDataFrame([("a|b", "c\\", "2024", "2", "30"), (None, "x", "2024", "2", "29"), ("q", "r", None, "1", "1")], "a string, b string, y string, m string, d string")
    rows_ = df.select(derive.join_key([F.col("a"), F.col("b")]).alias("k"), derive.date_parts(F.col("y"), F.col("m"), F.col("d")).cast("string").alias("t"), derive.conflict([F.col("a"), F.col("b")]).alias("c")).collect()
    assert [tuple(r) for r in rows_] == [("a\\|b|c\\\\", None, True), (None, "2024-02-29", False), ("q|r", None, True)]


GOOD = ["SELECT * FROM dataset", "select count(*) from Dataset;", "WITH a AS (SELECT people FROM dataset) SELECT max(people) FROM a", "SELECT region FROM dataset UNION SELECT unit FROM dataset", "SELECT a.seq FROM dataset a JOIN dataset b USING (seq) WHERE a.people IN (SELECT max(people) FROM dataset)", "SELECT ';' AS s, seq FROM dataset -- ;", "SELECT rank() OVER (ORDER BY people) AS r FROM dataset"]
BAD = ["", "SELECT 1", "DROP TABLE dataset", "SELECT * FROM dataset; SELECT * FROM dataset", "SELECT * FROM other", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM db.dataset", "SELECT * FROM `dataset`", "SELECT * FROM range(3)", "SELECT * FROM VALUES (1)", "WITH dataset AS (SELECT 1 AS a) SELECT * FROM dataset", "WITH a AS (SELECT * FROM dataset) SELECT 1 AS x", "SELECT explode(array(seq)) FROM dataset", "SELECT rand() FROM dataset", "SELECT current_timestamp() FROM dataset", "SELECT current_date FROM dataset", "SELECT seq FROM dataset TABLESAMPLE (10 PERCENT)", "SELECT * FROM dataset LATERAL VIEW explode(array(1)) t AS x", "CREATE TABLE t AS SELECT * FROM dataset", "SELECT java_method('java.lang.System', 'exit') FROM dataset", "SELECT seq FROM dataset WHERE seq IN (SELECT id FROM other)", "SET spark.x = 1", "SELECT version() FROM dataset", "SELECT * FROM dataset, LATERAL (SELECT 1)", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r) SELECT n FROM r, dataset", "SELECT " + "seq," * 20_000 + "seq FROM dataset"]


@pytest.mark.parametrize("sql", GOOD)
def test_queries_of_dataset_run(people, sql):
    assert validator.run(people, sql).collect()


@pytest.mark.parametrize("sql", BAD)
def test_all_else_is_refused(spark, sql):
    with pytest.raises(validator.UnsafeQueryError):
        validator.validate(spark, sql)


def test_masked_columns_are_masked_before_any_expression(people):
    assert {r[0] for r in validator.run(people, "SELECT concat(region, '!') FROM dataset", ("region",)).collect()} == {"[masked]!"}
    assert validator.run(people, "SELECT people FROM dataset ORDER BY people").collect()[-1][0] is None
    assert validator.run(people, "SELECT people FROM dataset ORDER BY people NULLS FIRST").collect()[0][0] is None
    assert validator.run(people, "SELECT '🙂;' AS s, people FROM dataset ORDER BY people DESC LIMIT 1").first().people == 50
    assert validator.nulls_last(people.sparkSession, "SELECT '🙂', row_number() OVER (ORDER BY seq DESC) AS r FROM dataset ORDER BY r, seq") == "SELECT '🙂', row_number() OVER (ORDER BY seq DESC NULLS LAST) AS r FROM dataset ORDER BY r NULLS LAST, seq NULLS LAST"


def test_equal_rows_are_hashed_once_and_checksums_stay(spark):
    import hashlib

    from brindle.operators import provenance as p

    rows = [("a", 1.5)] * 7 + [("a", 0.0)] * 2 + [("a", -0.0)] * 3 + [(None, float("nan"))] * 2 + [("b", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    product = 1
    for k, x in rows:
        product = product * p._element(p._line({"k": k, "x": x})) % p.MODULUS
    want = hashlib.sha256(p._DOMAIN + len(rows).to_bytes(8, "big") + product.to_bytes(p.BITS // 8, "big")).hexdigest()
    assert p.multiset_checksum(df) == f"sha256:{want}" and p._counted(df).count() == 5
