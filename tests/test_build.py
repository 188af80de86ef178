import dataclasses
import json

import pytest

from brindle.operators.joins import JoinSpec
from brindle.operators.quality import Rule
from brindle.operators.select import Filter
from brindle.operators.warehouse import Conflict, Warehouse, WarehouseError, restore, verify_backup
from brindle.plans import build
from brindle.plans.spec import BuildSpec, Contract, Export, Source, load, problems

TRADES = [{"aptNm": f"A{i % 3}", "dealAmount": f"{100 + i},000", "dealYear": "2024", "dealMonth": str(i % 12 + 1), "dealDay": "7", "sggCd": f"{i % 4}", "buyer": "" if i % 2 else "\\N", "old": None if i % 2 else "v", "new": "v" if i % 2 else None} for i in range(20)]
CONTRACT = Contract(null_tokens=("\\N",), column_null_tokens={"buyer": ("",)}, coalesce={"merged": ("old", "new")}, rename={"aptNm": "name"}, zfill={"sggCd": 5}, casts={"dealAmount": "int_comma"}, date_parts={"deal_date": ("dealYear", "dealMonth", "dealDay")}, join_keys={"key": ("sggCd", "name")})


@pytest.fixture
def files(tmp_path):
    (tmp_path / "trades.jsonl").write_text("\n".join(json.dumps(t) for t in TRADES))
    (tmp_path / "regions.csv").write_text("code,region\n00000,north\n00001,south\n00002,east\n")
    return tmp_path


def source(files, **more):
    return Source("trades", path=str(files / "trades.jsonl"), format="jsonl", contract=CONTRACT, **more)


def test_a_source_is_normalised_selected_split_exported_and_committed(spark, files):
    spec = BuildSpec("trades", (source(files, rules=(Rule("range", "dealAmount", low=1), Rule("min_rows", limit=5)), filters=(Filter("dealAmount", "ge", 105_000),), columns=("deal_date", "dealAmount", "key", "merged"), refresh_cadence="P1D"),), split={"train": 0.8, "test": 0.2}, exports=(Export("csv", "out/trades.csv"), Export("jsonl", "out/trades.jsonl")))
    assert problems(spec) == []
    w = Warehouse(spark, files / "w")
    b = build.run_build(spark, spec, files / "build", w)
    assert b.status == "success", b.manifest
    rows = b.gold.collect()
    assert len(rows) == 15 and b.gold.columns == ["deal_date", "dealAmount", "key", "merged", "split"] and b.splits == {"test": 3, "train": 12}
    assert {r.merged for r in rows} == {"v"} and min(r.dealAmount for r in rows) == 105_000 and rows[0].key.startswith("0000")
    assert w.read("trades").count() == 15 and len((files / "build/out/trades.csv").read_text().splitlines()) == 16
    again = build.run_build(spark, spec)
    assert again.outcomes[0].checksum == b.outcomes[0].checksum and again.manifest["inputs"] == b.manifest["inputs"]


def test_two_sources_are_joined_on_checked_keys(spark, files):
    regions = Source("regions", path=str(files / "regions.csv"), format="csv", contract=Contract(read_as={"code": "str"}))
    spec = BuildSpec("joined", (source(files), regions), composition=JoinSpec((("sggCd", "code"),), "left", "r", cardinality="many_to_one"))
    b = build.run_build(spark, spec)
    assert b.status == "success", b.manifest
    assert b.gold.count() == 20 and b.gold.where("region is null").count() == 5
    bad = build.run_build(spark, dataclasses.replace(spec, composition=JoinSpec((("sggCd", "code"),), cardinality="one_to_one")))
    assert bad.status == "failed" and "observed many_to_one" in bad.manifest["error"]


@pytest.mark.parametrize(("contract", "what"), [
    (Contract(casts={"aptNm": "int"}), "lose"), (Contract(zfill={"dealAmount": 3}), "wider"), (Contract(rename={"x": "y"}), "not there"),
    (Contract(coalesce={"m": ("old", "aptNm")}), "disagree"), (Contract(date_parts={"d": ("dealYear", "dealMonth", "dealAmount")}), "no date"),
])
def test_a_contract_that_loses_values_fails(spark, files, contract, what):
    spec = BuildSpec("t", (Source("trades", path=str(files / "trades.jsonl"), format="jsonl", contract=contract),))
    b = build.run_build(spark, spec)
    assert b.status == "failed" and what in b.outcomes[0].error


def test_gates(spark, files):
    spec = BuildSpec("t", (source(files, rules=(Rule("min_rows", limit=100),)),))
    assert "quality" in build.run_build(spark, spec).outcomes[0].error
    (files / "p.jsonl").write_text('{"m": "me@example.org"}\n')
    personal = Source("p", path=str(files / "p.jsonl"), format="jsonl")
    assert "personal" in build.run_build(spark, BuildSpec("t", (personal,))).outcomes[0].error
    assert build.run_build(spark, BuildSpec("t", (personal,), pii_mode="warn")).status == "success"
    masked = build.run_build(spark, BuildSpec("t", (dataclasses.replace(personal, mask=("m",)),)))
    assert masked.gold.first().m == "[masked]"


def test_a_preview_shows_what_changed(spark, files):
    p = build.preview(spark, BuildSpec("t", (source(files),)), "trades", limit=5, max_rows=12)
    assert len(p.rows) == 5 and p.total_seen == 12 and p.change_counts["dealAmount"] == 12 and (0, "dealAmount", "100,000", "100000") in p.changes


def test_specs_are_checked_before_any_data_is_read(tmp_path):
    ok = Source("s", path="x", format="csv")
    r = dataclasses.replace
    bad = [BuildSpec("d", ()), BuildSpec("d", (ok, ok)), BuildSpec("d", (r(ok, format="xls"),)), BuildSpec("d", (ok,), split={"a": 0.4}), BuildSpec("d", (ok,), pii_mode="allow", publish=True),
           BuildSpec("d", (ok,), exports=(Export("csv", "../x"),)), BuildSpec("d", (ok,), exports=(Export("csv", "a"), Export("csv", "a/b"))), BuildSpec("d", (ok,), composition=JoinSpec((("a", "b"),))),
           BuildSpec("d", (r(ok, contract=Contract(casts={"a": "complex"})),)), BuildSpec("d", (r(ok, rules=(Rule("range", "a"),)),)), BuildSpec("d", (r(ok, param_grid={"a": []}),)), BuildSpec("d", (r(ok, contract=Contract(zfill={"a": 0})),))]
    assert all(problems(s) for s in bad) and not problems(BuildSpec("d", (ok,)))
    (tmp_path / "s.json").write_text(json.dumps({"dataset": "d", "sources": [{"key": "s", "path": "x", "format": "csv", "contract": {"coalesce": {"m": ["a", "b"]}}, "filters": [{"column": "a", "op": "eq", "value": 1}]}], "exports": [{"kind": "csv", "path": "a.csv"}]}))
    assert load(tmp_path / "s.json").sources[0].contract.coalesce == {"m": ("a", "b")}


def test_snapshots_pointers_leases_and_collection(spark, tmp_path):
    w = Warehouse(spark, tmp_path / "w")
    first = w.materialize(spark.range(1), "t")
    assert w.materialize(spark.range(0), "t") is None and w.read("t").count() == 1
    with pytest.raises(Conflict):
        w.materialize(spark.range(2), "t", expected_revision=0)
    analysis = w.save_analysis("n", "SELECT count(*) AS n FROM dataset", "t")
    others = [w.materialize(spark.range(n), "t") for n in range(2, 8)]
    pinned, lease = w.pin("t")
    assert pinned == others[-1].snapshot_id and w.read("t", first.snapshot_id).count() == 1 and w.run_analysis(analysis).first().n == 1
    gone = w.collect(keep=2)
    assert first.snapshot_id not in gone and len(gone) == 4 and len(w.history("t")) == 3
    with pytest.raises(WarehouseError):
        w.read("t", gone[0])
    w.release(lease)
    w.delete_analysis(analysis)
    assert w.collect(keep=2) == [first.snapshot_id]
    kept = w.backup(tmp_path / "b")
    assert verify_backup(spark, kept) == [] and restore(spark, kept, tmp_path / "w2").read("t").count() == 7
    with pytest.raises(WarehouseError):
        w.read("nothing")


def test_streams_give_what_batches_give(spark, tmp_path):
    from pyspark.sql import functions as F

    from brindle.streaming import ingest

    df = spark.range(100).select(F.col("id"), F.timestamp_seconds(F.col("id") * 600).alias("at"), (F.col("id") % 3).cast("string").alias("status"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), df.schema)
    ingest.append_batches(stream, tmp_path / "out", tmp_path / "cp", {"status": "int"}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("status")).first()[0] == 99
    q = ingest.hourly_counts(stream, "at", "status").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 100
