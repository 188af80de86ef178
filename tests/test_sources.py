import json

import pytest
from pyspark.sql import types as T

from brindle.sources import fetch, infer, readers, sinks
from brindle.sources.readers import SourceError


def lines(spark, *rows):
    return infer.records(spark, list(rows))


def test_types_are_inferred_over_all_records(spark):
    rows = [{"v": i, "s": {"a": "x"}, "l": [1], "n": None} for i in range(200)] + [{"v": 1.5, "late": True, "s": {"b": 2}}]
    schema = infer.infer(lines(spark, *rows).repartition(7))
    assert schema.names == ["v", "s", "l", "n", "late"]
    assert schema["v"].dataType == T.DoubleType() and schema["n"].dataType == T.NullType() and schema["s"].dataType.names == ["a", "b"]
    got = infer.load(lines(spark, *rows)).orderBy("_row_seq").collect()
    assert got[200].v == 1.5 and got[200].s == ("x" and None, 2) and got[0].l == [1] and got[5]._row_seq == 5


@pytest.mark.parametrize(("rows", "what"), [([{"v": 1}, {"v": "a"}], "different types"), ([{"v": 2**53 + 1}, {"v": 1.5}], "2\\^53"), ([{"Name": 1, "name": 2}], "case"), ([{"v": [1, "a"]}], "different types")])
def test_conflicts_are_refused(spark, rows, what):
    with pytest.raises(infer.InferenceError, match=what):
        infer.infer(lines(spark, *rows))


def test_wide_integers(spark):
    schema = infer.infer(lines(spark, {"a": 10**30, "b": 10**40, "c": 10**17}))
    assert [f.dataType.simpleString() for f in schema.fields] == ["decimal(38,0)", "string", "bigint"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,v,v,t\n1,1.5,,true\n\n2,,"",false\n3,2\n', encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "double", "string", "boolean"]
    rows = df.orderBy("_row_seq").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1.5, None, True), (1, 2, None, "", False), (2, 3, 2.0, None, None)]
    assert df.columns == ["_row_seq", "id", "v", "v_duplicated_0", "t"]
    (tmp_path / "b.csv").write_text('id,t\r\n01,"two\nlines"\r\n02,"a ""b"""\r\n')
    got = readers.read_csv(spark, str(tmp_path / "b.csv"), {"id": "str"}).orderBy("_row_seq").collect()
    assert [(r.id, r.t) for r in got] == [("01", "two\nlines"), ("02", 'a "b"')]


@pytest.mark.parametrize(("text", "what"), [('a\n"x\n', "not closed"), ('a\n"x"y\n', "closing quote"), ("a\n1,2\n", "too many"), ("", "empty")])
def test_bad_csv_is_refused(spark, tmp_path, text, what):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match=what):
        readers.read_csv(spark, str(tmp_path / "x.csv")).collect()


def test_json_and_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert [tuple(r)[1:] for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("_row_seq").collect()] == [(1, None), (2, "x")]
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2
    for name, text in (("b.json", '{"a": 1}'), ("c.json", '[{"a": 1},]')):
        (tmp_path / name).write_text(text)
        with pytest.raises(SourceError):
            readers.read_json(spark, str(tmp_path / name))
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception, match="line 2"):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_parquet_keeps_file_order_and_limits(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "p"))
    df = readers.read_parquet(spark, str(tmp_path / "p"))
    assert sorted(r._row_seq for r in df.collect()) == list(range(1000))
    with pytest.raises(SourceError):
        readers.read_parquet(spark, str(tmp_path / "p"), readers.ParquetLimits(cells=10))


def test_param_grid():
    assert readers.param_grid({"x": 0}, {"b": [1, 2], "a": ["p", "q"]}) == [{"x": 0, "a": "p", "b": 1}, {"x": 0, "a": "p", "b": 2}, {"x": 0, "a": "q", "b": 1}, {"x": 0, "a": "q", "b": 2}]
    for grid in ({"x": [1]}, {"a": []}, {"a": list(range(101)), "b": list(range(100))}):
        with pytest.raises(SourceError):
            readers.param_grid({"x": 0}, grid)


def pages(params, page):
    rows = [{"k": params["k"], "i": i, "note": "key s3cret"} for i in range((page - 1) * 2, min(page * 2, 5))]
    return rows, 5


def test_fetching_resumes_bounds_and_scrubs(spark, tmp_path):
    calls = []

    def client(params, page):
        calls.append((params["k"], page))
        return pages(params, page)

    fragments = fetch.Fragments(tmp_path)
    one = fetch.fetch(client, [{"k": 1}, {"k": 2}], fragments, ["s3cret"])
    assert (len(one.records), one.totals, one.resumed) == (10, [(5, 5), (5, 5)], False) and one.records[0]["note"] == "key [redacted]"
    before = len(calls)
    two = fetch.fetch(client, [{"k": 1}, {"k": 3}], fragments, ["s3cret"])
    assert two.resumed and len(calls) == before + 3 and len(two.records) == 10
    assert fetch.fetch(pages, [{"k": 1}], max_rows=3).stopped_early
    df = fetch.call_source(spark, pages, [{"k": 1}, {"k": 2}], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("i", T.IntegerType())]))
    assert sorted(map(tuple, df.collect())) == [(k, i) for k in (1, 2) for i in range(5)]


def test_urls_are_checked():
    assert fetch.check_url("https://example.org/x", lambda h: ["93.184.216.34"]) == "93.184.216.34"
    for url, found in (("http://example.org", ["93.184.216.34"]), ("https://u:p@example.org", ["93.184.216.34"]), ("https://example.org", ["10.0.0.1"]), ("https://example.org", ["93.184.216.34", "127.0.0.1"])):
        with pytest.raises(SourceError):
            fetch.check_url(url, lambda h, found=found: found)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=cmd", True, 1.5, [1]), (2, "", None, None, None), (3, None, False, 2.0, [])], "i int, t string, b boolean, v double, l array<int>")
    text = sinks.write_csv(df, tmp_path / "a.csv").read_text()
    assert text.splitlines() == ["i,t,b,v,l", "1,'=cmd,true,1.5,[1]", '2,"",,,', "3,,false,2.0,[]"]
    back = [json.loads(x) for x in sinks.write_jsonl(df, tmp_path / "a.jsonl").read_text().splitlines()]
    assert back[0] == {"b": True, "i": 1, "l": [1], "t": "=cmd", "v": 1.5} and list(back[1]) == ["b", "i", "l", "t", "v"]
    assert spark.read.parquet(str(sinks.write_parquet(df, tmp_path / "a.parquet"))).count() == 3
    assert spark.read.parquet(str(sinks.empty_like(df, tmp_path / "e.parquet"))).schema == df.schema
    with pytest.raises(sinks.ExportError):
        sinks.write_jsonl(spark.createDataFrame([(float("nan"),)], "v double"), tmp_path / "n.jsonl")
    assert "| i | int |" in sinks.write_markdown(df, tmp_path / "c.md", "T", {"from": "test"}).read_text()
    hub = sinks.write_hub_layout(df, tmp_path / "hub", "T")
    assert (hub / "data/train-00000-of-00001.parquet").is_file() and json.loads((hub / "dataset_infos.json").read_text())["default"]["splits"]["train"]["num_examples"] == 3
    with pytest.raises(sinks.ExportError):
        sinks.write_competition_layout(df, tmp_path / "k", "T", None)
    assert (sinks.write_competition_layout(df, tmp_path / "k", "T", "CC0-1.0") / "dataset-metadata.json").is_file()
    report = sinks.export_result(df, tmp_path / "r.csv", profile="spreadsheet")
    assert (report["rows"], report["altered_cells"]) == (3, 1)
    with pytest.raises(sinks.ExportError):
        sinks.export_result(df, tmp_path / "r2.csv", max_rows=2)
    sinks.register("twice", lambda d, to: to, override=True)
    with pytest.raises(sinks.ExportError):
        sinks.register("csv", sinks.write_csv)
    assert sinks.publish_local([tmp_path / "a.csv"], tmp_path / "out")[0].read_text() == text
