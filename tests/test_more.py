from datetime import UTC, date, datetime, time, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from brindle.functions import legacy, semantics
from brindle.functions.semantics import Hint
from brindle.sources import infer, tagged


def test_meanings_travel_with_the_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, c string")
    df = semantics.annotate(df, {"n": [Hint("kind", "measure", "engine_inferred"), Hint("unit", "people", "catalog")]})
    df = semantics.annotate(df, {"n": [Hint("kind", "code", "user_annotation"), Hint("unit", "persons", "engine_inferred")], "c": [Hint("label", "Name", "core_spec")]})
    df.write.parquet(str(tmp_path / "t"))
    got = semantics.meanings(spark.read.parquet(str(tmp_path / "t")))
    assert {c: {p: h.value for p, h in m.items()} for c, m in got.items()} == {"n": {"kind": "code", "unit": "people"}, "c": {"label": "Name"}}


def test_older_forms(spark):
    df = spark.createDataFrame([(1, "x", " - "), (5, "y", " v "), (None, "y", None)], "n int, k string, t string")
    for text, n in (("n >= 2", 1), ("k != 'x'", 2), ("n<5.5", 2), ('k == "y"', 2)):
        assert df.where(legacy.condition(df, text)).count() == n
    for bad in ("n like 2", "none > 1", "n"):
        with pytest.raises(ValueError):
            legacy.condition(df, bad)
    assert [r[0] for r in df.select(legacy.nullify(F.col("t"))).collect()] == [None, "v", None]
    assert [r[0] for r in df.select(legacy.template("{}-{}!", [F.col("k"), F.col("n")])).collect()] == ["x-1!", "y-5!", None]
    out = legacy.variants(df, {"en": {"romanize_columns": ["k"], "column_rename": {"k": "kind", "zz": "q"}}, "ko": {}}, str.upper)
    assert {r.kind for r in out["en"].collect()} == {"X", "Y"} and out["ko"].columns == df.columns and list(legacy.variants(df, {})) == ["default"]
    with pytest.raises(ValueError):
        legacy.variants(df, {"en": {"romanize_columns": ["k"]}})


def test_tagged_records_come_back_as_they_were():
    record = {"d": date(2024, 1, 2), "t": datetime(2024, 1, 2, 3, 4, 5, 6, tzinfo=ZoneInfo("Asia/Seoul")), "u": datetime(2024, 1, 2, tzinfo=UTC), "h": time(1, 2, fold=1), "x": Decimal("1.10"), "b": b"\x00\xff", "p": (1, (2, [date(1, 1, 1)])), "m": {1: "a", "$type": "z"}, "l": [None, True, 1.5], "e": timedelta(days=-1, microseconds=3)}
    import json

    back = tagged.unpack(json.loads(tagged.line(record)))
    assert back == record and back["t"].tzinfo.key == "Asia/Seoul" and back["h"].fold == 1
    with pytest.raises(TypeError):
        tagged.pack({"x": object()})
    with pytest.raises(ValueError):
        tagged.line({"x": float("nan")})


def test_structure_of_json(spark):
    lines = infer.records(spark, [{"a": None, "b": 1, "c": [1]}, {"a": "x", "b": 1.5, "d": {"e": 1}, "f": True, "g": None}, {"a": 1, "h": 0.5}])
    assert dict(map(tuple, tagged.structure(lines).collect())) == {"a": "string", "b": "integer", "c": "array", "d": "object", "f": "boolean", "g": "null", "h": "number"}


def test_the_largest_page_tells_whether_more_follow(spark):
    from brindle.operators import rows

    df = spark.range(1200).withColumnRenamed("id", "seq")
    for offset, more in ((0, True), (700, False), (699, True)):
        found, total, follows = rows.read_page(df, rows.RowsPlan(offset=offset, limit=500), "seq")
        assert (len(found), total, follows) == (500, 1200, more)


def test_joined_rows_follow_the_right_sides_order(spark, tmp_path):
    from brindle.operators.joins import JoinSpec
    from brindle.plans.build import run_build
    from brindle.plans.spec import BuildSpec, Source

    left, right = tmp_path / "l.jsonl", tmp_path / "r.jsonl"
    left.write_text("".join(f'{{"k": {i % 5}, "a": {i}}}\n' for i in range(20)))
    right.write_text("".join(f'{{"k2": {i % 5}, "b": {i}}}\n' for i in reversed(range(60))))
    spec = BuildSpec("joined", (Source("l", path=str(left), format="jsonl"), Source("r", path=str(right), format="jsonl")), composition=JoinSpec((("k", "k2"),), "left"))
    build = run_build(spark, spec, folder=tmp_path / "out")
    assert build.status == "success", build.manifest
    assert "_right_seq" not in build.gold.columns
    from brindle.plans import build as module

    outcomes = {s.key: module.run_source(spark, spec, s) for s in spec.sources}
    kept = module.Build("success", [])
    seen = []
    original = module.numbered
    module.numbered = lambda df, order, *more: seen.append(original(df, order, *more)) or seen[-1]
    try:
        module._gold(spark, spec, kept, outcomes, None, None)
    finally:
        module.numbered = original
    rows = seen[-1].orderBy("_row_seq").collect()
    assert [(r.a, r.b) for r in rows] == [(a, b) for a in range(20) for b in reversed(range(60)) if a % 5 == b % 5]


def test_folders_of_csv_and_json_files(spark, tmp_path):
    from brindle.sources import readers

    for name, texts in (("even", ("id,t\n1,a\n2,b\n", "id,t\n3,c\n")), ("quoted", ('id,t\n1,"a\nb"\n', "id,t\n2,c\n3,d\n"))):
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"{i}.csv").write_text(text)
        got = readers.read_csv(spark, str(tmp_path / name)).orderBy("_row_seq").collect()
        assert [(r._row_seq, r.id) for r in got] == [(0, 1), (1, 2), (2, 3)]
    (tmp_path / "even" / "2.csv").write_text("id,u\n4,x\n")
    with pytest.raises(readers.SourceError, match="headers"):
        readers.read_csv(spark, str(tmp_path / "even"))
    (tmp_path / "json").mkdir()
    for i, text in enumerate(('[{"a": 1, "b": "]"}, {"a": 2}]', " [ ] ", '[{"a": 3}]')):
        (tmp_path / "json" / f"{i}.json").write_text(text)
    assert [(r._row_seq, r.a) for r in readers.read_json(spark, str(tmp_path / "json")).orderBy("_row_seq").collect()] == [(0, 1), (1, 2), (2, 3)]
    for bad in ("[1]", '[{"a": 1}', '[{"a": 1}] x', '[{"a": 1} {"a": 2}]', ""):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(readers.SourceError):
            readers.read_json(spark, str(tmp_path / "bad.json"))


def test_nearest_ranks_are_exact(spark):
    import math
    import random

    from brindle.operators import history

    r = random.Random(3)
    groups = {"many": [r.gauss(0, 1) for _ in range(60_000)], "one": [4.0], "ties": [1.0] * 900 + [2.0] * 100, "two": [1.0, 2.0], None: [5.0, 6.0, 7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, None]], "k string, v double").repartition(6)
    for share in (0.95, 0.5, 1.0):
        got = {x.k: x.value for x in history.nearest_rank(df, "v", ["k"], share).collect()}
        assert got == {k: sorted(vs)[math.ceil(share * len(vs)) - 1] for k, vs in groups.items()}
    assert history.nearest_rank(df.where("k = 'ties'"), "v", [], 0.9).first().value == 1.0


def test_rows_without_a_time_are_counted(spark):
    from brindle.operators import history

    df = spark.createDataFrame([("2026-01-01 10:00:00",), ("soon",), (None,)], "ts string")
    assert tuple(history.excluded(df).first()) == (2, "partial") and tuple(history.excluded(df.limit(0)).first()) == (0, "available")


def test_a_cluster_has_to_name_its_shared_folder():
    from brindle.operators import stable

    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        stable.shared_folder(Session)


def test_a_snapshot_whose_files_stay_is_retiring_until_they_go(spark, tmp_path, monkeypatch):
    from brindle.operators import warehouse

    w = warehouse.Warehouse(spark, tmp_path / "w")
    old, new = w.materialize(spark.range(3), "t"), w.materialize(spark.range(4), "t")
    with monkeypatch.context() as m:
        m.setattr(warehouse.shutil, "rmtree", lambda *a, **k: None)
        assert w.collect(keep=1) == [] and [s.snapshot_id for s in w.history("t")] == [new.snapshot_id]
    for refused in (lambda: w.read("t", old.snapshot_id), lambda: w.hold(old.snapshot_id, "audit")):
        with pytest.raises(warehouse.WarehouseError):
            refused()
    assert w.collect(keep=1) == [old.snapshot_id] and not (tmp_path / "w" / "tables" / "t" / old.snapshot_id).exists()
    assert w.collect(keep=1) == [] and w.read("t").count() == 4
