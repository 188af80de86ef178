"""Files in which a record may begin anywhere, read by many tasks."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql.readwriter import DataFrameReader

from brindle.sources import pieces, readers


@pytest.fixture(autouse=True)
def no_whole_files(monkeypatch):
    plain = DataFrameReader.text

    def text(self, paths, wholetext=False, **more):
        assert not wholetext, "one task reads a file whole"
        return plain(self, paths, **more)

    monkeypatch.setattr(DataFrameReader, "text", text)


@contextmanager
def cut(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_csv_records_cross_pieces(spark, tmp_path):
    r = random.Random(5)
    fields = ["", '""', "a", '5" pipe', '"x,\ny"', '"a ""b""\r\n c"', " ", '"\n\n\n"', "é", '"' + "long\n" * 30 + '"', '"""\n"""']
    want = []
    for i in range(5):
        rows = [[r.choice(fields) for _ in range(r.choice((2, 3, 3)))] for _ in range(r.randrange(1, 25))]
        text = ("﻿" if i % 2 else "\n\n") + '"h\n1",b,c\n' + "".join(",".join(row) + r.choice(("\n", "\r\n", "\n\n", "\r")) for row in rows)
        (tmp_path / f"{i}.csv").write_bytes((text if i else text.rstrip("\r\n")).encode())
        want += [tuple([*row, None, None][:3]) for row in readers.csv_records(text if i else text.rstrip("\r\n"))[1:]]
    with cut(spark, 40):
        df = readers.read_csv(spark, str(tmp_path), {"h\n1": "str", "b": "str", "c": "str"})
        assert pieces.find(spark, str(tmp_path), pieces.Csv(), True).units.rdd.getNumPartitions() > 20
    # Pieces stay as they were found, whatever the session says when the rows are asked for.
    rows = df.orderBy("_row_seq").collect()
    assert [tuple(row)[1:] for row in rows] == want and [row._row_seq for row in rows] == list(range(len(want)))


def test_quotes_inside_plain_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n5" pipe,"two\nlines",6" rod\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [(0, '5" pipe', "two\nlines", '6" rod')]


@pytest.mark.parametrize(("text", "what"), [('a,b\n1,2\n"x\ny",3\n"z\n" w,4\n', "line 6: text behind"), ('a,b\n1,2\n\n"x\ny,3\n', "line 5: a quote is not closed"), ('a,b\n"x\ny\nz\n",2,3\n', "too many")])
def test_bad_csv_is_refused_in_any_piece(spark, tmp_path, text, what):
    (tmp_path / "a.csv").write_text(text)
    for size in (1000, 5):
        with cut(spark, size), pytest.raises(readers.SourceError, match=what):
            readers.read_csv(spark, str(tmp_path / "a.csv"))


def test_json_elements_cross_pieces(spark, tmp_path):
    r = random.Random(6)
    texts = ["", "}", '"', "\\", '}{"]\\"', "[[", "é\n", '"},{"', "x" * 90]
    want = []
    for i in range(5):
        rows = [{"i": r.randrange(9), "t": r.choice(texts), "n": {"l": [{"y": r.choice(texts)} for _ in range(r.randrange(3))]}} for _ in range(r.randrange(1, 12) if i != 2 else 0)]
        (tmp_path / f"{i}.json").write_text(("﻿" if i == 1 else " \n") + json.dumps(rows, indent=i or None, ensure_ascii=False) + " \n" * i)
        want += rows
    with cut(spark, 50):
        rows = readers.read_json(spark, str(tmp_path)).orderBy("_row_seq").collect()
        assert pieces.find(spark, str(tmp_path), pieces.Json(), False).units.rdd.getNumPartitions() > 20
    assert [row._row_seq for row in rows] == list(range(len(want)))
    assert [{"i": row.i, "t": row.t, "n": {"l": [{"y": x.y} for x in row.n.l]}} for row in rows] == want


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2}', '[{"a": 1}, {"a": 2', '[{"a": 1}] {"b": 2}', '[{"a": 1}][{"b": 2}]', '[{"a": 1}, {"a": 2} {"a": 3}]', '[{"a": 1}, {"a": x}]', '[{"a": "x\ny"}]', "[    ", '{"a": 1}', '[{"a": 1}, 2]', '[{"a": 1},]', '[,{"a": 1}]', '[{"a": 1}]]', '[{"a": [1}]}]'])
def test_bad_json_is_refused_in_any_piece(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    for size in (1000, 5):
        with cut(spark, size), pytest.raises(readers.SourceError, match="a.json"):
            readers.read_json(spark, str(tmp_path / "a.json"))
