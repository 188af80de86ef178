import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.llm.fingerprints import PIECE, digests, fingerprints, likeness, op6_fingerprints, peel, sketch, subtract

from .helpers import AWKWARD, documents, save


def parts(text):
    return {line[i : i + PIECE] for line in (text or "").split("\n") for i in range(0, len(line), PIECE)}


def dice(a, b):
    one, two = parts(a), parts(b)
    return 1.0 if not one and not two else 2 * len(one & two) / (len(one) + len(two))


def test_the_query_agrees_with_a_plain_version(spark, tmp_path):
    texts = [*("\n".join(f"line {j * i % 17} of é {i}" for j in range(i % 23)) for i in range(60)), *AWKWARD, "x\ny", "x\ny\nz"]
    got = {r.doc_id: r for r in op6_fingerprints(spark, save(documents(spark, texts, extra="digests"), tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        t, after = text or "", texts[i - 1] or ""  # descending doc_id; after the last comes the first
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest()), i
        assert r.near_edited == pytest.approx(dice(t, edited)) and r.near_next == pytest.approx(dice(t, after)), i
    same = {}
    for i, text in enumerate(texts):
        assert same.setdefault(text or "", got[i].fingerprint) == got[i].fingerprint


def test_equal_ids_and_rows_each_get_a_result(spark, tmp_path):
    df = documents(spark, ["a\nb", "a\nb", "c", None])
    df = df.withColumn("doc_id", F.when(F.col("doc_id") < 3, 5).otherwise(F.lit(None)).cast("long"))
    got = op6_fingerprints(spark, save(df, tmp_path)).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 1), (False, 3), (False, 3), (True, 0)]
    assert 1.0 in [r.near_next for r in got if r.n_chars == 3]


def test_a_small_sketch_fails_and_a_larger_one_recovers(spark):
    a, b = [f"p{i}" for i in range(60)], [f"p{i}" for i in range(30, 90)]
    df = spark.createDataFrame([("\n".join(a), "\n".join(b))], "a string, b string").select(digests(F.col("a")).alias("a"), digests(F.col("b")).alias("b"))
    at = lambda p: peel(subtract(sketch(F.col("a"), F.lit(p)), sketch(F.col("b"), F.lit(p))), F.lit(p))
    r = df.select(at(8).alias("low"), at(64).alias("high"), likeness(F.col("a"), F.col("b"), sketch(F.col("a"), F.lit(8)), sketch(F.col("b"), F.lit(8))).alias("near")).first()
    assert (r.low, r.high, r.near) == (None, 60, 0.5)


def test_empty_tables_and_clashes(spark, tmp_path):
    df = documents(spark, ["a"])
    assert op6_fingerprints(spark, save(df.limit(0), tmp_path)).count() == 0
    only = op6_fingerprints(spark, save(df, tmp_path)).first()
    assert (only.near_edited, only.near_next) == (1.0, 1.0)
    with pytest.raises(ValueError):
        fingerprints(df.withColumn("sketch", F.lit(1)))


def test_any_difference_is_found_and_what_cannot_be_peeled_is_compared(spark, monkeypatch):
    from brindle.llm import fingerprints as module

    sizes = [(0, 0, 0), (1, 0, 1), (0, 40, 40), (300, 3, 3), (20, 500, 10), (1500, 700, 650)]
    lines = [("\n".join(f"s{i}" for i in range(both)) + "".join(f"\na{i}" for i in range(a)), "\n".join(f"s{i}" for i in range(both)) + "".join(f"\nb{i}" for i in range(b)), both, a, b) for both, a, b in sizes]
    df = spark.createDataFrame(lines, "a string, b string, n int, x int, y int").select(digests(F.col("a")).alias("a"), digests(F.col("b")).alias("b"), "n", "x", "y")

    def near():
        cells = [sketch(F.col(c), F.lit(8)) for c in "ab"]
        return [(r.near, 2 * r.n / (2 * r.n + r.x + r.y) if r.n + r.x + r.y else 1.0) for r in df.select(likeness(F.col("a"), F.col("b"), *cells).alias("near"), "n", "x", "y").collect()]

    for got, want in near():
        assert got == pytest.approx(want)
    monkeypatch.setattr(module, "peel", lambda cells, p: F.lit(None).cast("int"))
    for got, want in near():
        assert got == pytest.approx(want)
