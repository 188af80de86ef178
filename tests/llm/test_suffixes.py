import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm.suffixes import dedup, op1_suffixes, ranks

from .helpers import AWKWARD, documents, save


def brute(rows):
    """{row: (n_bytes, n_removed, n_spans, kept)} of rows (doc_id, text)."""
    first = {}
    for i, text in rows:
        b = (text or "").encode()
        for at in range(len(b) - 49):
            first[b[at : at + 50]] = min(i, first.get(b[at : at + 50], i))
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for at in range(len(b) - 49):
            if first[b[at : at + 50]] < i:
                gone[at : at + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passages = [" ".join(word() for _ in range(r.randint(8, 60))) for _ in range(12)]
    texts = []
    for _ in range(160):
        t = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        for _ in range(r.randint(0, 2)):
            t.insert(r.randint(0, 3), r.choice(passages)[r.randint(0, 30) :])
        texts.append("|".join(t))
    near = [t[: len(t) // 2] + "x" + t[len(t) // 2 + 1 :] for t in texts[:20]]
    period = ["ab" * 400, "ba" * 333, "x" * 49, "x" * 50, "x" * 51, "y" * 3000, "z" + "y" * 1500]
    return [*texts, *near, *texts[:30], *texts[5:9] * 3, *period, *AWKWARD]


@pytest.mark.parametrize("hot", [2000, 2])
def test_removal_agrees_with_brute_force(spark, hot):
    texts = corpus()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumn("g", F.lit("clash")).repartition(5)
    found = dedup(df, hot=hot, group_bytes=9000, bucket_bytes=7000, array_bytes=1500).collect()
    got = sorted((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found)
    assert got == brute(list(zip(ids, texts, strict=True)))


def test_the_query_agrees_with_brute_force(spark, tmp_path):
    texts = corpus(3)
    got = sorted(tuple(r) for r in op1_suffixes(spark, save(documents(spark, texts, extra="spans"), tmp_path)).collect())
    assert got == brute(list(enumerate(texts)))


def test_equal_and_missing_ids(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away"
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (None, text + "!")], "doc_id long, text string")
    got = sorted((r.doc_id is None, len(r.kept)) for r in dedup(df).collect())
    assert got == [(False, len(text)), (False, len(text)), (True, 0), (True, 1)]


def test_an_empty_table(spark, tmp_path):
    assert op1_suffixes(spark, save(documents(spark, ["a"]).limit(0), tmp_path)).count() == 0
    assert [r.n_bytes for r in op1_suffixes(spark, save(documents(spark, [None, ""]), tmp_path)).collect()] == [0, 0]


def test_ranks_sort_suffixes_to_their_depth():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 4, 5, 50, 700):
        for letters in (1, 2, 4, 200):
            for share in (1, 0.3):
                text, wanted = r.integers(1, letters + 1, n), r.random(n) < share
                rank = ranks(text.astype(np.int64), 50, wanted)
                assert (rank[~wanted] == 0).all()
                order = np.flatnonzero(wanted)[np.argsort(rank[wanted], kind="stable")]
                heads = [bytes(text[i : i + 50].astype(np.uint8)) for i in order]
                assert heads == sorted(heads)


def removed(texts):
    """The bytes that go of each of texts, told by hashes of all windows."""
    least, own = {}, []
    for text in texts:
        b = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        h = np.zeros(max(0, len(b) - 49), np.uint64)
        for j in range(50):
            h = (h * np.uint64(0x100000001B3)) ^ (b[j : len(b) - 49 + j] * np.uint64(0x9E3779B97F4A7C15))
        own.append(h)
    out, seen = [], np.zeros(0, np.uint64)
    for h, text in zip(own, texts, strict=True):
        gone = np.zeros(len(text.encode()) + 1, np.int64)
        for at in [np.flatnonzero(np.isin(h, seen))]:
            np.add.at(gone, at, 1)
            np.add.at(gone, np.minimum(at + 50, len(gone) - 1), -1)
        out.append(int((np.cumsum(gone)[:-1] > 0).sum()))
        seen = np.union1d(seen, h)
    return out


def test_one_string_in_countless_contexts_of_few_documents(spark):
    r = np.random.default_rng(8)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    line = lambda: "2026-01-01T00:00 " + "".join(r.choice(letters, int(r.integers(30, 70))))
    first, second = [line() for _ in range(60_000)], [line() for _ in range(60_000)]
    for i in r.integers(0, 60_000, 700).tolist():
        second[i] = first[int(r.integers(60_000))]
    texts = ["\n".join(first), "\n".join(second)]
    assert len(texts[0]) > 4_000_000
    got = {x.doc_id: sum(s["end"] - s["start"] for s in x.spans) for x in dedup(documents(spark, texts)).collect()}
    assert [got[0], got[1]] == removed(texts) and got[1] > 30_000


def test_long_periodic_texts(spark):
    r = np.random.default_rng(9)
    period = "".join(r.choice(list("abcdef"), 211))
    texts = [period * 100_000, "x" * 300_000, "start " + period * 500 + " end", "y" + "x" * 1000 + "z"]
    got = {x.doc_id: sum(s["end"] - s["start"] for s in x.spans) for x in dedup(documents(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == removed(texts) == [0, 0, 500 * 211, 1000]


def test_an_array_beyond_the_names_is_refused():
    with pytest.raises(ValueError):
        ranks(np.ones(1 << 21, np.int64), 50, np.ones(1 << 21, bool))
