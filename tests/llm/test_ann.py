import numpy as np
import pytest

from brindle.llm.ann import Index, op7_ann, search

from .helpers import save

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, extra=()):
    return spark.createDataFrame([*((i, [float(c) for c in v], 0) for i, v in enumerate(x)), *extra], SCHEMA)


def brute(x, ids, i, k=20):
    score = (x * x[i]).sum(1)
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_against_brute_force(spark, tmp_path, scaled):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 24)).astype(np.float32)
    if scaled:
        x *= r.uniform(0.2, 3, size=(3000, 1)).astype(np.float32)
    got = op7_ann(spark, save(frame(spark, x), tmp_path, "embeddings")).toPandas()
    x, ids, hits = x.astype(float), np.arange(3000), 0
    assert sorted(got.query_id.unique()) == list(range(0, 3000, 20))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, (x[g.vec_id] * x[q]).sum(1), rtol=1e-12)
        hits += len(set(g.vec_id) & {v for v, _ in brute(x, ids, q)})
    assert hits / len(got) >= 0.9


def test_vectors_that_take_no_part_and_ties(spark):
    x = np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0], [0.5, 0.5, 0]])
    odd = [(20, None, 1), (40, [0.0, 0.0, 0.0], 1), (60, [1.0, None, 0.0], 1), (80, [float("nan"), 0.0, 0.0], 1), (100, [float("inf"), 0.0, 0.0], 1), (120, [1.0], 1), (None, [1.0, 0.0, 0.0], 1), (140, [], 1)]
    df = frame(spark, x, odd)
    got = [tuple(r) for r in search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 4, 0.5), (0, 4, 2, 0.0)]
    assert search(df.limit(0), df.limit(0)).count() == 0 and search(df, df.limit(0)).count() == 0


def test_copies_of_one_vector_fill_the_ranks_by_id(spark):
    x = np.vstack([np.tile([[0.6, 0.8, 0, 0]], (200, 1)), np.random.default_rng(1).normal(size=(200, 4)) * 0.1])
    df = frame(spark, x)
    got = search(df, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_probing_retrieves_every_code_within_the_radius():
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (2000, 4), dtype=np.uint8)
    index = Index(codes)
    for radius in range(0, 33, 3):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[7]).sum(1) <= radius)
        assert (index.within(codes[7], radius) == want).all()


def test_probing_by_values_and_through_the_index_find_the_same():
    r = np.random.default_rng(7)
    codes = (r.integers(0, 65536, (300, 16), dtype=np.uint16))[r.integers(0, 300, 40_000)] ^ (r.integers(0, 2, (40_000, 16), dtype=np.uint16) << r.integers(0, 16, (40_000, 16), dtype=np.uint16))
    index = Index(codes)
    for radius in (0, 10, 15, 16, 31, 50, 120):
        want = np.flatnonzero(np.bitwise_count(codes ^ codes[3]).sum(1) <= radius)
        assert (index.within(codes[3], radius) == want).all()


def test_repeated_query_rows_each_get_all_ranks_and_find_each_other(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 8)).astype(np.float32)
    own = [float(v) for v in x[20]]
    other = [float(v) for v in r.normal(size=8).astype(np.float32)]
    extra = [(20, own, 9), (20, own, 0), (20, other, 0), (7, own, 0)]
    df = frame(spark, x, extra)
    got = op7_ann(spark, save(df, tmp_path, "embeddings")).collect()
    rows = [(i, v) for i, v in enumerate(x.astype(float))] + [(i, np.array(v)) for i, v, _ in extra]
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((-float((w * v).sum()), i) for b, (i, w) in enumerate(rows) if b != a)[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert len(got) == len(want) == 6 * 20
    for g, w in zip(sorted(map(tuple, got)), sorted(want), strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-12


def test_codes_checked_whole_are_those_that_probing_finds():
    r = np.random.default_rng(7)
    for parts in (1, 3, 16):
        codes = r.integers(0, 1 << 16, size=(700, parts)).astype(np.uint16)
        index = Index(codes)
        for radius in (0, 2, 5 * parts, 8 * parts, 16 * parts):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[3]).sum(1) <= radius)
            assert index._checked(codes[3], radius).tolist() == index.within(codes[3], radius).tolist() == want.tolist()
    assert index.prunes(2) and not index.prunes(100)
