import pytest

from brindle.llm.sharding import Conflict, ShardStore, op4_sharding, shard

from .helpers import AWKWARD, documents, save


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_appends_and_compaction_keep_every_row(spark, tmp_path):
    df = documents(spark, [*(f"text {i} " * (i % 50) for i in range(400)), *AWKWARD, *AWKWARD], extra="_path")
    store = shard(df, f"file://{tmp_path}/a", arrivals=8, store_options={"small_bytes": 2000, "target_bytes": 60_000, "fanout": 3})
    assert rows(store.read()) == rows(df)
    assert not store.runs(store.shards())
    assert sum(s.rows for s in store.shards()) == df.count()
    assert max(s.bytes for s in store.shards()) < 2 * 60_000
    assert len(store.shards()) < 8


def test_versions_stay_readable_until_vacuum(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/b", small_bytes=2000, fanout=2)
    one, two = documents(spark, ["a", "b"]), documents(spark, ["c", None])
    assert (store.version(), store.read(), store.append(one), store.append(two)) == (0, None, 1, 2)
    store.compact(vacuum=False)
    assert rows(store.read(1)) == rows(one) and rows(store.read(2)) == rows(store.read()) == rows(one.union(two))
    store.vacuum()
    assert rows(store.read()) == rows(one.union(two))
    with pytest.raises(Exception):
        store.read(1)


def test_of_two_writers_one_wins(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/c")
    store.append(documents(spark, ["a"]))
    with pytest.raises(Conflict):
        store.commit(1, [])
    assert store.version() == 1 and len(store.shards()) == 1


def test_sizes_of_a_tier_are_merged_together(spark, tmp_path):
    from brindle.llm.sharding import Shard

    store = ShardStore(spark, f"file://{tmp_path}/d", target_bytes=1000, small_bytes=10, fanout=4)
    small, large = [Shard(f"s{i}", 1, 10) for i in range(9)], [Shard(f"l{i}", 1, 160) for i in range(3)]
    runs = store.runs([*small, *large, Shard("done", 1, 900)])
    assert [len(r) for r in runs] == [4, 4] and {s.bytes for r in runs for s in r} == {10}


def test_the_query_returns_every_document(spark, tmp_path):
    texts = ["some text"] * 30 + AWKWARD
    got = op4_sharding(spark, save(documents(spark, texts, extra="shard"), tmp_path)).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got) == [(i, len(t.encode()) if t is not None else None) for i, t in enumerate(texts)]
    assert op4_sharding(spark, save(documents(spark, ["a"]).limit(0), tmp_path)).count() == 0


def plain_merges(sizes, small, target, fanout):
    """Sets of names that a size-tiered plan merges, of {name: bytes}, told without the store."""
    tiers = {}
    for name, size in sizes.items():
        if 2 * size < target:
            tier = 0
            while size >= small * fanout ** (tier + 0.5):
                tier += 1
            tiers.setdefault(tier, []).append((size, name))
    out = []
    for members in tiers.values():
        run, total = [], 0
        for size, name in sorted(members):
            if run and (len(run) == fanout or total + size > target):
                out.append((run, len(run) == fanout or total + size > target))
                run, total = [], 0
            run.append(name)
            total += size
        out.append((run, len(run) == fanout))
    return {frozenset(run) for run, closed in out if closed and len(run) > 1}


def test_every_version_merges_what_a_plain_size_tiered_plan_does(spark, tmp_path):
    df = documents(spark, [f"text {i} " * (i % 90) for i in range(700)])
    store = ShardStore(spark, f"file://{tmp_path}/e", small_bytes=1500, target_bytes=20_000, fanout=3)
    store.ingest("a", df.repartition(5), 9, rows=12)
    first = store.version()
    assert first == 9 and store.arrivals() == {f"a/{i}" for i in range(9)}
    last = store.compact(vacuum=False)
    assert last > first
    for version in range(first, last):
        before, after = ({s.path: s for s in store.shards(v)} for v in (version, version + 1))
        runs = plain_merges({p: s.bytes for p, s in before.items()}, 1500, 20_000, 3)
        gone, new = set(before) - set(after), [after[p] for p in after if p not in before]
        assert gone == set().union(*runs) and len(new) == len(runs)
        assert sorted(s.rows for s in new) == sorted(sum(before[p].rows for p in run) for run in runs)
    assert not plain_merges({s.path: s.bytes for s in store.shards()}, 1500, 20_000, 3)
    assert rows(store.read()) == rows(df)


def test_an_ingest_that_died_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    df = documents(spark, [f"text {i}" for i in range(100)]).repartition(6)
    store, add = ShardStore(spark, f"file://{tmp_path}/f"), ShardStore._add

    def dies(self, name, new):
        if name == "x/3":
            raise OSError("lost")
        return add(self, name, new)

    monkeypatch.setattr(ShardStore, "_add", dies)
    with pytest.raises(OSError):
        store.ingest("x", df, 6)
    assert store.version() == 3 and store.read().count() < 100
    monkeypatch.setattr(ShardStore, "_add", add)
    for _ in range(2):
        store.ingest("x", df, 6)
        assert store.version() == 6 and rows(store.read()) == rows(df)


def test_a_writer_that_comes_second_commits_on_top(spark, tmp_path, monkeypatch):
    store, commit, busy = ShardStore(spark, f"file://{tmp_path}/g", small_bytes=2000, fanout=2), ShardStore.commit, []

    def late(self, version, shards, arrivals=None):
        if not busy:  # another writer is faster, once
            busy.append(True)
            ShardStore(spark, store.root).append(documents(spark, ["other"]))
        return commit(self, version, shards, arrivals)

    monkeypatch.setattr(ShardStore, "commit", late)
    store.append(documents(spark, ["a", "b"]))
    assert store.version() == 2 and sorted(r.text for r in store.read().collect()) == ["a", "b", "other"]
    busy.clear()
    store.compact(vacuum=False)
    assert sorted(r.text for r in store.read().collect()) == ["a", "b", "other", "other"]
    runs = [store.shards(2)]
    assert not store._replace(runs, [])  # its shards have been replaced already


def test_columns_may_be_named_like_the_stores_own(spark, tmp_path):
    df = documents(spark, ["a", None], extra="batch").selectExpr("*", "1 as path", "2 as run", "3 as _metadata", "4 as f", "5 as shard")
    store = shard(df, f"file://{tmp_path}/h", store_options={"fanout": 2})
    assert rows(store.read()) == rows(df) and store.read(columns=True).columns == [*df.columns, "_shard"]
