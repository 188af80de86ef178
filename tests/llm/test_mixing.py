import re
from collections import defaultdict

from brindle.llm.mixing import BLOCK_TOKENS, op10_mixing, plan, remix

from .helpers import AWKWARD, documents, save


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weight[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def corpus(spark):
    texts = [*(" ".join(f"w{j}" for j in range(1 + i * 37 % 400)) for i in range(300)), *AWKWARD]
    kind = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"Z{i % 5}é"
    return texts, kind, documents(spark, texts, extra="size", source=kind)


def test_sizes_targets_and_takings(spark, tmp_path):
    texts, kind, df = corpus(spark)
    got = {r.doc_id: r for r in op10_mixing(spark, save(df, tmp_path)).collect()}
    assert len(got) == len(texts)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    by_source, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        by_source[kind(i)] += n
        taken[kind(i)] += got[i].taken
    want = brute_targets(by_source)
    for i, r in got.items():
        assert (r["size"], r.source_size) == (size[i], by_source[kind(i)])
        assert abs(r.target - want[kind(i)]) < 1e-6 * max(1, want[kind(i)])
        assert 0 <= r.taken <= 2 * size[i]
    for s in by_source:
        assert abs(taken[s] - want[s]) <= 3 * BLOCK_TOKENS
    again = {r.doc_id: r.taken for r in op10_mixing(spark, str(tmp_path)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_every_stretch_of_the_schedule_holds_the_sources_in_proportion(spark):
    _, _, df = corpus(spark)
    _, sources, schedule = plan(df, block_tokens=16)
    slots = sorted(schedule.collect(), key=lambda r: r.slot)
    share = {r.id: r.slots for r in sources.collect()}
    assert len(slots) == sum(share.values())
    seen = defaultdict(int)
    for i, r in enumerate(slots):
        assert r["rank"] == seen[r.id]
        seen[r.id] += 1
        assert abs(seen[r.id] - (i + 1) * share[r.id] / len(slots)) < 2 * len(slots).bit_length()


def test_rows_are_repeated_whole(spark):
    texts, kind, df = corpus(spark)
    df = df.withColumnsRenamed({"size": "place"}).withColumns({"turn": df.doc_id, "turns": df.doc_id, "id": df.doc_id})
    out = remix(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert all(r.text == texts[r.doc_id] and r.text.split() and r.place == str(r.doc_id) and r.turn == r.doc_id for r in rows)
    assert max(sum(r.doc_id == i for r in rows) for i in range(20)) <= 2
    words = sum(len(r.text.split()) for r in rows)
    total = sum(len((t or "").split()) for t in texts)
    assert abs(words - 1.5 * total) < 0.15 * total


def test_empty_tables_and_sources_without_words(spark, tmp_path):
    _, _, df = corpus(spark)
    assert op10_mixing(spark, save(df.limit(0), tmp_path)).count() == 0
    rows = op10_mixing(spark, save(documents(spark, [None, "", " "]), tmp_path)).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 3


def test_small_sources_come_as_near_their_targets_as_large_ones(spark, tmp_path):
    texts = [" ".join(f"w{j}" for j in range(1 + i % 5)) for i in range(300)] + [" ".join(["much"] * 200)] * 60 + ["one"]
    kind = lambda i: f"s{i // 10:02d}" if i < 300 else "big" if i < 360 else None
    got = {r.doc_id: r for r in op10_mixing(spark, save(documents(spark, texts, source=kind), tmp_path)).collect()}
    size, taken = defaultdict(int), defaultdict(int)
    for i, t in enumerate(texts):
        size[kind(i)] += len(t.split())
        taken[kind(i)] += got[i].taken
        assert got[i].taken <= 2 * got[i]["size"]
    want = brute_targets(size)
    assert len(want) == 32
    for s in want:
        assert abs(taken[s] - want[s]) <= max(1.0, want[s] / 64), s


def test_thirty_sources_of_thirty_words(spark, tmp_path):
    texts = ["five words are in here"] * 180 + [None, "", "five words are in here"]
    got = op10_mixing(spark, save(documents(spark, texts, source=lambda i: f"s{i % 30:02d}" if i < 180 else "s00"), tmp_path)).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.target] += r.taken
    assert abs(sum(r.taken for r in got) - 1.5 * 905) <= 30 and all(v for v in taken.values())
