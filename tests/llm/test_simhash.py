import random
import re

import numpy as np
import xxhash

from brindle.llm.common import connected_components
from brindle.llm.simhash import drop_near_copies, fingerprint, near_groups, op9_simhash, tree_links

from .helpers import AWKWARD, documents, save


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3
    group, left = {}, set(prints)
    while left:
        todo = [first := min(left)]
        left.discard(first)
        while todo:
            x = todo.pop()
            group[x] = first
            found = {y for y in left if near(x, y)}
            left -= found
            todo += found
    return group


def corpus():
    r = random.Random(5)
    vocab = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(80)]
    near = [t.replace("w1", "w2", 1) for t in base for _ in range(2)]
    return [*base, *near, *base[:10], *AWKWARD, "one", "one two", "ONE\x0btwo", "a\x1cb c d"]


def test_the_query_agrees_with_brute_force(spark, tmp_path):
    texts = corpus()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_groups(prints)
    got = op9_simhash(spark, save(documents(spark, texts, extra="f0"), tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id]), texts[r.doc_id][:50]


def test_a_tree_finds_the_links_that_a_scan_finds():
    r = np.random.default_rng(2)
    core = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([core ^ np.uint64(1 << int(r.integers(64))) for _ in range(12)] + [r.integers(0, 1 << 63, 500, dtype=np.uint64)])[:, None]
    a, b = tree_links(prints, 3)
    label = list(range(len(prints)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        old, new = label[x], label[y]
        label = [new if v == old else v for v in label]
    want = brute_groups({i: int(p) for i, p in enumerate(prints[:, 0])})
    pairs = {}
    for i, v in enumerate(label):
        pairs.setdefault(v, min(j for j, w in enumerate(label) if w == v))
        assert pairs[v] == want[i]
    assert len(a) == len(prints) - len(set(label))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(9)
    own = [" ".join(f"v{r.randint(0, 5000)}" for _ in range(200)) for _ in range(30)]
    close = [t.replace(t.split()[60], "changed") for t in own[:10]]
    df = documents(spark, [*own, *close, *own[5:8], None], extra="f1")
    left = drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 43]
    assert drop_near_copies(df.limit(0)).count() == 0


def test_empty_texts_have_the_zero_fingerprint():
    assert fingerprint(None) == fingerprint(" \n") == [0]


def test_every_pair_at_the_radius_itself_is_found(spark):
    r = random.Random(12)
    texts = []
    for _ in range(120):
        words = [f"v{r.randint(0, 5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        for at in r.sample(range(200), r.randint(5, 9)):
            words[at] = "changed"
        texts.append(" ".join(words))
    prints = [sum((x & (1 << 64) - 1) << 64 * k for k, x in enumerate(fingerprint(t, 5, (42, 43), True))) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 51]
    assert sum((prints[a] ^ prints[b]).bit_count() >= 44 for a, b in pairs) > 20
    group = list(range(len(texts)))
    for a, b in pairs:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = [new if g == old else g for g in group]
    assert {x.doc_id: x.component_id for x in near_groups(documents(spark, texts)).collect()} == dict(enumerate(group))


def test_rows_without_an_id_link_others_and_ids_may_repeat(spark, tmp_path):
    from brindle.llm import simhash

    words = [f"w{i}" for i in range(60)]
    far = [" ".join(f"z{j}" for j in range(i, i + 30)) for i in (100, 200)]
    # A chain of texts whose ends are not linked: the middle ones have no doc_id.
    chain, prints = [" ".join(words)], [brute_print(" ".join(words))]
    r = random.Random(3)
    while len(chain) < 4:
        t = chain[-1].split()
        t[r.randrange(60)] = f"n{r.randrange(10**6)}"
        p = brute_print(" ".join(t))
        if 0 < (p ^ prints[-1]).bit_count() <= 3:
            chain.append(" ".join(t))
            prints.append(p)
    rows = [(1, far[0]), (1, far[1]), (9, chain[0]), (None, chain[1]), (None, chain[2]), (3, chain[3]), (None, "alone with no id at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.fingerprint, r.doc_id is None, r.component_id) for r in op9_simhash(spark, save(df, tmp_path)).collect())
    group = brute_groups({i: brute_print(t) for i, (_, t) in enumerate(rows)})
    least = {g: min((rows[i][0] for i in group if group[i] == g and rows[i][0] is not None), default=None) for g in set(group.values())}
    assert got == sorted((f"{brute_print(t):016x}", d is None, least[group[i]]) for i, (d, t) in enumerate(rows))
    assert least[group[2]] == 3 and simhash.grouped(df.limit(0)).count() == 0


def _closed(n, found):
    group = list(range(n))
    for a, b in found:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        if old != new:
            group = [new if g == old else g for g in group]
    return group


def test_heavy_shards_are_parted_by_rings_and_lose_no_link(spark):
    from brindle.llm.simhash import links

    r = np.random.default_rng(6)
    core = np.uint64(0x0123456789ABCDEF)
    near = [int(core ^ np.uint64(sum(1 << int(b) for b in r.choice(48, int(r.integers(0, 9)), replace=False)))) for _ in range(500)]
    prints = sorted({*near, *(int(x) for x in r.integers(0, 1 << 63, 300, dtype=np.uint64))})
    want = brute_groups(dict(enumerate(prints)))
    nodes = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, f0 long")
    for shard_rows, heavy_rows in ((2048, 8192), (100, 40), (30, 1)):
        found = [tuple(x) for x in links(nodes, 1, 3, shard_rows, heavy_rows).collect()]
        assert _closed(len(prints), found) == [want[i] for i in range(len(prints))]


def test_heavy_shards_of_wide_fingerprints_lose_no_link(spark):
    from brindle.llm.simhash import fingerprints, wide_links

    r = random.Random(8)
    passage = [f"common{i}" for i in range(40)]
    texts = [" ".join([*passage, *(f"own{r.randrange(10**6)}" for _ in range(r.randint(2, 60)))]) for _ in range(120)]
    texts += [t.replace("own1", "own2", 1) for t in texts[:60]]
    rows = fingerprints(documents(spark, texts), 5, (42, 43), True).withColumnRenamed("doc_id", "node").collect()
    prints = {x.node: np.array([x.f0, x.f1, x.f2, x.f3]).view(np.uint64) for x in rows}
    pairs = [(a, b) for a in prints for b in prints if a < b and np.bitwise_count(prints[a] ^ prints[b]).sum() <= 51]
    nodes = spark.createDataFrame(rows)
    assert len(pairs) > 60
    for heavy_rows in (8192, 50, 10):
        found = [tuple(x) for x in wide_links(nodes, 4, 51, heavy_rows).collect()]
        assert _closed(len(texts), found) == _closed(len(texts), pairs), heavy_rows
