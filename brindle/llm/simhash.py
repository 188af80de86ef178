"""SimHash near-duplicates, found by vantage-point trees over shards of fingerprints.

Each text's shingles vote on every bit of its fingerprint. Texts with one fingerprint become one node at
once (combined before the shuffle), so that copies cost nothing further. Links join nodes whose fingerprints
differ in at most radius bits.

Small radii: a forest of radius + 1 trees. Tree j parts the nodes by the Hamming distance within block j of
the bits, at radius 0: any linked pair agrees in a block (pigeonhole), so that the trees' shards, of about
SHARD_ROWS nodes and of several values of the block each, hold every linked pair without overlap. A shard that
one value makes larger than HEAVY_ROWS is parted on by the distances from two vantage points, in rings of
radius + 1, and rows within radius of a ring's inner boundary also go to the ring inside: linked pairs, whose
distances from a vantage point differ by radius at most (triangle bound), meet in the inner ring of either.

Large radii (where blocks part nothing): two texts alike share most shingles. A node goes to a shard for each
of MINS least shingle hashes under as many permutations; at a Jaccard index of 0.6 a pair meets nowhere with a
probability of 0.4 to the twelfth, 2 in 100,000. A shard of more than HEAVY_ROWS nodes (a passage that many
texts share) is parted on by each other least hash, and where that leaves as many, into groups of which every
two meet: all its pairs are compared, by tasks of bounded size.

A shard is searched by a vantage-point tree on the whole fingerprints: a vantage point splits the rest at the
median distance, rows within radius of the boundary are also looked up from the other side, and all else is
pruned by the triangle bound. A shard emits a spanning forest of its links, never its pairs, and the links are
closed by connected components.

Null and empty texts have the fingerprint zero, linked like any other. Rows are never dropped: copies of a
row each appear in the result. Nodes are fingerprints: rows of one doc_id with unlike texts stay apart, and rows
without a doc_id link others, but name no component; a component of such rows alone has a null id. An empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, connected_components, small, small_batches, table

SEED = 42
#: Shards up to this size are compared as they are: the leaves of the vantage-point trees.
LEAF = 64
#: Nodes of a shard on average, and nodes beyond which a shard is parted on.
SHARD_ROWS, HEAVY_ROWS = 2048, 8192
#: Least hashes of a text's shingles that near-duplicates at large radii meet by.
MINS = 12
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, MINS, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, width: int, seeds: tuple[int, ...] = (SEED,), wide: bool = False) -> np.ndarray:
    """XXH64 (wide: 128-bit XXH3) of each shingle of width words (fewer words: of all) for each seed, as big-endian bytes."""
    digest, size = (xxhash.xxh3_128_digest, 16) if wide else (xxhash.xxh64_digest, 8)
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, size * len(seeds)), np.uint8)
    line = b" ".join(words)
    if len(words) <= width:
        pieces = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-width] + 1])
        pieces = [line[a:b] for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.stack([np.frombuffer(b"".join([digest(p, s) for p in pieces]), np.uint8).reshape(-1, size) for s in seeds], 1).reshape(len(pieces), -1)


def n_words(seeds: tuple[int, ...], wide: bool) -> int:
    """64-bit words of a fingerprint."""
    return len(seeds) * (2 if wide else 1)


def _voted(hashes: np.ndarray, words: int) -> list[int]:
    if not len(hashes):
        return [0] * words
    votes = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 200):  # few enough to be summed in bytes
        votes += np.unpackbits(hashes[at : at + 200], axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(">i8").tolist()


def fingerprint(text: str | None, width: int = 3, seeds: tuple[int, ...] = (SEED,), wide: bool = False) -> list[int]:
    """Signed 64-bit words; a bit is 1 if it is set in over half of the shingles' hashes."""
    return _voted(shingle_hashes(text, width, seeds, wide), n_words(seeds, wide))


def least_hashes(hashes: np.ndarray) -> list[int]:
    """The least of the shingles' hashes under each of MINS permutations; zeros if there are none."""
    if not len(hashes):
        return [0] * MINS
    x = np.ascontiguousarray(hashes[:, :8]).view("<u8")
    least = np.full(MINS, np.iinfo(np.uint64).max)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (x[at : at + 4096] * _ODD).min(0))
    return least.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 3, seeds: tuple[int, ...] = (SEED,), wide: bool = False) -> DataFrame:
    """(doc_id, f0, f1, ..., and, if wide, mins) of docs(doc_id, text), one row per row."""
    n = n_words(seeds, wide)
    names = [f"f{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, mins = np.zeros((batch.num_rows, n), np.int64), []
            for i, t in enumerate(batch.column("text")):
                hashes = shingle_hashes(t.as_py(), width, seeds, wide)
                found[i] = _voted(hashes, n)
                if wide:
                    mins.append(least_hashes(hashes))
            more = [pa.array(mins, pa.list_(pa.int64()))] if wide else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[:, i]) for i in range(n)), *more], ["doc_id", *names, *(["mins"] if wide else [])])

    schema = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names), *(["mins array<long>"] if wide else [])])
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class _Sets:
    """Disjoint sets of 0 .. n - 1, each named by its least member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while (above := self.parent[up], (above != up).any())[1]:
            up = above
        self.parent[x] = up
        return up

    def join(self, x: int, others: np.ndarray) -> None:
        roots = self.roots(np.append(others, x))
        self.parent[roots] = roots.min()


def tree_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as index pairs, of the links among prints (n, words of uint64)."""
    sets, nobody = _Sets(len(prints)), np.zeros(0, np.int64)
    todo = [(np.arange(len(prints)), nobody)]  # rows to be linked with one another and with guests
    while todo:
        home, guests = todo.pop()
        if len(home) <= LEAF:
            others = np.concatenate([home, guests])
            for i in range(len(home)):
                rest = others[i + 1 :]
                hits = rest[_distance(prints[home[i]], prints[rest]) <= radius]
                if len(hits):
                    sets.join(int(home[i]), hits)
            continue
        vantage, home = home[0], home[1:]
        near, far = _distance(prints[vantage], prints[home]), _distance(prints[vantage], prints[guests])
        sets.join(int(vantage), np.concatenate([home[near <= radius], guests[far <= radius]]))
        bound = int(np.median(near)) + (near.min() == int(np.median(near)))
        inside = near < bound
        # A linked pair's distances from the vantage point differ by radius at most.
        todo.append((home[inside], np.concatenate([guests[far < bound + radius], home[~inside & (near < bound + radius)]])))
        todo.append((home[~inside], guests[far >= bound - radius]))
    least = sets.roots(np.arange(len(prints)))
    child = np.flatnonzero(least != np.arange(len(prints)))
    return child, least[child]


def _stars(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The links (x, y) among 0 .. n - 1 as stars."""
    # Each row takes the least number that its links lead to; a star around that row stands for all pairs.
    least = np.arange(n)
    while len(x):
        before = least.copy()
        np.minimum.at(least, y, least[x])
        np.minimum.at(least, x, least[y])
        least = least[least]
        if (before == least).all():
            break
    child = np.flatnonzero(least != np.arange(n))
    return child, least[child]


def _shard_links(key: np.ndarray, prints: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the runs of equal key."""
    edge = np.flatnonzero(np.diff(key)) + 1
    start, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    length = np.repeat(end - start, end - start)
    a, b = [], []
    small = np.flatnonzero(length <= LEAF)
    k, p = key[small], prints[small]
    pairs = []
    for step in range(1, int(length[small].max(initial=0))):
        left = np.flatnonzero(k[step:] == k[:-step])
        if not len(left):
            break
        pairs.append((left := left[_distance(p[left], p[left + step]) <= radius], left + step))
    x, y = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    child, least = _stars(x, y, len(small))
    a.append(node[small[child]])
    b.append(node[small[least]])
    for s, e in zip(start.tolist(), end.tolist(), strict=True):
        if e - s > LEAF:
            x, y = tree_links(prints[s:e], radius)
            a.append(node[s:e][x])
            b.append(node[s:e][y])
    return np.concatenate(a), np.concatenate(b)


def _linked(dealt: DataFrame, words: int, radius: int) -> DataFrame:
    """(a, b): links that span the groups of each shard of dealt(shard, f0, ..., node)."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal kept, held
            key, prints, node = (np.concatenate(x) for x in zip(*kept, strict=True))
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            kept, held = ([(key[cut:], prints[cut:], node[cut:])] if cut < len(key) else []), len(key) - cut
            if not cut:
                return None
            a, b = _shard_links(key[:cut], prints[:cut], node[:cut], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("shard", *names, "node")}
            kept.append((c["shard"], np.stack([c[n] for n in names], 1).astype(np.int64).view(np.uint64), c["node"]))
            held += batch.num_rows
            if held >= 50_000 and (out := flush(False)) is not None:
                yield out
        if kept and (out := flush(True)) is not None:
            yield out

    return dealt.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, words: int, radius: int, shard_rows: int = SHARD_ROWS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(a, b) of nodes(node, f0, ...) that differ in at most radius bits: links that span each shard's groups.

    There are radius + 1 blocks, which miss no pair.
    """
    bits, blocks, names = 64 * words, radius + 1, [f"f{i}" for i in range(words)]
    shards = max(1, -(-nodes.count() // shard_rows))
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    masks = [list(range(x, y)) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def value(mask: list[int]):
        parts = [F.col(f"f{w}").bitwiseAND(m) for w in range(words) if (m := _signed(sum(1 << (b % 64) for b in mask if b // 64 == w)))]
        return F.struct(F.lit(mask[0]).alias("block"), F.pmod(F.xxhash64(F.lit(mask[0]), *parts), F.lit(shards)).alias("of"))

    dealt = nodes.select(F.explode(F.array(*map(value, masks))).alias("cell"), *names, "node")
    prints = F.struct(*names)
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min(prints).alias("v0"), F.max(prints).alias("v1"))
    heavy = small(sizes.where(F.col("n") > heavy_rows).drop("n"))
    met = dealt.join(heavy, "cell", "left")

    def rings(vantage: str):
        """The ring of a row's distance from a vantage point, and the one inside it if its rows may be linked."""
        far = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(vantage)[n])) for n in names), F.lit(0))
        ring = F.floor(far / (radius + 1))
        return F.when(F.col(vantage).isNull(), F.array(F.lit(0).cast("long"))).when((far % (radius + 1) < radius) & (ring > 0), F.array(ring, ring - 1)).otherwise(F.array(ring))

    parted = met.withColumn("r0", F.explode(rings("v0"))).withColumn("r1", F.explode(rings("v1")))
    return _linked(parted.select(F.xxhash64("cell", "r0", "r1").alias("shard"), *names, "node"), words, radius)


def wide_links(nodes: DataFrame, words: int, radius: int, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """The same for large radii, of nodes(node, f0, ..., mins) that have a least shingle hash in common."""
    names = [f"f{i}" for i in range(words)]

    def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows(shard, mins, ...) of shards that are small enough, and the others, with n."""
        heavy = rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > heavy_rows)
        met = rows.join(small(heavy), "shard", "left")
        return met.where("n is null").drop("n"), met.where("n is not null")

    by = lambda *more: F.transform("mins", lambda x, i: F.xxhash64(*more, i, x))
    once, many = parted(nodes.select(F.explode(by()).alias("shard"), "mins", *names, "node"))
    twice, many = parted(many.select(F.explode(by(F.col("shard"))).alias("shard"), "mins", *names, "node"))
    # What shares two least hashes with so many is met group by group: a row goes to each pair that its group is of.
    groups = F.ceil(2 * F.col("n") / heavy_rows).cast("int")
    own = many.withColumn("groups", groups).withColumn("own", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    every = own.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    thrice = every.select(F.xxhash64("shard", F.least("g", "own"), F.greatest("g", "own")).alias("shard"), *names, "node")
    return _linked(once.drop("mins").unionByName(twice.drop("mins")).unionByName(thrice), words, radius)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grouped(docs: DataFrame, width: int = 3, radius: int = 3, seeds: tuple[int, ...] = (SEED,), wide: bool = False) -> DataFrame:
    """(doc_id, f0, ..., component_id) of docs(doc_id, text); the smallest doc_id reachable by links."""
    n = n_words(seeds, wide)
    names = [f"f{i}" for i in range(n)]
    prints = checkpointed(fingerprints(docs, width, seeds, wide))
    known = prints.groupBy(*names).agg(F.min("doc_id").alias("least"), *([F.min("mins").alias("mins")] if wide else []))
    # Numbers rise with the nodes' smallest doc_id, those without any last; kept, so that they are given only once.
    order = [F.col("least").asc_nulls_last(), *names]
    nodes = checkpointed(known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    found = connected_components((wide_links if wide else links)(nodes, n, radius))
    first = nodes.join(found.where("node = component").select("node"), "node", "left_semi").select(F.col("node").alias("component"), F.col("least").alias("named"))
    named = found.join(small(first), "component").select("node", "named")
    linked = nodes.join(named, "node", "left").select(*names, F.when(F.col("named").isNull(), F.col("least")).otherwise(F.col("named")).alias("component_id"))
    return prints.join(linked, names).select("doc_id", *names, "component_id")


#: Wide fingerprints: 256 bits, of two seeds.
WIDE_SEEDS = (42, 43)


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, f0, ..., f3, component_id): groups of texts whose fingerprints agree in similarity of their bits."""
    return grouped(docs, width, int(64 * n_words(WIDE_SEEDS, True) * (1 - similarity) + 1e-9), WIDE_SEEDS, True)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without those that near_groups places in a group with a smaller doc_id; all columns stay.

    Rows of one doc_id stay or go together; rows without a doc_id stay.
    """
    groups = near_groups(docs)
    gone = groups.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: the fingerprint of its text and the smallest doc_id that links lead to."""
    found = grouped(table(spark, sf_dir, "documents", spread="doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
