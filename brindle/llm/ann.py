"""Approximate nearest neighbours by largest inner product: multi-index hashing of learned binary codes.

Learning: on a sample of at most about FIT_ROWS rows, vectors are lengthened by one component that gives
all of them the greatest norm (so that the largest inner product is the smallest angle), and orthogonal
rotations are learned that bring them closest to the corners of a cube (iterative quantisation, from several
starts). The signs after the rotations, one after another, are the code of up to BITS bits. The radius is the
least at which the codes of the sample's own nearest neighbours hold RADIUS_RECALL of them; neighbours among
all rows are nearer than among the sample, so that the recall on the table is higher than that.

Index: every row. Codes are cut into substrings of 16 bits, each with an index of its own from value to
rows. Search: of a radius R shared out over m substrings, each code within R of the query's has at least one
substring within its part of R (pigeonhole), so that probing every index to that part retrieves every
code within R; an index is probed value by value, or, where it has fewer values than there are to probe, by
going through its values. What is met is checked on the whole code and then ranked by the exact inner
product in double precision. Where fewer rows than asked for lie within R, R grows until enough do.

The stated queries meet all rows in blocks of fixed bytes, one task per pair of a row block and a query block,
and k rows per query and row block to be merged. Rows that agree in vec_id and vector are one candidate with
a count, and one query with a count, before anything is dealt; rows are dealt by a hash of both, so that
neither copies of one vector nor rows of one vec_id make a task larger.

Every row but the query's own is a candidate, rows that are equal to it or share its vec_id included. Equal
query rows each get their ranks. Vectors that are null, zero, of null or non-finite components, without a
vec_id, or not of the table's commonest length, take no part. Ties go to the smaller vec_id. An empty table
gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import table

FIT_ROWS, RADIUS_RECALL = 10_000, 0.98
#: Bits of a code at most, of one rotation at most, of a substring; steps of learning a rotation, and rotations at most.
BITS, WIDTH, PART, STEPS, ROTATIONS = 256, 64, 16, 25, 8
#: Bytes of the vectors of a row block and of a query block, and row blocks at least.
ROW_BYTES, QUERY_BYTES, LEAST_BLOCKS = 16 << 20, 4 << 20, 16


@dataclass
class Codes:
    """The learned code: vectors are scaled to norm, rotated and cut at zero."""

    norm: float
    rotation: np.ndarray
    radius: int = 0

    def _cut(self, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        bits = np.column_stack([x, rest]) @ self.rotation > 0
        whole = np.zeros((len(x), -(-bits.shape[1] // PART) * PART), bool)
        whole[:, : bits.shape[1]] = bits
        return np.packbits(whole, axis=1).view(np.uint16)

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._cut(x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0)))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        return self._cut(x, np.zeros(len(x)))


def inner_products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, summed in an order that depends on the row alone."""
    return (rows * query).sum(1)


def _rotation(flat: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A rotation that brings the rows of flat close to the corners of a cube."""
    turn = np.linalg.qr(rng.normal(size=(flat.shape[1], flat.shape[1])))[0]
    for _ in range(STEPS):
        u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ v).T
    return turn


def learn(x: np.ndarray, norm: float, k: int, bits: int = BITS) -> Codes:
    """Codes for the sample x (n, d); norm: at least the greatest of any row."""
    rng = np.random.default_rng(5)
    z = np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))]) / norm
    width = min(WIDTH, z.shape[1])
    _, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, ::-1][:, :width]
    codes = Codes(norm, np.column_stack([axes @ _rotation(z @ axes, rng) for _ in range(min(ROTATIONS, max(1, bits // width)))]))
    some = rng.permutation(len(x))[:300]
    rows, queries = codes.of_rows(x), codes.of_queries(x[some])
    apart = []
    for i, q in zip(some.tolist(), queries, strict=True):
        score = inner_products(x, x[i])
        score[i] = -np.inf
        best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
        apart.append(np.bitwise_count(rows[best] ^ q).sum(1))
    codes.radius = int(np.quantile(np.concatenate(apart), RADIUS_RECALL)) if len(x) > 1 else PART * rows.shape[1]
    return codes



@lru_cache
def _ball(bits: int, radius: int) -> np.ndarray:
    """The substrings of so many bits in all and at most radius of them set: what is probed around a value."""
    every = np.arange(1 << bits, dtype=f"u{bits // 8}")
    return every[np.bitwise_count(every) <= radius]


class Index:
    """A multi-index of one block of codes (n, m) of m substrings: for each, its values and the rows of each value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = np.ascontiguousarray(codes)
        # The same codes in words of 64 bits, word by word.
        bits = np.ascontiguousarray(self.codes).view(np.uint8)
        whole = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
        whole[:, : bits.shape[1]] = bits
        self.words = np.ascontiguousarray(whole.view(np.uint64).T)
        self.parts = []
        for j in range(codes.shape[1]):
            values, of_row = np.unique(codes[:, j], return_inverse=True)
            order = np.argsort(of_row, kind="stable")
            self.parts.append((values, order, np.searchsorted(of_row[order], np.arange(len(values) + 1)), of_row))

    def prunes(self, radius: int) -> bool:
        """Whether the values to be probed are fewer than the rows in all; where they are not, whole codes are checked at once."""
        m, bits = self.codes.shape[1], 8 * self.codes.itemsize
        cost = 0
        for j, (values, *_) in enumerate(self.parts):
            part = min((radius + 1) // m + (j < (radius + 1) % m) - 1, bits)
            if part >= 0:
                ball = len(_ball(bits, part))
                cost += ball if ball < len(values) else len(self.codes)
        return cost < len(self.codes)

    def _checked(self, code: np.ndarray, radius: int) -> np.ndarray:
        asked = np.zeros(8 * len(self.words), np.uint8)
        asked[: code.nbytes] = np.ascontiguousarray(code).view(np.uint8)
        apart = np.zeros(len(self.codes), np.uint16)
        for words, word in zip(self.words, asked.view(np.uint64), strict=True):
            apart += np.bitwise_count(words ^ word)
        return np.flatnonzero(apart <= radius)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers, ascending, of all codes within radius of code."""
        m, bits = self.codes.shape[1], 8 * self.codes.itemsize
        if not self.prunes(radius):
            return self._checked(code, radius)
        met = np.zeros(len(self.codes), bool)
        for j, (values, order, start, of_row) in enumerate(self.parts):
            # Parts r_j with sum(r_j + 1) = radius + 1: a code beyond all of them is beyond the radius.
            part = min((radius + 1) // m + (j < (radius + 1) % m) - 1, bits)
            if part < 0:
                continue
            ball = _ball(bits, part)
            if len(ball) < len(values):
                probe = ball ^ code[j]
                at = np.minimum(np.searchsorted(values, probe), len(values) - 1)
                for v in at[values[at] == probe].tolist():
                    met[order[start[v] : start[v + 1]]] = True
            else:
                met |= (np.bitwise_count(values ^ code[j]) <= part)[of_row]
        found = np.flatnonzero(met)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1) <= radius]


def best_of(index: Index, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray, query_id: int, query: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, scores, copies) of the best rows within radius, or within the least radius that holds k, until k are counted."""
    # Of the rows that equal the query's, one is its own.
    own = np.flatnonzero(ids == query_id)
    own = own[(rows[own] == query).all(1)]
    if len(own):
        copies = copies.copy()
        copies[own] -= 1
    bits, others = PART * index.codes.shape[1], int(copies.sum())
    while True:
        found = index.within(code, radius)
        found = found[copies[found] > 0]
        if copies[found].sum() >= min(k, others) or radius >= bits:
            break
        radius = min(bits, radius + 2)
    score = inner_products(rows[found], query)
    if len(found) > k:
        floor = -np.partition(-score, k - 1)[k - 1]
        found, score = found[score >= floor], score[score >= floor]
    order = np.lexsort((ids[found], -score))
    n = copies[found][order]
    order = order[np.cumsum(n) - n < k]
    return ids[found][order], score[order], copies[found][order]


def usable(vectors: DataFrame) -> DataFrame:
    """The rows of vectors(vec_id, embedding) that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _counted(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, copies): the distinct rows that take part."""
    return usable(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for every row of queries, both (vec_id, embedding).

    One row of vectors that is equal to the query's, if there is any, is the query's own and no candidate.
    """
    lengths = usable(vectors).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, norm = lengths["d"], lengths["n"], math.sqrt(lengths["m"])
    rows, asked = _counted(vectors).where(F.size("v") == width), _counted(queries).where(F.size("v") == width)
    share = min(1.0, FIT_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy("vec_id", F.xxhash64("v")).select("v").toArrow()
    codes = learn(_matrix(sample.column("v"), width), norm, k)
    row_blocks = max(LEAST_BLOCKS, math.ceil(n * width * 8 / ROW_BYTES))
    query_blocks = max(1, math.ceil(asked.count() * width * 8 / QUERY_BYTES))
    mine = lambda blocks: F.pmod(F.xxhash64("vec_id", "v", F.lit(3)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select(mine(row_blocks).alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"), "vec_id", "v", "copies", F.lit(0).cast("long").alias("q"))
    dealt = dealt.union(asked.select(every(row_blocks).alias("rb"), mine(query_blocks).alias("qb"), F.lit(True).alias("asks"), "vec_id", "v", "copies", F.xxhash64("vec_id", "v").alias("q")))
    names = ["query_id", "q", "turns", "vec_id", "score", "copies"]
    kinds = [np.int64, np.int64, np.int64, np.int64, np.float64, np.int64]

    def block(data: pa.Table) -> pa.Table:
        asks = data.column("asks").to_numpy()
        ids, copies, key, v = data.column("vec_id").to_numpy(), data.column("copies").to_numpy(), data.column("q").to_numpy(), _matrix(data.column("v"), width)
        own, x, held, wanted, q = ids[~asks], v[~asks], copies[~asks], ids[asks], v[asks]
        out: list[tuple] = [tuple(np.zeros(0, t) for t in kinds)]
        if len(own) and len(wanted):
            index = Index(codes.of_rows(x))
            for i, (name, hashed, turns, code) in enumerate(zip(wanted.tolist(), key[asks].tolist(), copies[asks].tolist(), codes.of_queries(q), strict=True)):
                best, score, n = best_of(index, own, x, held, name, q[i], code, codes.radius, k)
                out.append((np.full(len(best), name), np.full(len(best), hashed), np.full(len(best), turns), best, score, n))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names)

    found = dealt.groupBy("rb", "qb").applyInArrow(block, "query_id long, q long, turns long, vec_id long, score double, copies long")
    before = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0))).where(F.col("before") < k)
    ranked = placed.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("copies"), F.lit(k)))))
    return ranked.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), "turns"))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each row of embeddings whose vec_id is divisible by 20; see above for odd rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
