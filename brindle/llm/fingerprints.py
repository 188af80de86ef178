"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame operations only.

A paragraph is a line, or a stretch of at most PIECE code points of a longer one; its digest is a hash of
KEY_BITS bits that carries CHECK_BITS of checksum. A sketch has three tables of p cells; each digest is added
to one cell of each: a count, and the exclusive or of the digests. Two sketches are subtracted cell by
cell, which leaves the digests that differ; a cell that holds exactly one (its checksum tells) is pure,
and removing its digest elsewhere makes more cells pure. Once all cells are empty, the removed digests
are the paragraphs that differ, and likeness is their complement: 1 - differing / (one's + other's).
Where peeling stops short, both versions are sketched again, larger: at a size taken from an estimate of the
difference, then by all digests. A pair at which each of these has failed (digests that share their bits, or
so many that a table's share of the key no longer spreads them) is compared digest by digest; only that pair's
row pays for it.

The next document, in descending doc_id, is found without gathering rows: keys alone are sorted by ranges,
and ranges are tied together by one row each.

Null texts count as empty. Likeness of two empty texts is 1, of an empty and another 0. A null doc_id sorts
after all others; equal doc_ids sort by the text's hash, and wholly equal rows follow one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, small, table

PIECE = 128
KEY_BITS, CHECK_BITS = 47, 16
#: Cells per table of the sketch that is the fingerprint, and the fewest of the last retries.
BASE, LEAST_SURE = 8, 256
#: Cells per table of the first retry for each digest that is thought to differ; 0.41 is the least that can be peeled.
MARGIN = 1.5
ROUNDS = 24


def digests(text: Column) -> Column:
    """The distinct digests of text's paragraphs, each with its checksum above its key."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))

    def digest(piece: Column) -> Column:
        key = F.xxhash64(piece).bitwiseAND((1 << KEY_BITS) - 1)
        return key.bitwiseOR(F.shiftleft(_checksum(key), KEY_BITS))

    return F.array_distinct(F.transform(pieces, digest))


def _checksum(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << CHECK_BITS) - 1)


def _at(digest: Column, which: int, p: Column) -> Column:
    """The cell of a digest in table which of three."""
    return F.pmod(F.shiftright(digest.bitwiseAND((1 << KEY_BITS) - 1), 15 * which), p).cast("int") + (p * which).cast("int")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once: what a lambda mentions is else evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cell(c: Column, n: Column, x: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), n.cast("int").alias("n"), x.cast("long").alias("x"))


def _added(cells: Column) -> Column:
    """Cells (number c, count n, exclusive or x) of one number added up; those that come to nothing go."""

    def runs(ordered: Column) -> Column:
        head = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["c"] != F.get(ordered, i - 1)["c"]))
        return _let(head, lambda h: F.filter(F.transform(h, lambda at, j: total(ordered, at, F.coalesce(F.get(h, j + 1), F.size(ordered)))), lambda e: (e["n"] != 0) | (e["x"] != 0)))

    def total(ordered: Column, at: Column, end: Column) -> Column:
        return F.aggregate(F.slice(ordered, at + 2, end - at - 1), F.get(ordered, at), lambda a, e: _cell(a["c"], a["n"] + e["n"], a["x"].bitwiseXOR(e["x"])))

    return _let(F.array_sort(cells), lambda ordered: F.when(F.size(ordered) == 0, ordered).otherwise(runs(ordered)))


def _dealt(digests_: Column, p: Column, sign) -> Column:
    """Three cells for each of digests_ (counts and digests), one in each table."""
    return F.flatten(F.transform(digests_, lambda d: F.array(*(_cell(_at(sign(d)[1], k, p), sign(d)[0], sign(d)[1]) for k in range(3)))))


def sketch(keys: Column, p: Column) -> Column:
    """The cells in use, of 3 p, of an array of digests; in order."""
    return _added(_dealt(keys, p, lambda d: (F.lit(1), d)))


def subtract(one: Column, other: Column) -> Column:
    return _added(F.concat(one, F.transform(other, lambda e: _cell(e["c"], -e["n"], e["x"]))))


def peel(cells: Column, p: Column) -> Column:
    """How many digests differ, from a subtracted sketch; null where peeling stops short."""

    def pure(e: Column) -> Column:
        key = e["x"].bitwiseAND((1 << KEY_BITS) - 1)
        own = F.floor(e["c"] / p).cast("int")
        place = F.when(own == 0, _at(e["x"], 0, p)).when(own == 1, _at(e["x"], 1, p)).otherwise(_at(e["x"], 2, p))
        return (F.abs(e["n"]) == 1) & (F.shiftright(e["x"], KEY_BITS) == _checksum(key)) & (place == e["c"])

    def step(state: Column, _: Column) -> Column:
        found = F.array_distinct(F.transform(F.filter(state["cells"], pure), lambda e: F.struct((-e["n"]).alias("n"), e["x"].alias("x"))))
        after = _let(found, lambda f: F.when(F.size(f) == 0, F.struct(state["cells"].alias("cells"), state["out"].alias("out"), F.lit(True).alias("stuck"))).otherwise(F.struct(_added(F.concat(state["cells"], _dealt(f, p, lambda q: (q["n"], q["x"])))).alias("cells"), (state["out"] + F.size(f)).alias("out"), F.lit(False).alias("stuck"))))
        return F.when(state["stuck"] | (F.size(state["cells"]) == 0), state).otherwise(after)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("out"), F.lit(False).alias("stuck"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.size(s["cells"]) == 0, s["out"]))


def difference(one: Column, other: Column, p: Column) -> Column:
    """The subtracted sketches of two arrays of digests, without either by itself: cells add up whatever their order."""
    signed = lambda keys, n: _dealt(keys, p, lambda d: (F.lit(n), d))
    return _added(F.concat(signed(one, 1), signed(other, -1)))


def estimate(cells: Column, apart: Column) -> Column:
    """About how many digests differ, of a subtracted sketch of BASE cells per table, from the squares of its counts.

    Where d digests differ, and the counts by apart, a table's squares add up to d + (apart ** 2 - d) / BASE on average.
    """
    squares = F.aggregate(cells, F.lit(0).cast("long"), lambda a, e: a + e["n"].cast("long") * e["n"]) / 3.0
    return F.greatest(apart.cast("double"), (squares - apart.cast("double") * apart / BASE) * (BASE / (BASE - 1)))


def likeness(one: Column, other: Column, one_sketch: Column, other_sketch: Column) -> Column:
    """0 to 1, of two arrays of digests and their sketches of BASE cells per table.

    The counts of those sketches tell about how many digests differ, and so whether it is worth peeling them, and
    the size of the next pair. Digests that no size has given are told by a plain comparison of both arrays.
    """
    total = F.size(one) + F.size(other)
    apart = F.abs(F.size(one) - F.size(other))
    base, sure = F.lit(BASE), F.greatest(F.lit(LEAST_SURE), total)

    def sound(found: Column) -> Column:
        # A sum of several digests that passes for one leads astray; what the counts rule out is a failure.
        return _let(found, lambda n: F.when((n >= apart) & (n <= total) & ((total - n) % 2 == 0), n))

    def tried(p: Column) -> Column:
        return sound(peel(difference(one, other, p), p))

    def found(cells: Column) -> Column:
        about = estimate(cells, apart)
        return _let(about, lambda d: F.coalesce(F.when(d <= 3 * BASE, sound(peel(cells, base))), _let((F.ceil(d * MARGIN) + BASE).cast("int"), tried), tried(sure), tried(2 * sure + 1), F.size(F.array_except(one, other)) + F.size(F.array_except(other, one))))

    return F.when(total == 0, 1.0).otherwise(F.lit(1.0) - _let(subtract(one_sketch, other_sketch), found).cast("double") / total)


def rendered(keys: Column, cells: Column) -> Column:
    """The fingerprint as text: the number of digests, then number, count and digest sum of each cell in use."""
    return F.concat_ws(";", F.size(keys).cast("string"), F.array_join(F.transform(cells, lambda e: F.concat_ws(":", e["c"].cast("string"), e["n"].cast("string"), F.lower(F.hex(e["x"])))), ","))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with digests, sketch and fingerprint of its texts; such columns of df are refused."""
    if clash := {"digests", "sketch", "fingerprint"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    with_keys = df.withColumn("digests", digests(F.col(text)))
    with_cells = with_keys.withColumn("sketch", sketch(F.col("digests"), F.lit(BASE)))
    return with_cells.withColumn("fingerprint", rendered(F.col("digests"), F.col("sketch")))


def _successors(rows: DataFrame) -> DataFrame:
    """(doc_id, h, n, copies, next_id, next_h): distinct rows in descending order and what follows each."""
    keys = rows.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    # Numbers rise through sorted ranges; kept, so that they are given only once.
    dealt = checkpointed(keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    # One row per range: the place of its last row, and of the first row of the range after it, in a ring.
    ranges = dealt.groupBy("part").agg(F.max("at").alias("last"), F.min("at").alias("first"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = ranges.select(F.col("last").alias("at"), F.coalesce(F.lead("first").over(ring), F.min("first").over(whole)).alias("turn"))
    named = dealt.join(small(turns), "at", "left").withColumn("next", F.coalesce("turn", F.col("at") + 1))
    follows = dealt.select(F.col("at").alias("next"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    return named.join(follows, "next").select("doc_id", "h", "n", "copies", "next_id", "next_h")


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, next_digests, next_sketch): each document, its edited text, and its successor's
    sketch.

    The last half of the text's code points, rounded down, gives way to as many of the successor's first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    chain = checkpointed(_successors(rows))
    place = chain.select("doc_id", "h", "n", "copies")
    to = chain.select(F.col("next_id").alias("doc_id"), F.col("next_h").alias("h"), F.col("doc_id").alias("to_id"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("half"))

    def unique(known: DataFrame) -> DataFrame:
        """One row per (doc_id, h), joined with known; only rows that have copies are shuffled for that."""
        keys = rows.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
        met = keys.join(small(known), keys["_d"].eqNullSafe(F.col("doc_id")) & (keys["_h"] == F.col("h"))).drop("_d", "_h")
        return met.where("copies = 1").unionByName(met.where("copies > 1").dropDuplicates(["doc_id", "h"]))

    given = unique(to.join(place, [to["doc_id"].eqNullSafe(place["doc_id"]), to["h"] == place["h"]]).select(to["doc_id"], to["h"], "to_id", "to_h", "half", "copies"))
    given = given.select(F.col("to_id").alias("doc_id"), F.col("to_h").alias("h"), F.expr("substring(text, 1, half)").alias("insert"), digests(F.col("text")).alias("next_digests"))
    own = unique(place)
    # Texts meet by shuffling, whatever their estimated size: a broadcast of texts has no bound.
    met = own.alias("o").join(given.hint("shuffle_merge").alias("g"), F.col("o.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("o.h") == F.col("g.h"))).select("o.doc_id", "o.text", "o.n", "o.copies", "g.insert", "g.next_digests")
    # Of equal rows each but the last is followed by its like.
    turn = met.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("last", F.col("turn") == F.col("copies"))
    half = F.floor(F.col("n") / 2).cast("int")
    return turn.withColumn("half", half).select(
        "doc_id", "text",
        F.concat(F.expr("substring(text, 1, n - half)"), F.when(F.col("last"), F.col("insert")).otherwise(F.expr("substring(text, 1, half)"))).alias("edited"),
        F.when(F.col("last"), F.col("next_digests")).otherwise(digests(F.col("text"))).alias("next_digests"),
    )


def compare(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, digests, fingerprint, edited_digests, edited_fingerprint, near_edited, near_next)."""
    base = F.lit(BASE)

    def told(own: Column, edited: Column, after: Column) -> Column:
        return _let(sketch(own, base), lambda s: _let(sketch(edited, base), lambda e: F.struct(
            own.alias("digests"), rendered(own, s).alias("fingerprint"), edited.alias("edited_digests"), rendered(edited, e).alias("edited_fingerprint"),
            likeness(own, edited, s, e).alias("near_edited"), likeness(own, after, s, sketch(after, base)).alias("near_next"),
        )))

    found = versions(docs).withColumn("told", _let(digests(F.col("text")), lambda own: _let(digests(F.col("edited")), lambda edited: told(own, edited, F.col("next_digests")))))
    return found.select("doc_id", "text", "edited", "told.*")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
