"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations only.

1. Targets: the sources share a budget of tokens by weight; none takes more than REPEATS times its size, and
   what it leaves is shared by the others (water filling, in closed form over one row per source).
2. Schedule: the points of the van der Corput sequence, in base 2 and restricted to the number of slots, run
   through the cumulative slot counts of the sources; every stretch of the schedule holds each source in
   close to its share, and the whole holds it exactly. A source's slots are ranked in schedule order.
3. Blocks: a source's documents, in the order of a seeded hash, form one stream of tokens, cut into blocks
   of equally many; the slot of rank r takes block r mod the number of blocks. A block holds BLOCK_TOKENS at
   most and no more than a FINENESS-th of its source and of its target, so that what a small source takes
   lies as near its target as whole words allow.

A document takes what its blocks take: its tokens within a block, times the turns of that block. Ranks and
running sums are taken within buckets of a hash or of the schedule and then shifted by the sums of the
buckets before, so that a source with a third of all rows is spread over as many tasks as it has buckets.

Null texts have size 0, null sources are one source, weighed last. Empty and null texts take 0. Copies of a
row are rows of their own; ties in the hash fall to doc_id and then to the text's hash, and rows that agree
in all of these are alike, so that every rerun gives the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, free_name, small, table

WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2
BLOCK_TOKENS, FINENESS = 128, 64
SEED = 17
#: Rows that a bucket of documents, and slots that a stretch of the schedule, hold on average.
BUCKET_ROWS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place): size in words, place: the seeded hash that orders a source's rows."""
    words = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, n, target) of sizes(source, size): one row per source.

    Weights repeat over the sources by code point, null last. With caps c and weights w, the level L that
    solves sum(min(c, L w)) = budget gives min(c, L w); sources reach their cap in the order of c / w.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn + 1)).withColumn("cap", F.col("source_size") * repeats)
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        weighed.withColumn("budget", F.sum("source_size").over(everyone) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("turn", F.row_number().over(rising))
    )
    # The level is the first that its own source does not overtake; all sources before it are capped.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("turn", "level"))).over(everyone)["level"]
    return filled.withColumn("at", level).select("source", "source_size", "n", F.least(F.col("cap").cast("double"), F.coalesce(F.col("at"), F.lit(0.0)) * F.col("w")).alias("target"))


def _reversed_bits(number: Column, bits: int) -> Column:
    """number < 2^bits with its bits in reverse: the van der Corput point of that index, times 2^bits."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.shiftright(number, i).bitwiseAND(1), bits - 1 - i) for i in range(bits)]) if bits else F.lit(0).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sources, schedule) of docs(doc_id, text, source).

    rows: doc_id, source, size, place, start (tokens of its source before it), cut (tokens of its source's
    blocks); sources: source, id, source_size, target, block, blocks, slots; schedule: slot, id, rank, block.
    """
    rows = checkpointed(sized(docs))
    by_source = targets(rows, weights, share, repeats)
    finest = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / FINENESS)
    counted = by_source.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_tokens), finest)).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    # A source at its cap takes every block, the short last one included, as often as is allowed.
    counted = counted.withColumn("slots", F.when(F.col("target") >= F.col("source_size") * repeats, F.col("blocks") * repeats).otherwise(F.least(F.round(F.col("target") / F.col("block")).cast("long"), F.col("blocks") * repeats)))
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    sources = checkpointed(counted.withColumn("id", F.row_number().over(order)).withColumn("upto", F.sum("slots").over(order)))
    return _streams(rows, sources), sources, _schedule(sources)


def _streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    # The hash is spread evenly, so that equal ranges of it hold about BUCKET_ROWS rows of a source each.
    known = small(sources.select(F.col("source").alias("s"), "id", F.col("block").alias("cut"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets")))
    keyed = rows.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = F.shiftrightunsigned("place", 32)
    keyed = keyed.withColumn("bucket", F.shiftright(share * F.col("buckets"), 32))
    sums = keyed.groupBy("id", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.withColumn("offset", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    inside = Window.partitionBy("id", "bucket").orderBy(F.shiftrightunsigned("place", 1), "place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(offset, ["id", "bucket"]).select("doc_id", "source", "id", "size", "place", "cut", (F.col("offset") + F.col("local")).alias("start"))


def _schedule(sources: DataFrame) -> DataFrame:
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(0, total - 1).bit_length()
    # Of the 2^bits points those below total are a permutation of the slots, and the slots of a source are
    # those whose point falls into its stretch of the cumulative counts. Reversing bits undoes itself, so
    # that the points of a stretch name their slots; stretches are dealt out in pieces.
    piece = 1 << 15
    bands = sources.where("slots > 0").select("id", "blocks", "upto", F.explode(F.sequence(F.col("upto") - F.col("slots"), F.col("upto") - 1, F.lit(piece).cast("long"))).alias("low")).repartition("id", "low")
    points = bands.select("id", "blocks", F.explode(F.sequence("low", F.least(F.col("low") + piece, F.col("upto")) - 1)).alias("point"))
    slots = points.select("id", "blocks", _reversed_bits(F.col("point"), bits).alias("index")).withColumn("stretch", F.floor(F.col("index") / BUCKET_ROWS))
    before = Window.partitionBy("id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    offset = slots.groupBy("id", "stretch").agg(F.count("*").alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    inside = Window.partitionBy("id", "stretch").orderBy("index")
    ranked = slots.withColumn("local", F.row_number().over(inside) - 1).join(offset.hint("shuffle_merge"), ["id", "stretch"]).withColumn("rank", F.col("offset") + F.col("local"))
    return ranked.select(F.col("index").alias("slot"), "id", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, source, size, place, source_size, target, taken) of docs(doc_id, text, source), one row per row."""
    rows, sources, schedule = plan(docs, weights, share, repeats, block_tokens)
    # The planner takes exploded slots for as few as their sources are, and would broadcast them.
    turns = schedule.groupBy("id", "block").agg(F.count("*").alias("turns")).hint("shuffle_merge")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("cut")), F.floor((F.col("start") + F.col("size") - 1) / F.col("cut")))))
    within = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("cut")) - F.greatest("start", F.col("block") * F.col("cut"))
    taken = cut.join(turns, ["id", "block"]).groupBy("id", "start").agg(F.sum(within * F.col("turns")).alias("words"))
    known = small(sources.select("id", "source_size", "target"))
    full = rows.where("size > 0").join(taken.hint("shuffle_merge"), ["id", "start"], "left").unionByName(rows.where("size = 0").withColumn("words", F.lit(0).cast("long")))
    return full.join(known, "id").select("doc_id", "source", "size", "place", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def remix(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them: taken / size turns, rounded half up, none for 0.

    Rows of no words, of which a mix by words takes nothing, go. Columns stay as they are.
    """
    place, turn = free_name(docs, "place"), free_name(docs, "turn")
    # Rows that agree in doc_id and text share a place, and lie side by side in the stream: they take turns together.
    rounded = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    turns = mix(docs).where("size > 0").groupBy(F.col("doc_id").alias("id"), "place").agg(F.max(rounded).alias("turns")).where("turns > 0").alias("t")
    keyed = docs.withColumn(place, F.xxhash64(F.lit(SEED), "doc_id", "text")).alias("d")
    met = keyed.join(small(turns), F.col("d.doc_id").eqNullSafe(F.col("t.id")) & (F.col(f"d.{place}") == F.col("t.place")))
    return met.select("d.*", F.explode(F.sequence(F.lit(1), F.col("t.turns"))).alias(turn)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its size, its source's size and target, and the words that the mix takes of it.

    Null and empty texts have size 0 and take 0; null sources are one source, weighed last; sources without
    words have target 0; equal rows each get a row, and what their stretch of the stream takes; no rows, no result.
    """
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
