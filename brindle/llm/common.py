"""What the corpus operators share: reading, the shared folder, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, spread: str | None = None) -> DataFrame:
    """A table; with spread, a table of fewer pieces than there are cores (one small file, say) is dealt out by that key."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores, spread) if spread and df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, one machine (tests) takes a temporary folder; a cluster has to name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """A name like name that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being its smallest reachable node.

    Alternates large-star and small-star rounds; each round holds at most one row per edge, and hubs
    are only ever aggregated by min, so a group of any size needs no task of its own size. The rounds
    are cut from their lineage by checkpoint(). Nodes are any ordered type; null ends are ignored.
    """
    links = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(max_rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        after = checkpointed(small)
        # A star forest is the fixed point: every node has one smaller neighbour, which has none.
        unsettled = after.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or after.select(F.col("hi").alias("x")).join(after.select(F.col("lo").alias("x")), "x", "left_semi").limit(1).count()
        links = after
        if not unsettled:
            break
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(links.select(F.col("lo"), F.col("lo")).distinct())


#: Rows of an Arrow batch on its way to Python: texts may be long, and a batch is in memory on both sides.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand Python at most BATCH_ROWS rows at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


#: Cached functions of this process that hold much: what one stage keeps, the next has no use for.
_KEPT: list = []


def kept_for_a_stage(cached):
    """Marks a function with a cache, which release_memory() empties in the stages of other operators."""
    _KEPT.append(cached)
    return cached


def release_memory(mine=None) -> None:
    """Empties the caches marked by kept_for_a_stage(), but for mine, and gives back to the system what this process
    has freed, in a Python worker that earlier stages have used.

    Workers are reused from stage to stage, and allocators keep what was freed; without glibc only Arrow's pool is emptied.
    """
    for cached in _KEPT:
        if cached is not mine:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Up to so many rows a table of keys and small values is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df, marked to be broadcast if a count of its rows allows, and else to be joined by a sort and merge."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_merge")
