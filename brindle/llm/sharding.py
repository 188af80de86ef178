"""Sharding by size-tiered compaction.

A store is a folder of immutable Parquet files (shards) and of manifests, one per version, each of which
lists the shards that make up the table. An append writes new shards and commits a manifest that adds them.
Compaction looks at sizes alone: shards fall into tiers by the power of FANOUT of the least size that they
hold; FANOUT shards of one tier are a run, and runs are merged, at most up to the target size, until no
tier has a run left. A row is so rewritten as often as there are tiers. Nothing is shuffled: arrivals are
written by the tasks that read them, and a run is one task that reads its few files and writes one.

A commit puts a manifest under the next version's name by a rename that fails if the name is taken: of two
writers one wins, and the other commits on top of what it finds (an append always, a merge if the shards
that it replaces are still there; else its files are deleted). No reader ever sees half a version. Files that
no kept version lists are deleted by vacuum. A job that dies leaves files that no manifest lists.

An ingest is named. Its files are written once and listed under that name before any of its arrivals is
committed, and a manifest says which arrivals it holds: an ingest that died is run again under its name, and
commits what is missing, and nothing twice.

Rows are kept as they are, copies and nulls included; an empty append adds no shard. Shards keep every
column, and the rows of a store all have the columns of the first append.
"""

from __future__ import annotations

import json
import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_ROWS, checkpointed, delete_path, fresh_path, table

#: Bytes of a new shard and of a finished one, and how many shards of a tier are merged.
SMALL_BYTES, TARGET_BYTES, FANOUT = 4 << 20, 64 << 20, 4
#: Batches in which op4's table arrives.
ARRIVALS = 24
#: Runs of a Spark job, and jobs at a time.
JOB_RUNS, JOBS = 64, 4


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str  # relative to the store
    rows: int
    bytes: int

    def tier(self, least: int = SMALL_BYTES, fanout: int = FANOUT) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / least, fanout) + 0.5))


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_bytes: int = SMALL_BYTES, fanout: int = FANOUT) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.small, self.fanout = target_bytes, small_bytes, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # -- manifests

    def version(self) -> int:
        """The newest version; 0 for a store without any."""
        at = self._path("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def _json(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, value: dict) -> bool:
        """Writes a file that is not there yet, whole or not at all; False if it is there."""
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft, False)
        out.write(json.dumps(value).encode())
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(draft, final, options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True

    def _manifest(self, version: int) -> dict:
        return self._json(f"manifests/v{version:010d}.json") if version else {"shards": [], "arrivals": []}

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self._manifest(self.version() if version is None else version)["shards"]]

    def arrivals(self) -> set[str]:
        """The names of the arrivals that are in."""
        return set(self._manifest(self.version())["arrivals"])

    def commit(self, version: int, shards: list[Shard], arrivals: list[str] | None = None) -> int:
        """Puts version; its shards are on disk already. arrivals: all that it holds, those of the version before if None."""
        held = self._manifest(version - 1)["arrivals"] if arrivals is None else arrivals
        if not self._put(f"manifests/v{version:010d}.json", {"version": version, "arrivals": held, "shards": [asdict(s) for s in shards]}):
            raise Conflict(f"version {version} is there already")
        return version

    def _add(self, name: str, new: list[Shard]) -> int:
        """Commits the shards of an arrival on top of whatever version is the newest, once; the version."""
        while True:
            version = self.version()
            before = self._manifest(version)
            if name in before["arrivals"]:
                return version
            try:
                return self.commit(version + 1, [*(Shard(**s) for s in before["shards"]), *new], [*before["arrivals"], name])
            except Conflict:
                continue

    def _replace(self, runs: list[list[Shard]], merged: list[Shard]) -> bool:
        """Commits merged in place of runs; False if another writer has replaced some of them."""
        gone = {s.path for run in runs for s in run}
        while True:
            version = self.version()
            before = self.shards(version)
            if not gone <= {s.path for s in before}:
                return False
            try:
                self.commit(version + 1, [*(s for s in before if s.path not in gone), *merged])
                return True
            except Conflict:
                continue

    # -- data

    def _written(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        """Writes each partition of df as a shard, or as shards of so many rows, and lists them in the order of rows."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(f"{self.root}/{name}")
        listing, files = self._fs.listFiles(self._path(name), False), {}
        while listing.hasNext():
            status = listing.next()
            if status.getPath().getName().startswith("part-"):
                files[status.getPath().getName()] = status.getLen()
        if not files:
            return []
        # A count per file takes nothing but footers, and the driver keeps a line per file in any case.
        counts = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f")).count().collect()
        held = {r["f"]: r["count"] for r in counts}
        # part-<task>-<job>-c<file>: the tasks' order, and the files' within a task.
        place = lambda n: (int(n.split("-")[1]), int(n.rsplit("-c", 1)[1].split(".")[0]))
        return [Shard(f"{name}/{n}", held[n], files[n]) for n in sorted(files, key=place) if held.get(n)]

    def append(self, df: DataFrame, rows: int = 0) -> int:
        """Commits the rows of df, as a shard per partition or of so many rows, as one arrival; the version."""
        new = self._written(df, rows)
        return self._add(new[0].path, new) if new else self.version()

    def ingest(self, name: str, df: DataFrame, arrivals: int, rows: int = 0) -> int:
        """Commits the rows of df in so many arrivals, a version each, in the order of its partitions; the version.

        Run again under the same name, it goes on where it stopped.
        """
        listed = f"ingests/{name}.json"
        if not self._fs.exists(self._path(listed)):
            self._put(listed, {"shards": [asdict(s) for s in self._written(df, rows)]})
        new = [Shard(**s) for s in self._json(listed)["shards"]]
        for i in range(min(arrivals, len(new))):
            self._add(f"{name}/{i}", new[len(new) * i // min(arrivals, len(new)) : len(new) * (i + 1) // min(arrivals, len(new))])
        return self.version()

    def read(self, version: int | None = None, columns: bool = False) -> DataFrame | None:
        """The rows of a version, None if it has no shard; columns: with _shard, the path of each row's shard, in place of any such column."""
        shards = self.shards(version)
        if not shards:
            return None
        df = self._of(shards)
        return df.withColumn("_shard", F.regexp_extract(F.input_file_name(), "(data/[^/]+/[^/]+)$", 1)) if columns else df

    def _of(self, shards: list[Shard]) -> DataFrame:
        # The schema is read from one footer, as all shards of a store have it.
        one = self.spark.read.parquet(f"{self.root}/{shards[0].path}")
        return self.spark.read.schema(one.schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: at least fanout shards of one tier each, or what reaches the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target / 2:
                tiers.setdefault(s.tier(self.small, self.fanout), []).append(s)
        out = []
        for tier in sorted(tiers):
            run: list[Shard] = []
            for s in sorted(tiers[tier], key=lambda s: (s.bytes, s.path)):
                if run and sum(x.bytes for x in run) + s.bytes > self.target:
                    out.append(run)
                    run = []
                run.append(s)
                if len(run) == self.fanout:
                    out.append(run)
                    run = []
        return [r for r in out if len(r) > 1]

    def _merge(self, runs: list[list[Shard]]) -> None:
        """Writes a shard in place of each run: a task per run reads its files and writes one."""
        # Of inputs of one partition each, a union may make one partition; a session of its own rules that out.
        apart = self.spark.newSession()
        apart.conf.set("spark.sql.unionOutputPartitioning", "false")
        schema = apart.read.parquet(f"{self.root}/{runs[0][0].path}").schema
        parts = [apart.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in run)).coalesce(1) for run in runs]
        merged = self._written(reduce(DataFrame.unionAll, parts))
        if [s.rows for s in merged] != [sum(s.rows for s in run) for run in runs]:
            raise RuntimeError("the merged shards do not hold the rows of their runs")
        if not self._replace(runs, merged):
            for s in merged:
                self._fs.delete(self._path(s.path), False)

    def compact(self, vacuum: bool = True) -> int:
        """Merges until no run is left; the version."""
        while runs := self.runs(self.shards()):
            jobs = [runs[i : i + JOB_RUNS] for i in range(0, len(runs), JOB_RUNS)]
            with ThreadPoolExecutor(JOBS) as pool:
                list(pool.map(self._merge, jobs))
            if vacuum:
                self.vacuum()
        return self.version()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes shards that none of the newest keep versions lists, and older manifests.

        Only files that some manifest has listed are deleted: another writer's new files are let be.
        """
        newest = self.version()
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        seen = self._path("manifests")
        for status in self._fs.listStatus(seen):
            name = status.getPath().getName()
            if name.startswith("v") and int(name[1:-5]) <= newest - keep:
                for s in self.shards(int(name[1:-5])):
                    if s.path not in live:
                        self._fs.delete(self._path(s.path), False)
                self._fs.delete(status.getPath(), False)


def shard(docs: DataFrame, root: str, arrivals: int = ARRIVALS, store_options: dict | None = None) -> ShardStore:
    """A store at root with docs(doc_id, text, ...), come in arrivals and compacted."""
    store = ShardStore(docs.sparkSession, root, **(store_options or {}))
    seen = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # Text takes up to half its size in a file. An arrival has a shard at least.
    rows = max(1, min(seen[1] * 2 * store.small // max(1, seen[0]), seen[1] // arrivals))
    store.ingest("documents", docs, arrivals, rows)
    store.compact()
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: the shard that holds it after compaction, with its rows and tier, and the version.

    Null and empty texts are rows like others (n_bytes null and 0); copies of a row are rows of their own; an
    empty table gives no row. The store is deleted once the answer is kept.
    """
    store = shard(table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    version, found = store.version(), store.read(columns=True)
    if found is None:
        return spark.createDataFrame([], "doc_id long, n_bytes long, shard int, shard_rows long, tier int, version int")
    listed = [(s.path, i, s.rows, s.tier()) for i, s in enumerate(store.shards())]
    names = spark.createDataFrame(listed, "_shard string, shard int, shard_rows long, tier int")
    names = F.broadcast(names) if len(listed) <= BROADCAST_ROWS else names.hint("shuffle_merge")
    answer = checkpointed(found.select("doc_id", "text", "_shard").join(names, "_shard").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "shard", "shard_rows", "tier", F.lit(version).alias("version")))
    delete_path(spark, store.root)
    return answer
