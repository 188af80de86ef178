"""Rows that stay as they were computed: what hangs on how a sort by ranges fell out must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where the cluster keeps what all its machines share, as spark.checkpoint.dir says.

    Where the session names none, one machine (tests) takes a temporary folder; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared folder from then on."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fixed(df: DataFrame) -> DataFrame:
    """df in the partitions that its plan has now, computed anew with each use.

    A scan is cut into pieces by the cores at hand, which may be others at the next action; what is known of a piece holds for as
    long as the pieces stay.
    """
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)
