"""Streams of records into hourly counts and into the warehouse."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from brindle.functions.casts import cast_columns


def read_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(folder)


def hourly_counts(stream: DataFrame, at: str, status: str, lateness: str = "1 hour") -> DataFrame:
    """(hour, status, n) over event time; rows later than lateness are left out, as any watermark does."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return timed.groupBy(F.window("_at", "1 hour").alias("w"), F.col(status)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), status, "n")


def append_batches(stream: DataFrame, to: str | Path, checkpoint: str | Path, casts: dict[str, str] | None = None) -> StreamingQuery:
    """Appends each micro-batch to the folder to, once: a batch's folder is its number, so that a replay replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        cast_columns(batch, casts or {}).write.mode("overwrite").parquet(f"{to}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
