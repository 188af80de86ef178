"""A corpus pipeline over documents: five stages, each of which runs one operator of brindle.llm.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet into the
shared folder and reads back as the next stage's docs. All but the last return the columns of documents.

toxicity        rows whose text scores as toxic go; the model is fitted on labels and the stage's input.
near_dedup      of each group of near-duplicates (five-word shingles, fingerprints alike in 0.8 of their
                bits) the row with the smallest doc_id stays.
secrets         secrets in texts are replaced by [SECRET] and n_chars is counted anew; no row goes.
mixing          rows are repeated, kept or left out to bring the sources to their target weights.
tokens          texts become token ids, and the text decoded from those ids is returned beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, mixing, secrets, simhash, toxicity
from brindle.llm.common import delete_path, fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return clean if length is None else clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(length))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("mixing", mix_sources), ("tokens", tokenize)]

#: A fitted model and fingerprint groups are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted once the next has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(at), at
    return docs
