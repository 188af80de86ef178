"""Small inputs with the awkward cases that every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, texts, extra=None, source=None):
    """documents of the given texts, doc_id from 0; extra: name of one more column, to clash with."""
    rows = [(i, t, "en", source(i) if source else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn(extra, df.doc_id.cast("string")) if extra else df


def save(df, folder, name="documents"):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


AWKWARD = [None, "", " ", "\n", "a", "x" * 70_000, "word " * 9_000, "é漢🙂 \x1c ſ K", "same text here again", "same text here again", None, ""]
