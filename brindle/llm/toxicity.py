"""Toxicity by class-conditional Kneser-Ney models.

Two word models, toxic and ordinary, are estimated from labelled documents. As in Kneser-Ney smoothing,
the lower order counts in how many different contexts a word stands (so that a passage copied a thousand
times counts once), the higher order counts documents per word pair, and both are discounted towards
backoff counts. Those backoff counts are shared: an expression's count in both classes, dealt out in
proportion to the classes' sizes. A class keeps its own count only where it departs from the shared one
by more than a discount (least plus spread x its square root); every rarer or evenly used expression
falls back on the shared count, and so speaks for neither class.

A text's length-normalised log-likelihoods under both models are compared twice, over the whole text and
over its most toxic run of WINDOW words (a long text with one insult is toxic); a logistic curve over the
two differences, fitted on rows that gave no counts, turns them into a score.

Words and pairs are counted by 64-bit hashes of their own, never by shared slots, so that what is gathered
grows with the distinct expressions of the labelled rows. The discount for pairs is taken in Spark; the model
shipped to executors holds every counted word (all of them have a likelihood) and, of the pairs, only those
that depart from the shared count. Null and empty texts score as texts of no
words. Copies of a labelled row count as often as they stand there. Several labels of one doc_id: toxic if any says so; null labels are ignored. Without a toxic and an
ordinary training row there is nothing to compare, and every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, release_memory, small, small_batches, table

#: least + spread * sqrt(shared count): the discount of single words and of pairs.
WORD_DISCOUNT, PAIR_DISCOUNT = (2.0, 3.0), (8.0, 4.0)
#: The share of the backoff count that even a count kept by a class is mixed with.
BACKOFF_SHARE = 0.05
#: What every count is raised by, so that none is zero in a logarithm.
UNIT = 0.05
WINDOW = 8
#: The logistic curve (three numbers) is fitted on at most about this many labelled rows.
CALIBRATION_ROWS = 20_000

_words = re.compile(r"\w+").findall
_ids: dict[str, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    words = _words((text or "").lower())
    if len(_ids) > 100_000:
        _ids.clear()
    out = []
    for w in words:
        h = _ids.get(w)
        if h is None:
            h = _ids[w] = xxhash.xxh64_intdigest(w.encode())
        out.append(h)
    return np.array(out, dtype=np.uint64).view(np.int64)


def pair_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Per word of text: its hash, and the hash of the pair that it makes with its left neighbour."""
    word = word_hashes(text)
    w = word.view(np.uint64)
    left = np.concatenate([np.array([0], np.uint64), w[:-1]]) if len(w) else w
    # Each step is one-to-one in w, so that pairs of one left neighbour never meet.
    h = (left * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)) ^ w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return word, (h ^ (h >> np.uint64(32))).view(np.int64)


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted stand in the ascending keys (not none), and whether they do."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    words: np.ndarray  # hashes of all counted words, ascending
    toxic: np.ndarray  # their log-likelihoods
    ordinary: np.ndarray
    unknown: float  # log-likelihood of any other word
    pairs: np.ndarray  # hashes of the pairs that speak for a class, ascending
    pair_gain: np.ndarray  # what such a pair adds to toxic minus ordinary
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Mean log-likelihoods (toxic, ordinary), mean difference, greatest difference in a window."""
        word, key = pair_keys(text)
        if not len(word):
            return 0.0, 0.0, 0.0, 0.0
        at, known = _at(self.words, word)
        t, o = np.where(known, self.toxic[at], self.unknown).astype(float), np.where(known, self.ordinary[at], self.unknown).astype(float)
        if len(self.pairs):
            at, known = _at(self.pairs, key)
            t = t + np.where(known, self.pair_gain[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(t - o)])
        k = min(WINDOW, len(word))
        return float(t.mean()), float(o.mean()), float(total[-1] / len(word)), float((total[k:] - total[:-k]).max() / WINDOW)

    def score(self, mean: float, window: float) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * mean + c * window, -30, 30))))


def _word_model(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Log-likelihoods (2, n) by class of words with contexts counts (2, n) (ordinary, toxic), and that of any other word.

    What lies within the discount is replaced by the shared backoff count, which is equal in both classes.
    """
    totals = counts.sum(1) + 1e-9
    shared = counts.sum(0)[None, :] * (totals / totals.sum())[:, None]
    kept = (np.abs(counts - shared) > WORD_DISCOUNT[0] + WORD_DISCOUNT[1] * np.sqrt(shared)).any(0)
    like = np.log(counts.sum(0) / totals.sum() + UNIT / totals.sum())
    own = np.log((counts + BACKOFF_SHARE * shared) / (1 + BACKOFF_SHARE) / totals[:, None] + UNIT / totals.sum())
    return np.where(kept, own, like), float(np.log(UNIT / totals.sum()))


def _speaking(pairs: DataFrame, lean: DataFrame, odds: float) -> DataFrame:
    """(pair, gain) of the pairs(word, pair, o, t) that depart from what their words lead to expect.

    lean(word, lean): the likelihood ratio of the words that depart from the shared count; all others lean to neither.
    """
    tilt, size = F.coalesce("lean", F.lit(1.0)) * odds, F.col("o") + F.col("t")
    told = pairs.join(small(lean), "word", "left").select("pair", "o", "t", (size / (1 + tilt)).alias("eo"), (size * tilt / (1 + tilt)).alias("et"))
    beyond = lambda n, e: F.abs(F.col(n) - F.col(e)) > PAIR_DISCOUNT[0] + PAIR_DISCOUNT[1] * F.sqrt(e)
    own = lambda n, e: F.log(((F.col(n) + BACKOFF_SHARE * F.col(e)) / (1 + BACKOFF_SHARE) + UNIT) / (F.col(e) + UNIT))
    return told.where(beyond("o", "eo") | beyond("t", "et")).select("pair", (own("t", "et") - own("o", "eo")).alias("gain")).where(F.abs("gain") > 1e-9)


def _counted(labelled: DataFrame) -> DataFrame:
    """(word, pair, o, t): ordinary and toxic documents by word pair, of labelled(text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words, pairs, toxic = [], [], []
                for t, y in zip(part.column("text"), part.column("toxic"), strict=True):
                    word, pair = pair_keys(t.as_py())
                    pair, first = np.unique(pair, return_index=True)
                    words.append(word[first])
                    pairs.append(pair)
                    toxic.append(np.full(len(pair), y.as_py(), np.int64))
                pair, first, where = np.unique(np.concatenate(pairs), return_index=True, return_inverse=True)
                t = np.bincount(where, np.concatenate(toxic), len(pair)).astype(np.int64)
                o = np.bincount(where, minlength=len(pair)).astype(np.int64) - t
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(words)[first], pair, o, t)], ["word", "pair", "o", "t"])
        _ids.clear()
        release_memory()

    counts = small_batches(labelled).select("text", "toxic").mapInArrow(run, "word long, pair long, o long, t long")
    return counts.groupBy("word", "pair").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 1e-3 * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of labels(doc_id, toxic) on docs(doc_id, text), from rows outside the held-out fold.

    Of fold 4 of crc32(doc_id) mod 5 about CALIBRATION_ROWS rows at most calibrate; all other rows of folds 1
    to 4 are counted, and fold 0 is never read. The driver
    takes one row per distinct word and one per pair that speaks for a class; all other pairs stay in Spark.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).where(_fold(F.col("doc_id")) != 0)
    joined = docs.select("doc_id", "text").join(small(known), "doc_id")
    fold = _fold(F.col("doc_id"))
    share = min(1.0, CALIBRATION_ROWS / max(1, known.where(fold == 4).count()))
    calibrates = (fold == 4) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    held = known.where(calibrates)
    count = _counted(joined.where(~calibrates))
    met = lambda n: F.sum(F.when(F.col(n) > 0, 1).otherwise(0)).alias(n)
    by_word = count.groupBy("word").agg(F.lit(None).cast("long").alias("pair"), met("o"), met("t"))
    # A pair below the least discount in total cannot speak for a class. Both read o and t, so that one exchange serves both.
    rows = checkpointed(by_word.select("word", "pair", "o", "t").union(count.where(F.col("o") + F.col("t") > PAIR_DISCOUNT[0])))
    single = rows.where("pair is null").select("word", "o", "t").toArrow()
    word, counts = single["word"].to_numpy(), np.stack([single["o"].to_numpy(), single["t"].to_numpy()]).astype(float)
    if not counts[0].any() or not counts[1].any():
        return None
    order = np.argsort(word)
    word, counts = word[order], counts[:, order]
    (ordinary, toxic), unknown = _word_model(counts)
    leans = np.flatnonzero(ordinary != toxic)
    lean = docs.sparkSession.createDataFrame(pa.table({"word": word[leans], "lean": np.exp(toxic - ordinary)[leans]}))
    speaking = _speaking(rows.where("pair is not null"), lean, float((counts[1].sum() + 1e-9) / (counts[0].sum() + 1e-9))).toArrow()
    pair, gain = speaking["pair"].to_numpy(), speaking["gain"].to_numpy()
    order = np.argsort(pair)
    model = Model(word, toxic.astype(np.float32), ordinary.astype(np.float32), unknown, pair[order], gain[order].astype(np.float32))
    seen = measured(docs.select("doc_id", "text").join(small(held), "doc_id"), model, "toxic int").select("mean", "window", "toxic").toArrow().to_pandas()
    if seen.toxic.nunique() < 2:
        # Too few rows to set some aside: as many of the counted ones take their place, of each class by itself.
        part = known.withColumn("n", F.count("*").over(Window.partitionBy("toxic"))).where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(CALIBRATION_ROWS // 2 * 1e6) / F.col("n")).drop("n")
        seen = measured(docs.select("doc_id", "text").join(small(part), "doc_id"), model, "toxic int").select("mean", "window", "toxic").toArrow().to_pandas()
    model.curve = _logistic(seen[["mean", "window"]].to_numpy(), seen.toxic.to_numpy(float))
    return model


def measured(df: DataFrame, model: Model, more: str = "") -> DataFrame:
    """(doc_id, [more], ll_toxic, ll_ordinary, mean, window, score) of df(doc_id, text, [more])."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", *([more.split()[0]] if more else [])]
    names = ["ll_toxic", "ll_ordinary", "mean", "window", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            found = np.array([m.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 4)
            score = np.array([m.score(x[2], x[3]) for x in found], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(found[:, i]) for i in range(4)), pa.array(score)], [*keep, *names])
        _ids.clear()

    schema = ", ".join([f"doc_id {df.schema['doc_id'].dataType.simpleString()}", *([more] if more else []), *(f"{x} double" for x in names)])
    return small_batches(df).select(*keep, "text").mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, ll_toxic, ll_ordinary, mean, window, score) of docs(doc_id, text), one row per row."""
    model = fit(docs, labels)
    if model is None:
        zero = F.lit(0.0)
        return docs.select("doc_id", *(zero.alias(x) for x in ("ll_toxic", "ll_ordinary", "mean", "window", "score")))
    return measured(docs.select("doc_id", "text"), model)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; all columns stay."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            keep = [m.score(*m.features(t.as_py())[2:]) < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))
        _ids.clear()
        release_memory()

    return small_batches(docs).mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its score, and 1 where that is 0.5 or more.

    Equal texts have equal scores, whatever their ids. Rows without a doc_id are scored, and in no fold.
    """
    scored = score(table(spark, sf_dir, "documents", spread="doc_id"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ll_toxic", "ll_ordinary")
