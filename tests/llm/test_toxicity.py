import random
import zlib

from brindle.llm import toxicity
from brindle.llm.toxicity import drop_toxic, fit, op8_toxicity, word_hashes

from .helpers import AWKWARD, documents, save


def corpus(n=900):
    r = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(2):
                t.insert(r.randint(0, len(t)), r.choice(["vilex", "grumby", "snark"]) + r.choice(["", ".", ",", "!!"]))
        texts.append(" ".join(t))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def folds(i):
    return zlib.crc32(str(i).encode()) % 5


def tables(spark, tmp_path, texts, labels):
    where = save(documents(spark, texts, extra="score"), tmp_path)
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    return where


def test_held_out_rows_are_told_apart(spark, tmp_path):
    texts, labels = corpus()
    got = {r.doc_id: r for r in op8_toxicity(spark, tables(spark, tmp_path, [*texts, *AWKWARD], [*labels, (3, None, None), (labels[4][0], 0, 0), (99_999, 1, 1)])).collect()}
    assert len(got) == len(texts) + len(AWKWARD)
    assert all(r.held_out == (folds(i) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in labels if folds(i) == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert got[len(texts)].score == got[len(texts) + 1].score < 0.5  # null and empty


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus(300)
    docs = documents(spark, texts)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    one = fit(docs, frame(labels))
    two = fit(docs, frame([(i, q, 1 - y if folds(i) == 0 else y) for i, q, y in labels]))
    assert one.curve == two.curve and (one.toxic == two.toxic).all() and (one.ordinary == two.ordinary).all()


def test_without_both_classes_nothing_is_rejected(spark, tmp_path):
    texts, _ = corpus(20)
    where = tables(spark, tmp_path, texts, [(0, 1, 0)])
    assert {r.score for r in op8_toxicity(spark, where).collect()} == {0.0}
    docs, none = documents(spark, texts), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert drop_toxic(docs, none).count() == 20 and drop_toxic(docs.limit(0), none).count() == 0


def test_toxic_rows_go_and_columns_stay(spark):
    texts, labels = corpus()
    docs = documents(spark, texts, extra="window")
    left = drop_toxic(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.select("doc_id").collect()}
    clean = [i for i, _, y in labels if not y]
    assert sum(i in kept for i in clean) / len(clean) > 0.99 and sum(i in kept for i, _, y in labels if y) < 5


def test_words_ignore_case_and_punctuation():
    assert (word_hashes("Scum, scum!") == word_hashes("scum SCUM")).all() and len(word_hashes(None)) == 0


def test_a_rare_toxic_word_shares_its_count_with_no_other(spark):
    r = random.Random(4)
    slot = lambda w: zlib.crc32(w.encode()) & (1 << 18) - 1
    at = slot("common")
    rare = next(w for i in range(10_000_000) if slot(w := f"rare{i}") == at)
    vocab = [f"word{i}" for i in range(200)]
    texts = [" ".join(x for _ in range(30) for x in (r.choice(vocab), "common")) for _ in range(600)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(600)]
    texts = [f"{t} {r.choice(vocab)} {rare} {r.choice(vocab)}" if y else t for t, (_, _, y) in zip(texts, labels, strict=True)]
    model = fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    lean = lambda w: model.features(w)[2]
    assert lean(rare) > 2 and abs(lean("common")) < 0.5


def test_rows_beyond_the_calibration_sample_are_counted(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    texts, labels = corpus(300)
    fourth = [i for i in range(300) if folds(i) == 4]
    texts = [f"{t} only{i}" for i, t in enumerate(texts)]
    model = fit(documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    counted = [i for i in fourth if word_hashes(f"only{i}")[0] in model.words]
    assert 0 < len(fourth) - len(counted) < 40 and counted
    assert all((word_hashes(f"only{i}")[0] in model.words) == (folds(i) != 0) for i in range(300) if folds(i) != 4)


def test_rows_without_an_id_repeated_rows_and_small_label_sets(spark, tmp_path):
    texts, labels = corpus(300)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1), (5, texts[5], "en", "s", 1), (5, "vilex grumby", "en", "s", 1), (None, None, None, None, None)]
    where = save(spark.createDataFrame(rows, documents(spark, ["a"]).schema), tmp_path)
    # No row of fold 4 is labelled: the counted rows set the curve.
    save(spark.createDataFrame([x for x in labels if folds(x[0]) != 4], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    got = op8_toxicity(spark, where).collect()
    assert len(got) == len(rows) and all(r.held_out == (r.doc_id is not None and folds(r.doc_id) == 0) for r in got)
    same = [r.score for r in got if r.doc_id in (0, None)]
    assert len(set(same)) == 2 and min(x.score for x in got) >= 0
    held = [(r.predicted, labels[r.doc_id][2]) for r in got[:300] if r.doc_id is not None and folds(r.doc_id) == 0]
    assert sum(p == y for p, y in held) / len(held) > 0.9
