"""The pipeline against a plain version of each stage, on a corpus with planted cases."""

import random
import re

import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brindle.llm import bpe, secrets, toxicity  # noqa: E402

from .helpers import AWKWARD, documents, save  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    r = random.Random(3)
    vocab = [f"word{i}" for i in range(4000)]
    texts, labels = [], []
    for i in range(700):
        t = [r.choice(vocab) for _ in range(r.randint(60, 160))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                t.insert(r.randint(0, len(t)), r.choice(["vilex", "grumby", "snark"]))
        texts.append(" ".join(t))
        labels.append((i, 1, int(toxic)))
    clean = [i for i in range(700) if i % 5]
    copies = {700 + j: i for j, i in enumerate(clean[:40])}
    texts += [texts[i] for i in copies.values()]
    near = {len(texts) + j: i for j, i in enumerate(clean[40:80])}
    texts += [re.sub(r"\b\w+\b", "changed", texts[i], count=1) for i in near.values()]
    held = {len(texts): "plain words token = 'abcdefgh12' and more of them"}
    texts += list(held.values())
    first_awkward = len(texts)
    texts += AWKWARD
    where = save(documents(spark, texts, extra="place"), folder)
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), folder, "labels")
    return where, texts, labels, copies, near, held, first_awkward


def test_stages_do_what_they_say(spark, corpus, tmp_path):
    where, texts, labels, copies, near, held, awkward = corpus
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    toxic = {i for i, _, y in labels if y}
    assert len(ids["toxicity"] & toxic) <= 3 and len(ids["toxicity"] & set(range(700)) - toxic) >= 0.99 * (700 - len(toxic))
    assert ids["near_dedup"] == {i for i in ids["toxicity"] if i not in copies and i not in near and i not in _equal(texts, ids["toxicity"])}
    assert ids["secrets"] == ids["near_dedup"]
    for r in seen["secrets"]:
        want = texts[r.doc_id] if texts[r.doc_id] is None else secrets.redact_text(texts[r.doc_id], secrets.find_spans(texts[r.doc_id]))
        assert r.text == want and (want is None or r.n_chars == len(want))
    (secret,) = held
    assert "abcdefgh12" not in next(r.text for r in seen["secrets"] if r.doc_id == secret)
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(seen["mixing"]) - 1.5 * words(seen["secrets"])) < 0.2 * words(seen["secrets"])
    library = Tokenizer.from_file(bpe.DEFAULT_TOKENIZER)
    after = {r.doc_id: r.text for r in seen["secrets"]}
    for r in seen["tokens"][:100]:
        assert r.ids == library.encode(after[r.doc_id], add_special_tokens=False).ids and r.decoded == after[r.doc_id] and r.n_tokens == len(r.ids)


def _equal(texts, kept):
    """Rows whose words an earlier row has, of those that repeat by themselves."""
    first, out = {}, set()
    for i in sorted(kept):
        key = b" ".join((texts[i] or "").encode().lower().split())
        if key in first:
            out.add(i)
        first.setdefault(key, i)
    return out


def test_run_gives_the_last_stages_rows(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() > 500
    assert corpus_pipeline.ORACLE_SQL is None


def test_an_empty_table_goes_through(spark, tmp_path):
    where = save(documents(spark, ["a"]).limit(0), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert corpus_pipeline.run(spark, where).count() == 0


def test_the_toxicity_model_is_that_of_the_stage(spark, corpus):
    where, texts, *_ = corpus
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.fit(docs, labels)
    want = {i for i, t in enumerate(texts) if model.score(*model.features(t)[2:]) < 0.5}
    assert {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, where).collect()} == want
