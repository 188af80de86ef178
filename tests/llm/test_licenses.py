import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from brindle.llm.licenses import TEMPLATES, op5_license_runs, op5_licenses, scan, template_bigrams

from .helpers import AWKWARD, documents, save


def brute(text):
    out = []
    for p in {text or "", *(text or "").split("\n")}:
        own = set(template_bigrams(p))
        for name, t in TEMPLATES:
            other = set(template_bigrams(t))
            if own and (d := 2 * len(own & other) / (len(own) + len(other))) >= 0.8:
                out.append((name, d))
    return out


def corpus():
    r = random.Random(8)
    noise = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet the license software is".split()) for _ in range(n))
    texts = [noise(r.randint(0, 200)) for _ in range(30)]
    for _, t in TEMPLATES:
        words = t.split(" ")
        for share in (0, 0.03, 0.1, 0.3):
            texts.append(" ".join(w if r.random() >= share else "changed" for w in words))
        texts.append(f"{noise(40)}\n{t.upper()}\n{noise(3)}\n{t.upper()}")
    return [*texts, *AWKWARD]


def test_the_query_agrees_with_brute_force(spark, tmp_path):
    texts = corpus()
    got = {r.doc_id: r for r in op5_licenses(spark, save(documents(spark, texts, extra="license"), tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert (got[i].n_matches, got[i].licenses) == (len(want), ",".join(sorted({n for n, _ in want}))), t
        assert got[i].best_dice == pytest.approx(max([0.0, *(d for _, d in want)]), abs=1e-8)


def test_bounds_prune_nothing_that_comes_up_to_the_threshold():
    for _, t in TEMPLATES:
        n = len(template_bigrams(t))
        for m in range(1, 3 * n):
            if 2 * min(m, n) / (m + n) >= 0.8:
                assert n * 0.8 / 1.2 - 1e-9 <= m <= n * 1.2 / 0.8 + 1e-9


def test_empty_tables_and_clashes(spark):
    df = documents(spark, ["a"])
    assert scan(df.limit(0)).count() == 0 and re.search("struct", dict(scan(df).dtypes)["matches"])
    with pytest.raises(ValueError):
        scan(df.withColumn("matches", F.lit(1)))


def test_wrapped_notices_inside_long_texts_are_found(spark, tmp_path):
    r = random.Random(6)
    noise = lambda n: "\n".join(textwrap.wrap(" ".join(r.choice("lorem ipsum of the software is provided".split()) for _ in range(n)), 60))
    wrap = lambda t: "\n".join(f" * {x}" for x in textwrap.wrap(t, 80))
    longer = [(n, t) for n, t in TEMPLATES if len(t) > 150]
    texts = [f"{noise(150)}\n{wrap(t)}\n\n{noise(150)}" for _, t in longer]
    texts += [f"{noise(40)}\n{wrap(' '.join(w if r.random() > 0.07 else 'other' for w in t.split()))}\n{noise(40)}" for _, t in longer]
    texts += [noise(300), "MIT\nLicense", *AWKWARD[:8]]
    got = {x.doc_id: x for x in op5_license_runs(spark, save(documents(spark, texts), tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        lines, want = [x for x in (text or "").split("\n") if template_bigrams(f"{x} x")], {}
        for name, t in TEMPLATES:
            other = set(template_bigrams(t))
            for a in range(len(lines)):
                for b in range(a + 2, len(lines) + 1):
                    own = set(template_bigrams("\n".join(lines[a:b])))
                    if len(own) > 1.5 * len(other) + 1:
                        break
                    if (d := 2 * len(own & other) / (len(own) + len(other))) >= 0.8:
                        want[t] = max(d, want.get(t, (0, name))[0]), name
        assert got[i].n_runs == len(want) and {n for _, n in want.values()} <= set(got[i].licenses.split(",")), i
        assert got[i].best_dice >= max([0.0, *(d for d, _ in want.values())]) - 1e-8
        assert i >= len(longer) or longer[i][0] in got[i].licenses.split(",")
