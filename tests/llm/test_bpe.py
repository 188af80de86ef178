import hashlib
import random
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm.bpe import TokenAutomaton, decode, encode, op3_bpe

from .helpers import AWKWARD, documents, save

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return TokenAutomaton(file.read())


def fuzz(n=3000):
    r = random.Random(3)
    mixed = ["".join(r.choice("ab aAeét's\n\t\x1c\x85 　<|endoftext|>1٣漢🙂 ") for _ in range(40)) for _ in range(n)]
    return mixed + ["".join(r.choice("aehnt") for _ in range(r.randint(1, 25))) for _ in range(n)] + [r.choice("a -=_.*#") * r.randint(1, 200) for _ in range(200)] + ["<|endoftext|>", "a<|endoftext|> b"]


def test_ids_and_texts_are_the_librarys(own, library):
    for text in [*fuzz(), *(t for t in AWKWARD if t)]:
        ids = own.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_no_arc_of_a_path_is_closed_and_bad_bytes_decode_to_a_mark(own):
    assert own.decode([own.token_of[b"\xc3"]]) == "�" and own.decode([]) == ""
    assert own.encode(None) == []


def test_the_query_digests_what_the_library_gives(spark, tmp_path, library):
    texts = [*fuzz(60), *AWKWARD]
    got = {r.doc_id: r for r in op3_bpe(spark, save(documents(spark, texts, extra="ids"), tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_columns_stay_and_clashes_are_refused(spark):
    df = documents(spark, ["a b", None], extra="other")
    back = decode(encode(df)).orderBy("doc_id").collect()
    assert [r.decoded for r in back] == ["a b", ""] and back[0].other == "0"
    assert encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        encode(df, ids="other")


def test_a_word_of_a_million_letters_takes_bounded_memory(own, library):
    r = random.Random(8)
    for letters, n, traced in (("abcdefghijklmnopqrstuvwxyz", 1_000_000, False), ("abcdefghijklmnopqrstuvwxyz", 150_000, True), ("漢字仮名交文章", 50_000, True), ("a", 150_000, True)):
        word = "".join(r.choice(letters) for _ in range(n))
        if traced:
            tracemalloc.start()
        ids = own.encode(word)
        if traced:
            assert tracemalloc.get_traced_memory()[1] < 100e6
            tracemalloc.stop()
        assert ids == library.encode(word, add_special_tokens=False).ids and own.decode(ids) == word


def test_a_table_begun_anew_changes_nothing(library, monkeypatch):
    from brindle.llm import bpe

    monkeypatch.setattr(bpe, "STATES", 5)
    with open(PATH, encoding="utf-8") as file:
        small = TokenAutomaton(file.read())
    for text in fuzz(60):
        assert small.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert len(small.states) <= 5


def test_states_are_kept_small_and_other_stages_empty_the_tables(own):
    from brindle.llm import bpe
    from brindle.llm.common import release_memory

    own.encode("a text of some words")
    assert all(isinstance(s, bytes) for s in own.states) and own.encode("a text of some words")
    with open(PATH, encoding="utf-8") as file:
        bpe.automaton(file.read())
    release_memory(bpe.automaton)
    assert bpe.automaton.cache_info().currsize == 1
    release_memory()
    assert bpe.automaton.cache_info().currsize == 0
