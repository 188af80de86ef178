"""BPE encoding and decoding by a tokenization automaton.

The merges of a byte-level BPE are compiled, one merge gadget after another, into a deterministic
automaton whose arcs are tokens and whose states are "what may follow the arc just taken". The gadget
for merge m = (u, v) -> uv closes arc v in the state that u leads to and opens arc uv wherever the path
u, v was open; the state behind uv starts as a copy of the state behind v. A text has exactly one path
through the finished automaton: the token sequence that running the merges in order gives. The dense
table would have 50k x 50k cells; a cell is derived from the gadgets when a text first needs it, and kept.

Words are read byte by byte through the automaton's determinised form. A state of that says, for every
suffix of what was read that begins some token, where it stands among the beginnings of tokens and which
arc led to its start; and which arc is the last of the path of all that was read. As every prefix has
one path, the next byte leads to one next state. Transitions are a table from state and byte to state,
filled when first taken; a table that has grown to STATES states is begun anew with the current one. The path
is read off backwards from the last arcs of all prefixes, so that a word takes eight bytes per byte of
its own beside its ids, however long it is.

Pre-split words are cached per Python worker in two generations of bounded size, which changes nothing
but time. Null and empty texts have no ids, and spell the empty text; ids are exact for texts of any length.
Rows are coded one by one: copies and equal ids alike, and an empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import kept_for_a_stage, release_memory, small_batches, table

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Words kept per Python worker, and the length beyond which a word is not kept.
CACHE_WORDS, CACHE_LENGTH = 110_000, 48
#: States that the determinised automaton holds at a time.
STATES = 160_000
#: Arc pairs of which it is kept whether they are open.
PAIRS = 110_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256, 257, ... in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _packed(state: list[int]) -> bytes:
    """A state as it is kept: eight bytes a number, a quarter of what a tuple of numbers takes."""
    return array("q", state).tobytes()


def _unpacked(state: bytes) -> array:
    return array("q", state)


class TokenAutomaton:
    """The automaton of one tokenizer file (its JSON text)."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE")
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.label: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.label[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.label[i] = content.encode()
        self.plain = [i for t, i in vocab.items() if t not in self.added]
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.born = [-1] * size
        self.merge: dict[int, int] = {}  # arc pair -> number of the merge that closes it
        self.cell: dict[int, bool] = {}  # arc pair -> open when the later of both came to be
        self.dead: set[int] = set()
        for m, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            self._gadget(m, vocab[left], vocab[right], vocab[left + right])
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.split_words = regex.compile(public_tokenizers.PATTERN).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        # The beginnings of tokens: node and byte to node, and the token that ends at a node.
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for i in self.plain:
            node = 0
            for c in self.label[i]:
                after = self.child.get(node << 8 | c)
                if after is None:
                    after = self.child[node << 8 | c] = len(self.ends)
                    self.ends.append(-1)
                node = after
            if i not in self.dead:
                self.ends[node] = i
        self.opens: dict[int, bool] = {}  # arc pair -> open once all merges are in
        self.cell.clear()
        self._begin(_packed([-1]))

    @property
    def token_of(self) -> dict[bytes, int]:
        return {self.label[i]: i for i in self.plain}

    def _begin(self, state: bytes) -> None:
        """Empties the table of transitions, with state as number 0 (where words begin) or, if another, 1."""
        first = _packed([-1])
        self.states = [first] if state == first else [first, state]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.step: dict[int, int] = {}
        self.arc = [_unpacked(s)[0] for s in self.states]

    def _gadget(self, m: int, u: int, v: int, joined: int) -> None:
        if self.parts[joined] is not None:
            raise ValueError(f"two merges give token {joined}")
        if not self._open(u, v, m):
            self.dead.add(joined)
        self.parts[joined], self.born[joined] = (u, v), m
        self.merge[u << 32 | v] = m

    def _open(self, a: int, b: int, before: int) -> bool:
        """Whether arc b leaves the state behind arc a once the merges numbered below before are in."""
        closed = self.merge.get(a << 32 | b)
        return (closed is None or closed >= before) and self._first(a, b)

    def _first(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.cell.get(key)
        if known is None:
            if self.born[a] < 0 and self.born[b] < 0:
                known = True
            elif self.born[b] >= self.born[a]:  # arc b was added last, beside arc u of b = uv
                u, v = self.parts[b]
                known = b not in self.dead and not (u == v == a) and self._open(a, u, self.born[b])
            else:  # the state behind a = uv was copied from the state behind v
                known = self._open(self.parts[a][1], b, self.born[a])
            self.cell[key] = known
        return known

    def walk(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells word."""
        last, at, get = [], 0, self.step.get
        for c in word:
            after = get(at << 8 | c)
            if after is None:
                after = self._next(at, c)
                get = self.step.get
            at = after
            last.append(self.arc[at])
        path, end = [], len(word)
        while end:
            path.append(last[end - 1])
            end -= len(self.label[path[-1]])
        return path[::-1]

    def _next(self, at: int, c: int) -> int:
        """The state that byte c leads to from state at, put into the table.

        A state: the last arc, and then, the longest first, each suffix that begins a token, as the arc that led to
        its start (from 1; 0 at the start of the word), times 2^24, and its node. A new suffix begins at the root.
        """
        begun, child, ends, opens = _unpacked(self.states[at]), self.child, self.ends, self.opens
        state, arc = [-1], -1
        for x in (*begun[1:], (begun[0] + 1) << 24):
            node = child.get((x & 0xFFFFFF) << 8 | c)
            if node is None:
                continue
            led = x >> 24
            state.append(led << 24 | node)
            if arc < 0 <= (token := ends[node]):
                if not led:
                    arc = token
                else:
                    known = opens.get(pair := led << 32 | token)
                    if known is None:
                        known = opens[pair] = ((led - 1) << 32 | token) not in self.merge and self._first(led - 1, token)
                    if known:
                        arc = token
        if arc < 0:
            raise ValueError("no path: the vocabulary lacks a byte")
        state[0] = arc
        state = _packed(state)
        to = self.number.get(state)
        if to is None:
            if len(self.states) >= STATES:
                self._begin(state)
                return self.number[state]
            to = self.number[state] = len(self.states)
            self.states.append(state)
            self.arc.append(arc)
        self.step[at << 8 | c] = to
        return to

    def _word(self, word: str) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            found = tuple(self.walk(word.encode()))
            if len(self.cell) >= PAIRS or len(self.opens) >= PAIRS:
                self.cell.clear()
                self.opens.clear()
        if len(word) <= CACHE_LENGTH:
            if len(self.words) >= CACHE_WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def _plain(self, text: str) -> list[int]:
        words = self.split_words(text)
        get = self.words.get
        found = list(map(get, words))
        if None in found:
            found = [x if x is not None else self._word(w) for x, w in zip(found, words, strict=True)]
        return list(chain.from_iterable(found))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_added is None or not any(x in text for x in self.added):
            return self._plain(text)
        ids: list[int] = []
        for piece in self.split_added.split(text):
            ids += [self.added[piece]] if piece in self.added else self._plain(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


@kept_for_a_stage
@lru_cache(maxsize=2)
def automaton(text: str) -> TokenAutomaton:
    return TokenAutomaton(text)


def _shipped(spark: SparkSession, tokenizer: str):
    """The tokenizer file's text as a broadcast: its size is the vocabulary's, whatever the corpus."""
    with open(tokenizer, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _with(df: DataFrame, fields: list[T.StructField], work) -> DataFrame:
    schema = T.StructType([*df.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(automaton)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield work(batch.slice(at, 512))

    return small_batches(df).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """df with a column of token ids; a null text has none. Columns of df stay, one named ids is refused."""
    if ids in df.columns:
        raise ValueError(f"column {ids} is there already")
    model = _shipped(df.sparkSession, tokenizer)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = automaton(model.value)
        found = pa.array([m.encode(t.as_py()) for t in batch.column(text)], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, ids])

    return _with(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """df with the text that its ids spell; null ids spell the empty text."""
    if text in df.columns:
        raise ValueError(f"column {text} is there already")
    model = _shipped(df.sparkSession, tokenizer)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = automaton(model.value)
        found = pa.array([m.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, text])

    return _with(df, [T.StructField(text, T.StringType())], work)


def round_trip(docs: DataFrame, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids, decoded) of documents(doc_id, text, ...): encoded, and decoded from those ids."""
    model = _shipped(docs.sparkSession, tokenizer)
    df = docs.select("doc_id", "text")
    schema = T.StructType([df.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(automaton)
        m = automaton(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [m.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(m.decode, ids), pa.string())], schema.names)

    return small_batches(df).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its number of tokens, and digests of its ids and of the text decoded from them."""
    coded = round_trip(table(spark, sf_dir, "documents", spread="doc_id"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
