"""Suffix-array dedup: every run of LENGTH bytes that also starts in a document of a smaller doc_id goes.

Suffix arrays are built by the difference-cover algorithm: triples at the positions that are 1 or 2 mod 3
are sorted and named, the string of names is sorted by recursion, and the remaining suffixes are merged in by
their first bytes and the rank of the sampled suffix behind them (ranks below). Strings are compared to
LENGTH bytes and no further, which bounds the recursion; suffixes that agree so far stand side by side,
and comparing adjacent prefixes tells which do.

One suffix array over the corpus would be sorted many times over the network. It is distributed by content
instead. The least hash of the K-byte strings inside a window of LENGTH bytes is a function of the window
alone, so that equal windows carry an equal anchor wherever they occur: windows are dealt to buckets by
anchor, and the suffix arrays of the buckets hold every match.

1. anchors     the hashes of each document's anchors go to buckets; those that two documents hold are told
               to the groups of documents that hold them. All other windows can have no match.
2. units       neighbouring windows of one shared anchor form a unit, a string of up to UNIT windows. Equal
               units of a group of documents are sent once, with the smallest doc_id.
3. suffixes    buckets build suffix arrays of their units, a few at a time, and send back which windows of
               which unit start in a smaller document too.
4. removal     documents join those windows into spans and keep the rest.

An anchor that more than HOT documents hold, or whose units come to more than HOT_BYTES in all, is dealt by
window instead: the windows of a group's distinct units go to buckets each by its own hash, so that neither a
passage in a third of all documents nor one string in countless contexts, in however few documents, makes a
bucket. An array so holds ARRAY_BYTES and one cold anchor's units at most, far fewer characters than names
have room for. The work is deterministic; groups are found again in step 4 as they were in step 2.

Texts are their UTF-8 bytes (null: empty); texts under LENGTH bytes lose nothing. Rows of one doc_id are one
document to each other: none is smaller. A null doc_id is larger than all others. Every row is returned, equal
rows included; an empty table gives none. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, table

LENGTH, K = 50, 16
#: Windows of a unit; documents that may hold an anchor, and bytes that its units may have, before it is dealt by window.
UNIT, HOT, HOT_BYTES = 256, 2000, 1 << 20
#: Names are packed three to a number of 63 bits.
NAMES = 1 << 21
#: Bytes of text of a group of documents and of a bucket, and bytes that one suffix array is built of.
GROUP_BYTES, BUCKET_BYTES, ARRAY_BYTES = 8 << 20, 4 << 20, 1 << 18
_ONE, _TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_LAST = np.iinfo(np.int64).max


# -- suffix arrays -----------------------------------------------------------------------------------------


def _names(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names, from 1 and below 2^21, of the triples of text at the positions at, in the order of the triples."""
    most = int(text.max(initial=0))
    if most < 127:  # three small characters are a name of their own
        return ((text[at] << 14) | (text[at + 1] << 7) | text[at + 2]) + 1
    key = (text[at] << 42) | (text[at + 1] << 21) | text[at + 2]
    order = np.argsort(key)
    key = key[order]
    names = np.empty(len(key), np.int64)
    names[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
    return names


def _smaller(keys: np.ndarray, among: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of keys, which order sorts, how many of among (ascending) are smaller."""
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(among, keys[order])
    return out


def ranks(text: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """For the positions wanted (a mask), ranks, from 1, of the suffixes of text by at least depth characters.

    text: int64 below 2^21, 0 only as a mark that is smaller than all else. Suffixes that agree in depth
    characters have ranks side by side, with no other between. Only suffixes that are wanted, or that the
    order of those rests on, are sorted and merged; positions that are not wanted have rank 0.
    """
    n, out = len(text), np.zeros(len(text), np.int64)
    if n >= NAMES - 2:
        raise ValueError(f"{n} characters are too many for names of 21 bits")
    s = np.concatenate([text, np.zeros(3, np.int64)])
    if depth <= 3:
        at = np.flatnonzero(wanted)
        out[at] = _names(s, at) if len(at) else 0
        return out
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    named = _names(s, np.concatenate([one, two])) if n > 1 else np.zeros(0, np.int64)
    # A suffix rests on the sampled ones at itself or at the next two places.
    need = wanted.copy()
    need[1:] |= wanted[:-1]
    need[2:] |= wanted[:-2]
    rank = np.zeros(n + 3, np.int64)
    if n > 1:
        string = np.concatenate([named[: len(one)], [0], named[len(one) :]])
        deeper = ranks(string, -(-depth // 3), np.concatenate([need[one], [False], need[two]]))
        rank[one], rank[two] = deeper[: len(one)], deeper[len(one) + 1 :]
    at = np.flatnonzero(wanted)
    zero, one, two = (at[at % 3 == i] for i in range(3))
    # Suffixes at 0 mod 3 meet those at 1 by one character and a rank, and those at 2 by two and a rank.
    by_one = lambda x: (s[x] << 32) | rank[x + 1]
    by_two = lambda x: (s[x] << 42) | (s[x + 1] << 21) | rank[x + 2]
    z1, z2, k1, k2 = by_one(zero), by_two(zero), by_one(one), by_two(two)
    sample = rank[np.concatenate([one, two])]
    oz1, oz2, o1, o2, os = (np.argsort(x) for x in (z1, z2, k1, k2, sample))
    z1s, z2s = z1[oz1], z2[oz2]
    out[zero] = _smaller(z1, z1s, oz1) + _smaller(z1, k1[o1], oz1) + _smaller(z2, k2[o2], oz2) + 1
    below = _smaller(sample, sample[os], os)
    out[one] = below[: len(one)] + _smaller(k1, z1s, o1) + 1
    out[two] = below[len(one) :] + _smaller(k2, z2s, o2) + 1
    return out


def _words(buffer: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first n positions of buffer, as numbers."""
    return np.ndarray((n,), "<u8", buffer, strides=(1,))


def least_doc(text: bytes, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes at starts, the smallest of docs among the windows equal to it."""
    letters = np.frombuffer(text, np.uint8)
    code = np.zeros(256, np.int64)
    used = np.flatnonzero(np.bincount(letters, minlength=256))
    code[used] = np.arange(1, len(used) + 1)  # few letters make short names
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    rank = ranks(code[letters], LENGTH, wanted)
    order = np.argsort(rank[starts])
    at = starts[order]
    word = _words(text + bytes(8), len(text))
    same = np.ones(len(at) - 1, bool)
    for step in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = word[at + step]
        same &= w[1:] == w[:-1]
    first = np.concatenate([[0], np.flatnonzero(~same) + 1])
    least = np.minimum.reduceat(docs[order], first)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(first, len(at))))
    return out


# -- anchors and units -------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _THREE
    return x ^ (x >> np.uint64(29))


def _anchors(buffer: bytes) -> np.ndarray:
    """The anchor of each window of buffer: the least hash of its K-byte strings, mixed."""
    x = _words(buffer, len(buffer) - 7)
    h = (x[: -(K - 8)] * _ONE) ^ (x[K - 8 :] * _TWO + _ONE)
    h ^= h >> np.uint64(29)
    h *= _TWO
    h ^= h >> np.uint64(32)
    width, span = LENGTH - K + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return h if span == width else np.minimum(h[: span - width], h[width - span :])


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts, long ones in overlapping parts, some at a time (a buffer that caches hold): numbers, offsets, bytes."""
    part, full = 1 << 20, 1 << 18
    number, offset, pieces, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), part):
            piece = text[at : at + part + LENGTH - 1] if len(text) > part else text
            if len(piece) < LENGTH:
                continue
            number.append(i)
            offset.append(at)
            pieces.append(piece)
            size += len(piece)
            if size >= full:
                yield number, offset, pieces
                number, offset, pieces, size = [], [], [], 0
    if pieces:
        yield number, offset, pieces


def windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Units of texts, in order: text number, first window, windows, anchor."""
    for number, offset, pieces in _pieces(texts):
        anchor = _anchors(b"".join(pieces))
        size = np.array([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces)), size)[: len(anchor)]
        begin = np.cumsum(size) - size
        at = np.arange(len(anchor)) - begin[piece]
        valid = at <= size[piece] - LENGTH
        head = valid.copy()
        head[1:] &= (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
        run = np.maximum.accumulate(np.where(head, np.arange(len(anchor)), 0))
        head |= valid & ((np.arange(len(anchor)) - run) % UNIT == 0)
        first = np.flatnonzero(head)
        last = np.minimum(np.append(first[1:], len(anchor)), (begin + size - LENGTH + 1)[piece[first]])
        yield np.array(number)[piece[first]], np.array(offset)[piece[first]] + at[first], last - first, _mixed(anchor[first])


class _Shared:
    """The anchors of a group of documents that other documents hold too, cut to bits + 32 bits."""

    def __init__(self, rows: pa.Table, bits: int) -> None:
        self.shift = np.uint64(32 - bits)
        told = [(b, np.frombuffer(v, np.uint32), np.frombuffer(h, np.uint8)) for b, v, h in zip(rows.column("bucket").to_pylist(), rows.column("b0").to_pylist(), rows.column("b1").to_pylist(), strict=True)]
        code = np.concatenate([np.zeros(0, np.uint64), *((np.uint64(b) << np.uint64(32)) | v for b, v, _ in told)])
        hot = np.concatenate([np.zeros(0, np.uint8), *(h for *_, h in told)])
        order = np.argsort(code)
        self.code, self.hot = code[order], hot[order].astype(bool)

    def find(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each anchor is shared, and whether it is hot."""
        if not len(self.code):
            return np.zeros(len(anchor), bool), np.zeros(len(anchor), bool)
        code = anchor >> self.shift
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        met = self.code[at] == code
        return met, met & self.hot[at]


class _Units:
    """The distinct units of a group of documents, sorted by doc_id, and where they stand."""

    def __init__(self, texts: list[bytes], shared: _Shared) -> None:
        self.content: list[bytes] = []
        self.owner: list[int] = []  # number of the first text with the unit
        self.key: list[int] = []
        self.hot: list[bool] = []
        number, start, count, unit = [], [], [], []
        known: dict[bytes, int] = {}
        for texts_at, first, n, anchor in windows(texts):
            met, hot = shared.find(anchor)
            for i, at, k, a, h in zip(texts_at[met].tolist(), first[met].tolist(), n[met].tolist(), anchor[met].tolist(), hot[met].tolist(), strict=True):
                piece = texts[i][at : at + k + LENGTH - 1]
                u = known.get(piece)
                if u is None:
                    u = known[piece] = len(self.content)
                    self.content.append(piece)
                    self.owner.append(i)
                    self.key.append(a)
                    self.hot.append(h)
                number.append(i)
                start.append(at)
                count.append(k)
                unit.append(u)
        self.number, self.start, self.count, self.unit = (np.array(x, np.int64) for x in (number, start, count, unit))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the hot units, unit by unit: the unit, and the place in it."""
        hot = np.flatnonzero(np.array(self.hot, bool))
        n = np.array([len(self.content[u]) for u in hot.tolist()], np.int64) - LENGTH + 1
        return np.repeat(hot, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def window_bytes(self, of: np.ndarray, at: np.ndarray):
        """A function from numbers of those windows to their bytes, a row of LENGTH each."""
        hot = np.unique(of)
        text = b"".join([self.content[u] for u in hot.tolist()])
        size = np.array([len(self.content[u]) for u in hot.tolist()], np.int64)
        first = (np.cumsum(size) - size)[np.searchsorted(hot, of)] + at
        rows = np.ndarray((max(0, len(text) - LENGTH + 1), LENGTH), np.uint8, text, strides=(1, 1))
        return lambda which: rows[first[which]]


def _window_keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of LENGTH bytes."""
    word = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -LENGTH % 8)))).view("<u8")
    h = np.full(len(rows), _THREE)
    for j in range(word.shape[1]):
        h = (h ^ word[:, j]) * _ONE
        h ^= h >> np.uint64(32)
    return _mixed(h * _TWO)


# -- the steps ---------------------------------------------------------------------------------------------

_TOLD = "g long, bucket long, b0 binary, b1 binary, b2 binary"


def _sorted_docs(docs: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """The ids, the ids as numbers, and the texts of a group, by doc_id and then by text."""
    ids = docs.column("doc_id").to_pylist()
    texts = [x or b"" for x in docs.column("text").to_pylist()]
    number = [_LAST if i is None else i for i in ids]
    order = sorted(range(len(ids)), key=lambda j: (number[j], texts[j]))
    return [ids[j] for j in order], np.array([number[j] for j in order], np.int64), [texts[j] for j in order]


def _cuts(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return edge, np.append(edge[1:], len(sorted_keys))


def _tell_anchors(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, groups, lengths, values, sizes): the anchors of each batch of docs(g, text), a row per bucket.

    sizes: of each anchor, the bytes that its units have in that document, as a power of two that is no less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("g").to_numpy()
            held, code, size = [], [], []
            for i, _, n, anchor in windows([x or b"" for x in batch.column("text").to_pylist()]):
                c = anchor >> np.uint64(32 - bits)
                order = np.lexsort((c, i))
                i, c = i[order], c[order]
                once = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1])]))
                held.append(group[i[once]])
                code.append(c[once])
                size.append(np.ceil(np.log2(np.add.reduceat(n[order] + LENGTH - 1, once))).astype(np.uint8))
            if not code:
                continue
            g, c, size = np.concatenate(held), np.concatenate(code), np.concatenate(size)
            bucket = (c >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((c, g, bucket))
            g, c, size, bucket = g[order], c[order], size[order], bucket[order]
            rows = []
            for a, b in zip(*_cuts(bucket), strict=True):
                x, y = _cuts(g[a:b])
                rows.append((int(bucket[a]), g[a:b][x].astype(np.int64).tobytes(), (y - x).astype(np.int64).tobytes(), c[a:b].astype(np.uint32).tobytes(), size[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)], ["bucket", "groups", "lengths", "values", "sizes"])

    return docs.select("g", "text").mapInArrow(run, "bucket long, groups binary, lengths binary, values binary, sizes binary")


def _told_table(g, bucket, b0, b1, b2) -> pa.Table:
    return pa.table([pa.array(g, pa.int64()), pa.array(bucket, pa.int64()), *(pa.array(x, pa.binary()) for x in (b0, b1, b2))], ["g", "bucket", "b0", "b1", "b2"])


def _share(data: pa.Table, hot_docs: int, hot_bytes: int) -> pa.Table:
    """Of one bucket: to each group of documents, those of its anchors that at least two documents hold."""
    joined = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in data.column(name).to_pylist()])
    value = joined("values", np.uint32)
    group = np.repeat(joined("groups", np.int64), joined("lengths", np.int64))
    order = np.lexsort((group, value))
    value, group, size = value[order], group[order], np.exp2(joined("sizes", np.uint8)[order])
    a, b = _cuts(value)
    held = np.repeat(b - a, b - a)
    heavy = np.repeat(np.add.reduceat(size, a) > hot_bytes, b - a) if len(a) else np.zeros(0, bool)
    keep = (held > 1) & np.concatenate([[True], (value[1:] != value[:-1]) | (group[1:] != group[:-1])])
    value, group, hot = value[keep], group[keep], (held[keep] > hot_docs) | heavy[keep]
    order = np.argsort(group, kind="stable")
    value, group, hot = value[order], group[order], hot[order].astype(np.uint8)
    cuts = list(zip(*_cuts(group), strict=True))
    bucket = data.column("bucket")[0].as_py()
    return _told_table([int(group[x]) for x, _ in cuts], [bucket] * len(cuts), [value[x:y].tobytes() for x, y in cuts], [hot[x:y].tobytes() for x, y in cuts], [None] * len(cuts))


_UNITS = "bucket long, g long, n long, packed binary"
#: Of a unit: its number, the smallest document with it, half of its key (units of one key stay together, whatever
#: else comes beside them) and its length.
_HEAD = (("unit", np.dtype("<i8")), ("doc", np.dtype("<i8")), ("key", np.dtype("<u4")), ("size", np.dtype("<u2")))


def _packed(columns: dict[str, np.ndarray], text: bytes) -> bytes:
    """Units and their texts, one after another, compressed: they are most of what is shuffled."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*(columns[name].astype(kind).tobytes() for name, kind in _HEAD), text]))


def _unpacked(n: int, packed: bytes) -> tuple[dict[str, np.ndarray], bytes]:
    raw, at, columns = zstandard.ZstdDecompressor().decompress(packed), 0, {}
    for name, kind in _HEAD:
        columns[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return columns, raw[at:]


def _send_units(bits: int, buckets: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        _, number, texts = _sorted_docs(docs)
        units = _Units(texts, _Shared(told, bits))
        g, rows = (docs.column("g")[0].as_py() if docs.num_rows else 0), []
        owner = number[np.array(units.owner, np.int64)] if units.owner else np.zeros(0, np.int64)
        cold = np.flatnonzero(~np.array(units.hot, bool))
        key, size = np.array(units.key, np.uint64)[cold], np.array([len(units.content[u]) for u in cold.tolist()], np.int64)

        def deal(name: np.ndarray, doc: np.ndarray, key: np.ndarray, size: np.ndarray, text) -> None:
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for a, b in zip(*_cuts(bucket[order]), strict=True):
                u = order[a:b]
                rows.append((int(bucket[u[0]]), g, len(u), _packed({"unit": name[u], "doc": doc[u], "key": key[u] >> np.uint64(32), "size": size[u]}, text(u))))

        deal(cold, owner[cold], key, size, lambda u: b"".join([units.content[i] for i in cold[u].tolist()]))
        # The windows of hot units are numbered on from the units.
        of, at = units.windows()
        window, every = units.window_bytes(of, at), np.arange(len(of))
        keys = np.concatenate([np.zeros(0, np.uint64), *(_window_keys(window(every[i : i + (1 << 18)])) for i in range(0, len(of), 1 << 18))])
        deal(len(units.content) + every, owner[of], keys, np.full(len(of), LENGTH), lambda u: window(u).tobytes())
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], [x.split()[0] for x in _UNITS.split(", ")])

    return send


def _match(data: pa.Table, array_bytes: int) -> pa.Table:
    """Of one bucket of units: which windows of which units start in a smaller document."""
    group, unit, doc, key, content = [], [], [], [], []
    for g, n, packed in zip(*(data.column(x).to_pylist() for x in ("g", "n", "packed")), strict=True):
        columns, text = _unpacked(n, packed)
        end = np.cumsum(columns["size"], dtype=np.int64)
        group.append(np.full(n, g))
        unit.append(columns["unit"].astype(np.int64))
        doc.append(columns["doc"])
        key.append(columns["key"])
        content += [text[a:b] for a, b in zip((end - columns["size"]).tolist(), end.tolist(), strict=True)]
    group, unit, doc, key = (np.concatenate(x) for x in (group, unit, doc, key))
    # Units that groups have in common enter a suffix array once, with their smallest document.
    order = np.lexsort((doc, key))
    number: dict[bytes, int] = {}
    same = np.array([number.setdefault(content[i], len(number)) for i in order.tolist()], np.int64)
    first = order[np.unique(same, return_index=True)[1]]  # rows of the distinct units, in the order of key
    size = np.array([len(content[i]) for i in first.tolist()], np.int64)
    # Cut after about array_bytes, where the key changes.
    change, total = np.concatenate([[True], key[first][1:] != key[first][:-1]]), np.cumsum(size) - size
    part = total[np.maximum.accumulate(np.where(change, np.arange(len(first)), 0))] // array_bytes
    least = []
    for a, b in zip(*_cuts(part), strict=True):
        text = b"".join([content[i] for i in first[a:b].tolist()])
        n = size[a:b] - LENGTH + 1
        begin = np.cumsum(size[a:b]) - size[a:b]
        start = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        least.append(least_doc(text, start, np.repeat(doc[first[a:b]], n)))
    least = np.concatenate(least)
    n = size - LENGTH + 1
    begin = np.cumsum(n) - n
    # A copy in a larger document than the unit's smallest is covered throughout; the smallest where least says so.
    later = doc[order] > doc[first][same]
    out_row, out_from, out_to = [order[later]], [np.zeros(later.sum(), np.int64)], [n[same[later]]]
    covered = least < np.repeat(doc[first], n)
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    within = np.zeros(len(covered) + 1, bool)
    within[begin] = True  # a run of covered windows ends with its unit
    cut = np.flatnonzero(within[1:-1] & covered[1:] & covered[:-1]) + 1 if len(covered) > 1 else np.zeros(0, np.int64)
    run_from = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    run_to = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
    of = np.searchsorted(begin, run_from, side="right") - 1
    own = np.flatnonzero(~later)
    a, b = np.searchsorted(of, same[own]), np.searchsorted(of, same[own], side="right")
    each = np.repeat(own, b - a)
    hit = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
    out_row.append(order[each])
    out_from.append(run_from[hit] - begin[same[each]])
    out_to.append(run_to[hit] - begin[same[each]])
    row, lo, hi = (np.concatenate(x) for x in (out_row, out_from, out_to))
    by = np.argsort(group[row], kind="stable")
    row, lo, hi = row[by], lo[by], hi[by]
    cuts = list(zip(*_cuts(group[row]), strict=True))
    return _told_table([int(group[row[a]]) for a, _ in cuts], [-1] * len(cuts), [unit[row[a:b]].tobytes() for a, b in cuts], [lo[a:b].tobytes() for a, b in cuts], [hi[a:b].tobytes() for a, b in cuts])


_RESULT = "n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def _remove(bits: int):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        ids, number, texts = _sorted_docs(docs)
        answers = np.array([b >= 0 for b in told.column("bucket").to_pylist()], bool)
        units = _Units(texts, _Shared(told.filter(pa.array(answers)), bits))
        read = lambda name: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in told.filter(pa.array(~answers)).column(name).to_pylist())])
        unit, lo, hi = read("b0").copy(), read("b1").copy(), read("b2").copy()
        of, at = units.windows()
        single = unit >= len(units.content)
        place = unit[single] - len(units.content)
        unit[single], lo[single], hi[single] = of[place], at[place], at[place] + 1
        order = np.argsort(unit, kind="stable")
        unit, lo, hi = unit[order], lo[order], hi[order]
        owner = number[np.array(units.owner, np.int64)] if units.owner else np.zeros(0, np.int64)
        # A unit that stands in a smaller document of the group is covered; the first's answer holds for its own document.
        later = number[units.number] > owner[units.unit] if len(units.unit) else np.zeros(0, bool)
        own = np.flatnonzero(~later)
        a, b = np.searchsorted(unit, units.unit[own]), np.searchsorted(unit, units.unit[own], side="right")
        each = np.repeat(own, b - a)
        hit = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
        doc = np.concatenate([units.number[later], units.number[each]])
        begin = np.concatenate([units.start[later], units.start[each] + lo[hit]])
        end = np.concatenate([units.start[later] + units.count[later], units.start[each] + hi[hit]]) + LENGTH - 1
        # All texts in a row, with a gap after each, so that spans of two never touch.
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size + 1) - size - 1
        begin, end = begin + base[doc], end + base[doc]
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
        fresh = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else np.zeros(0, np.int64)
        begin, end = begin[fresh], end[np.append(fresh[1:], len(end)) - 1] if len(fresh) else end
        edge = np.searchsorted(begin, np.append(base, base[-1] + size[-1] + 1 if len(base) else 0))
        spans, kept = [], []
        for i, text in enumerate(texts):
            mine = [(int(x - base[i]), int(y - base[i])) for x, y in zip(begin[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]], strict=True)]
            past, rest = 0, []
            for x, y in mine:
                rest.append(text[past:x])
                past = y
            spans.append([{"start": x, "end": y} for x, y in mine])
            kept.append(b"".join([*rest, text[past:]]))
        return pa.table([pa.array(ids, docs.schema.field("doc_id").type), pa.array(size), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return remove


def dedup(docs: DataFrame, hot: int = HOT, hot_bytes: int = HOT_BYTES, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of docs(doc_id, text): removed byte spans, and the bytes that are left."""
    rows = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, math.ceil(total / group_bytes))
    bits = min(31, max(0, (total // bucket_bytes).bit_length()))
    buckets = max(1, math.ceil(total / bucket_bytes))
    # Rows without an id are spread by their text.
    grouped = rows.select(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(groups)).alias("g"), "doc_id", "text")
    told = checkpointed(_tell_anchors(grouped, bits).groupBy("bucket").applyInArrow(lambda data: _share(data, hot, hot_bytes), _TOLD))
    by_group = grouped.groupBy("g")
    sent = by_group.cogroup(told.groupBy("g")).applyInArrow(_send_units(bits, buckets), _UNITS)
    answers = sent.groupBy("bucket").applyInArrow(lambda data: _match(data, array_bytes), _TOLD)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return by_group.cogroup(told.union(answers).groupBy("g")).applyInArrow(_remove(bits), f"doc_id {id_type}, {_RESULT}")


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents", spread="doc_id"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
