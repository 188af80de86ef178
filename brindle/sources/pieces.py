"""Records of text files in which a record may begin anywhere, found by as many tasks as Spark cuts the files into.

A file is read in units (lines of CSV; of JSON what lies between closing braces), and Spark deals its pieces to tasks. What a
piece does to the state of a parser is gathered for every state it may be met in; the driver carries the state through the
pieces, which are one row each. With its state known a piece reads the records that lie in it whole. Those that cross
pieces, at most one for each border, are put together from their units. No task holds more than a batch and a record.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.stable import fixed, kept


class SourceError(ValueError):
    """A source that is not what it says it is; the message names the line where it can."""


# -- CSV

_QUOTED, _FIELD = re.compile(r'[^"]*+(?:""[^"]*+)*+'), re.compile(r'(?:"([^"]*+(?:""[^"]*+)*+)"|([^",\n][^,\n]*+)|)[,\n]')


def quoted_after(line: str, quoted: bool) -> bool:
    """Whether quotes are open behind a line, by whether they were before it."""
    at, end = 0, len(line)
    while True:
        if quoted:
            at = _QUOTED.match(line, at).end()
            if at == end:
                return True
            at += 1
            if at == end:
                return False
            if line[at] != ",":
                raise ValueError("text behind a closing quote")
            at += 1
        quoted = line.startswith('"', at)
        if quoted:
            at += 1
        else:
            at = line.find(",", at) + 1
            if not at:
                return False


def csv_fields(record: str) -> list[str | None]:
    """The fields of one record that is known to be whole."""
    if '"' not in record:
        return [f or None for f in record.split(",")]
    return [m[1].replace('""', '"') if m[1] is not None else m[2] for m in _FIELD.finditer(record + "\n")]


class Csv:
    """State: whether quotes are open. A way is, for closed and open quotes before, the state after and the unit of an error."""

    separator, end, start = "\n", "", False

    class Way:
        def __init__(self) -> None:
            self.n, self.after, self.wrong = 0, [False, True], [-1, -1]

        def feed(self, lines: list[str]) -> None:
            for n, line in enumerate(lines, self.n):
                if '"' in line:
                    for i in (0, 1):
                        if self.wrong[i] < 0:
                            try:
                                self.after[i] = quoted_after(line, self.after[i])
                            except ValueError:
                                self.wrong[i] = n
            self.n += len(lines)

        def told(self) -> list:
            return [self.after, self.wrong]

    class Split:
        def __init__(self, quoted: bool) -> None:
            self.n, self.begin, self.held, self.quoted = 0, 0, [], quoted

        def feed(self, lines: list[str]) -> list[tuple[int, int, str]]:
            out, held, quoted, begin = [], self.held, self.quoted, self.begin
            for n, line in enumerate(lines, self.n):
                if '"' in line:
                    quoted = quoted_after(line, quoted)
                if quoted:
                    begin = begin if held else n
                    held.append(line)
                elif held:
                    held.append(line)
                    out.append((begin, n, "\n".join(held)))
                    held = []
                elif line:
                    out.append((n, n, line))
            self.n, self.held, self.quoted, self.begin = self.n + len(lines), held, quoted, begin
            return out

    def through(self, state: bool, way: list, file: str, units: int) -> bool:
        if way[1][state] >= 0:
            raise SourceError(f"{file}: line {units + way[1][state] + 1}: text behind a closing quote")
        return way[0][state]

    def between(self, state: bool) -> bool:
        return not state

    def closed(self, state: bool, file: str, units: int) -> None:
        if state:
            raise SourceError(f"{file}: line {units}: a quote is not closed")

    def width(self, record: str, first: bool) -> int:
        return len(csv_fields(record))

    def longest(self) -> int | None:
        return None


# -- JSON

#: Characters of one element of a JSON array at most.
MAX_ELEMENT = 32 << 20

_WHITE, _ESCAPE, _DECODER = re.compile(r"[ \t\n\r]*"), re.compile(r"\\[^}]|\\(?=})|\\\Z"), json.JSONDecoder()


#: What stands behind the elements of an array: of one without any, and of others.
ENDS = re.compile(r"[ \t\n\r]*\[[ \t\n\r]*\][ \t\n\r]*"), re.compile(r"[ \t\n\r]*\][ \t\n\r]*")


def element_at(text: str, first: bool) -> int:
    """Where the object begins in an element of a top-level array and what stands before it."""
    at = _WHITE.match(text).end()
    if text[at : at + 1] != ("[" if first else ","):
        raise ValueError("a JSON source is an array of objects" if first else "a comma is wanted")
    at = _WHITE.match(text, at + 1).end()
    if text[at : at + 1] != "{":
        raise ValueError("an object is wanted")
    return at


class Json:
    """State: whether a text is open, and how many brackets are. A way is whether texts turn, and the brackets by the state before."""

    separator, end, start = "}", "}", (0, 0)

    @staticmethod
    def outside(unit: str, inside: int) -> tuple[int, int]:
        """The state of texts behind a unit and its brace, and the brackets opened."""
        parts = (_ESCAPE.sub("", unit) if "\\" in unit else unit).split('"')
        after = inside ^ (len(parts) - 1 & 1)
        plain = "".join(parts[inside::2])
        return after, plain.count("{") + plain.count("[") - plain.count("]") - (not after)

    class Way:
        def __init__(self) -> None:
            self.turns, self.opened = [0, 1], [0, 0]

        def feed(self, units: list[str]) -> None:
            text = "}".join(units) + "}"
            parts = (_ESCAPE.sub("", text) if "\\" in text else text).split('"')
            opened = [plain.count("{") + plain.count("[") - plain.count("}") - plain.count("]") for plain in ("".join(parts[0::2]), "".join(parts[1::2]))]
            for i in (0, 1):
                self.opened[i] += opened[self.turns[i]]
                self.turns[i] ^= len(parts) - 1 & 1

        def told(self) -> list:
            return [self.turns, self.opened]

    class Split:
        def __init__(self, state: tuple[int, int]) -> None:
            self.n, self.begin, self.held, self.state = 0, 0, [], state

        def feed(self, units: list[str]) -> list[tuple[int, int, str]]:
            out, held, (inside, depth), begin = [], self.held, self.state, self.begin
            for n, unit in enumerate(units, self.n):
                inside, opened = Json.outside(unit, inside)
                depth += opened
                begin = begin if held else n
                held.append(unit)
                if depth == 1 and not inside:
                    out.append((begin, n, "}".join(held) + "}"))
                    held = []
            self.n, self.held, self.state, self.begin = self.n + len(units), held, (inside, depth), begin
            return out

    def through(self, state: tuple[int, int], way: list, file: str, units: int) -> tuple[int, int]:
        return way[0][state[0]], state[1] + way[1][state[0]]

    def between(self, state: tuple[int, int]) -> bool:
        return state == (0, 1)

    def closed(self, state: tuple[int, int], file: str, units: int) -> None:
        pass  # What stands behind the last element is looked at with the records that cross pieces.

    def width(self, record: str, first: bool) -> int:
        at = element_at(record, first)
        if len(record) - at > MAX_ELEMENT:
            raise ValueError(f"an element of more than {MAX_ELEMENT} characters")
        if _DECODER.raw_decode(record, at)[1] != len(record):
            raise ValueError("not JSON")
        return 1

    def longest(self) -> int | None:
        return MAX_ELEMENT


# -- pieces


@dataclass
class Piece:
    """first: the first unit's number; head: units of a record begun before, whether it ends here; one: the first whole record's units; tail: the unit at which a record begins that does not end here."""

    state: Any
    first: int = 0
    opens: bool = False  # the file's first piece
    units: int = 0
    head: int = 0
    ends: bool = True
    one: tuple[int, int] | None = None
    tail: int = -1
    count: int = 0
    number: int = 0  # of the first whole record in its file
    seq: int = 0  # of that record in all files


@dataclass
class Crossing:
    file: str
    number: int
    closed: bool = False  # of the last of a JSON file, which is what stands behind its elements, not
    header: bool = False
    seq: int = 0


@dataclass
class Found:
    """What find tells: cut holds the records that cross pieces, whose rec is their place in crossing; widest the fields of each file's widest whole record."""

    units: DataFrame
    pieces: dict[tuple[str, int], Piece]
    crossing: list[Crossing]
    cut: DataFrame | None  # rec, text
    widest: list[tuple[int, str]]


def runs(batches: Iterator) -> Iterator[tuple[tuple[str, int], list[str], int]]:
    """(file and block, units, number of the first) of stretches of one piece."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, at, value = batch.columns
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist())]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield (file[a].as_py(), block[a].as_py()), value[a:b].to_pylist(), at[a].as_py()


def _told(key: tuple[str, int], more: Any) -> Any:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([json.dumps(more)])], ["file", "block", "told"])


_TOLD = "file string, block long, told string"


def find(spark: SparkSession, path: str, fmt: Csv | Json, header: bool) -> Found:
    """The pieces of the files, in the order of their paths, and the records that cross them; with header, the first of each file is kept apart."""
    reader = spark.read.text(path) if fmt.separator == "\n" else spark.read.text(path, lineSep=fmt.separator)
    units = fixed(reader.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"))

    def ways(batches):
        for key, stretches in groupby(runs(batches), lambda r: r[0]):
            way, n, first = fmt.Way(), 0, None
            for _, values, at in stretches:
                first = at if first is None else first
                way.feed(values)
                n += len(values)
            yield _told(key, [first, n, way.told()])

    told = sorted((r.file, r.block, *json.loads(r.told)) for r in units.mapInArrow(ways, _TOLD).collect())
    if not told:
        raise SourceError("the file is empty")
    pieces: dict[tuple[str, int], Piece] = {}
    for file, those in groupby(told, lambda r: r[0]):
        state, passed, opens = fmt.start, 0, True
        for _, block, first, n, way in those:
            pieces[file, block] = Piece(state, first, opens, n)
            state, opens = fmt.through(state, way, file, passed), False
            passed += n
        fmt.closed(state, file, passed)
    states = {k: (p.state, p.opens) for k, p in pieces.items()}

    def look(batches):
        for key, stretches in groupby(runs(batches), lambda r: r[0]):
            state, opens = states[key]
            split, mid = fmt.Split(state), not (opens or fmt.between(state))
            head, one, count, width, long, wrong = 0, None, 0, 0, [0, 0], None
            for _, values, _ in stretches:
                for begin, end, text in split.feed(values):
                    if mid and not head:
                        head, long[0] = end + 1, len(text)
                        continue
                    one = one or (begin, end)
                    try:
                        width = max(width, fmt.width(text, opens and not count))
                    except ValueError as error:
                        wrong = wrong or [count, str(error)]
                    count += 1
            ends, tail = bool(head) or not mid, split.begin if split.held else -1
            long[1] = sum(map(len, split.held))
            if not ends:
                head, tail, long = split.n, -1, [long[1], 0]
            yield _told(key, [head, ends, one, tail, count, width, long, wrong])

    seen = {(r.file, r.block): json.loads(r.told) for r in units.mapInArrow(look, _TOLD).collect()}
    crossing: list[Crossing] = []
    ranges: list[tuple[int, int, int, int]] = []
    widest: list[tuple[int, str]] = []
    seq, part = 0, lambda p, a, b, rec: ranges.append((p.first >> 33, p.first + a, p.first + b, rec))
    for file, keys in groupby(pieces, lambda k: k[0]):
        number, length, most, opened = 0, 0, 0, None
        for key in keys:
            p = pieces[key]
            p.head, p.ends, p.one, p.tail, p.count, width, long, wrong = seen[key]
            if p.head:
                part(p, 0, p.head - 1, opened)
                length += long[0]
                if p.ends:
                    crossing[opened].closed, opened = True, None
            p.number, p.seq = number, seq + number - header
            if wrong:
                raise SourceError(f"{file}: element {number + wrong[0] + 1}: {wrong[1]}")
            if header and not number and p.count:
                part(p, *p.one, len(crossing))
                crossing.append(Crossing(file, 0, True, True))
            number, most = number + p.count, max(most, width)
            if p.tail >= 0:
                opened, length = len(crossing), long[1]
                part(p, p.tail, p.units - 1, opened)
                crossing.append(Crossing(file, number, header=header and not number, seq=seq + number - header))
                number += 1
            if opened is not None and fmt.longest() and length > 2 * fmt.longest():
                raise SourceError(f"{file}: element {crossing[opened].number + 1}: an element of more than {fmt.longest()} characters")
        if fmt.end and opened is None:
            raise SourceError(f"{file}: the array is not closed")
        number -= opened is not None  # what stands behind the last element
        widest.append((most, file))
        seq += max(number - header, 0)
    return Found(units, pieces, crossing, _cut(units, ranges, fmt) if ranges else None, widest)


def whole(found: Found, fmt: Csv | Json) -> Callable[[Iterator], Iterator[list[tuple[int, bool, str]]]]:
    """A function of batches of units: by stretch, (number in all files, whether it is its file's first, text) of each record that lies in a piece whole."""
    pieces = found.pieces

    def read(batches):
        for key, stretches in groupby(runs(batches), lambda r: r[0]):
            p = pieces[key]
            split, mid, n = fmt.Split(p.state), p.head > 0, 0
            for _, values, _ in stretches:
                out = []
                for _, _, text in split.feed(values):
                    if mid:
                        mid = False
                    else:
                        out.append((p.seq + n, p.number + n == 0, text))
                        n += 1
                yield out

    return read


def _cut(units: DataFrame, ranges: list[tuple[int, int, int, int]], fmt: Csv | Json) -> DataFrame:
    """(rec, text) of the units in ranges of (part, first, last, rec)."""
    some = units.sparkSession.createDataFrame(ranges, "part long, lo long, hi long, rec long")
    met = units.join(F.broadcast(some), (F.shiftright("at", 33) == F.col("part")) & F.col("at").between(F.col("lo"), F.col("hi")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return kept(met.groupBy("rec").agg(F.array_join(texts, fmt.separator).alias("text")))
