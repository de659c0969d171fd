"""CSV records read in splits, also where quoted cells hold line breaks.

Whether a line break ends a record depends on all the text before it, so a file
with such cells is usually one task. Here a first pass follows each split under
both hypotheses, that it starts between records and that it starts within a quoted
cell, and notes what either ends in. The notes of a file, one per split, are
chained in order on the driver, which lists the splits anyway; they tell how each
split really starts, at which line, and which record goes on. A second pass cuts
the splits into records. Only the pieces of records that cross the border of two
splits are shuffled and put together.

A quote opens a cell at its very start alone, is doubled within it, and text behind
a closing quote belongs to the cell, as the CSV parser has it. Lines end with a
line feed; a carriage return before one that ends a record is dropped. Blank lines
between records are no records. A cell that is open at the end of its file makes
its record torn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitra.session import ship

_OPENS = re.compile(r'(?>(?:"(?:[^"]|"")*+"[^,]*|[^",][^,]*|),)*+"(?:[^"]|"")*+')
_CLOSES = re.compile(r'(?:[^"]|"")*+"[^,]*+')
#: Text of an unfinished record that a task holds before it hands a piece on.
HELD_CHARS = 4_000_000

_NOTE = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("from_closed", pa.bool_()), ("from_open", pa.bool_()),
    ("tail_closed", pa.int64()), ("tail_open", pa.int64()), ("header", pa.string()), ("header_line", pa.int64()),
])
_PIECE = pa.schema([
    ("file", pa.string()), ("line", pa.int64()), ("piece", pa.int64()), ("torn", pa.bool_()), ("text", pa.string()),
])


def open_after(line: str, open_before: bool) -> bool:
    """Whether a quoted cell goes on after ``line``."""
    if open_before:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        line = line[closed.end() + 1 :]
    return _OPENS.fullmatch(line) is not None


class Start(NamedTuple):
    """How a split starts."""

    line: int  # its first line in the file
    record: int | None  # first line of the record that goes on from the split before
    header: int  # lines up to the end of the header
    torn: bool  # the file ends in this split, within a cell


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """A batch's lines by file and start of their split."""
    codes = np.asarray(batch.column(0).dictionary_encode().indices)
    starts = np.asarray(batch.column(1))
    borders = (np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1).tolist()
    for low, high in zip([0, *borders], [*borders, len(codes)], strict=True):
        if high > low:
            yield batch.column(0)[low].as_py(), int(starts[low]), batch.column(2).slice(low, high - low)


def _quoted(lines: pa.Array) -> Iterator[tuple[int, str]]:
    """Lines with a quote; no other line opens or closes a cell."""
    for k in np.flatnonzero(np.asarray(pc.match_substring(lines, '"'))).tolist():
        yield k, lines[k].as_py()


class _Note:
    """What is noted of one split."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.lines = file, start, 0
        self.open, self.tail = [False, True], [None, None]
        self.head: list[str] | None = [] if start == 0 else None
        self.header, self.header_line = None, 0

    def add(self, lines: pa.Array) -> None:
        if self.head is not None:
            self.look_for_header(lines)
        for k, line in _quoted(lines):
            for hypothesis in (0, 1):
                after = open_after(line, self.open[hypothesis])
                if after and not self.open[hypothesis]:
                    self.tail[hypothesis] = self.lines + k
                self.open[hypothesis] = after
        self.lines += len(lines)

    def look_for_header(self, lines: pa.Array) -> None:
        for line in lines:
            text = line.as_py()
            self.header_line += 1
            if self.head or text.strip():
                self.head.append(text)
                if not open_after("\n".join(self.head), False):
                    self.header, self.head = "\n".join(self.head).removesuffix("\r").removeprefix("﻿"), None
                    return

    def row(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "file": self.file, "start": self.start, "lines": self.lines, "from_closed": self.open[0], "from_open": self.open[1],
            "tail_closed": self.tail[0], "tail_open": self.tail[1], "header": self.header, "header_line": self.header_line,
        }], _NOTE)


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One note per split."""
    note = None
    for batch in batches:
        for file, start, lines in _runs(batch):
            if note is None or (note.file, note.start) != (file, start):
                if note is not None:
                    yield note.row()
                note = _Note(file, start)
            note.add(lines)
    if note is not None:
        yield note.row()


def chain(notes: Sequence) -> dict[tuple[str, int], Start]:
    """How every split starts, from the notes of all splits."""
    starts: dict[tuple[str, int], Start] = {}
    file, line, record = None, 1, None
    for note in sorted(notes, key=lambda n: (n["file"], n["start"])):
        if note["file"] != file:
            if record is not None:
                starts[before] = starts[before]._replace(torn=True)
            file, line, record = note["file"], 1, None
        before = file, note["start"]
        starts[before] = Start(line, record, note["header_line"], False)
        is_open, tail = (note["from_closed"], note["tail_closed"]) if record is None else (note["from_open"], note["tail_open"])
        if not is_open:
            record = None
        elif tail is not None:
            record = line + tail
        line += note["lines"]
    if record is not None:
        starts[before] = starts[before]._replace(torn=True)
    return starts


class _Cutter:
    """The records of one split after the other."""

    def __init__(self, starts: dict[tuple[str, int], Start]):
        self.starts, self.at, self.rows = starts, None, []

    def enter(self, file: str, start: int) -> None:
        self.leave()
        if (file, start) not in self.starts:
            raise ValueError(f"the files were split in another way in the first pass: {file} at {start}")
        self.at, here = (file, start), self.starts[file, start]
        self.line, self.header, self.torn = here.line, here.header, here.torn
        self.held, self.size = [], 0
        self.record, self.in_pieces = (here.line, False) if here.record is None else (here.record, True)

    def leave(self) -> None:
        if self.at is not None and self.held:
            self.hand_on(self.torn)

    def hand_on(self, torn: bool = False) -> None:
        """Held lines as a piece of their record."""
        self.rows.append((self.at[0], self.record, self.line - len(self.held), torn, "\n".join(self.held)))
        self.held, self.size, self.in_pieces = [], 0, True

    def add(self, lines: pa.Array) -> None:
        is_open = bool(self.held) or self.in_pieces
        after = np.empty(len(lines), bool)
        low = 0
        for k, text in _quoted(lines):
            after[low:k] = is_open
            is_open = after[k] = open_after(text, is_open)
            low = k + 1
        after[low:] = is_open
        texts, begin = lines.to_pylist(), 0
        file, first = self.at[0], self.line
        for end in np.flatnonzero(~after).tolist():
            if self.held or self.in_pieces:
                self.held += texts[begin : end + 1]
                self.line = first + end + 1
                if self.in_pieces:
                    self.hand_on()
                else:
                    self.rows.append((file, self.record, None, False, "\n".join(self.held)))
                self.held, self.size, self.in_pieces = [], 0, False
            else:
                text = texts[begin] if begin == end else "\n".join(texts[begin : end + 1])
                self.rows.append((file, first + begin, None, False, text))
            begin = end + 1
        if begin < len(texts):
            if not self.held and not self.in_pieces:
                self.record = first + begin
            self.held += texts[begin:]
            self.size += sum(map(len, texts[begin:]))
        self.line = first + len(texts)
        if self.size > HELD_CHARS:
            self.hand_on()

    def taken(self) -> pa.RecordBatch:
        rows = [r for r in self.rows if r[1] > self.starts[r[0], 0].header and (r[2] is not None or r[4].strip())]
        self.rows = []
        columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Splits depend on the cores at hand unless their least number is set; both passes need the same."""
    key = "spark.sql.files.minPartitionNum"
    given = spark.conf.get(key, None)
    if given is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if given is None:
            spark.conf.unset(key)


def headers(notes: Sequence) -> dict[str, str]:
    """The header record of each file."""
    found = {n["file"]: n["header"] for n in notes if n["start"] == 0}
    for file, header in found.items():
        if header is None:
            raise ValueError(f"no header ends within the first split of {file}")
        if "\r" in re.sub(r'"(?:[^"]|"")*+"', "", header):
            raise ValueError(f"lines that end with a carriage return alone are not read: {file}")
    return found


def notes_of(spark: SparkSession, paths: Sequence[str]) -> list:
    """The first pass: a note per split, files in order."""
    ship(spark)
    schema = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'boolean' if f.type == pa.bool_() else 'long'}" for f in _NOTE)
    return _lines(spark, paths).mapInArrow(follow, schema).collect()


def pieces_of(spark: SparkSession, paths: Sequence[str], notes: Sequence) -> DataFrame:
    """The second pass: (file, line, piece, torn, text), whole records having no piece."""
    starts = spark.sparkContext.broadcast(chain(notes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(starts.value)
        for batch in batches:
            for file, start, lines in _runs(batch):
                if cutter.at != (file, start):
                    cutter.enter(file, start)
                cutter.add(lines)
            yield cutter.taken()
        cutter.leave()
        yield cutter.taken()

    return _lines(spark, paths).mapInArrow(cut, "file string, line long, piece long, torn boolean, text string")


def assembled(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces."""
    part = F.sort_array(F.collect_list(F.struct("piece", "text")))
    return pieces.groupBy("file", "line").agg(F.max("torn").alias("torn"), F.array_join(part["text"], "\n").alias("text")).filter(F.trim("text") != "")
