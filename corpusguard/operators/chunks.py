"""Measures of files that lie in many pieces, from summaries of the pieces that are put together in any grouping."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog

#: Pieces whose summaries are put together in one step; a file of more takes two steps.
TOGETHER = 1_000
#: Pieces, and bytes of them, that tasks hand on at once.
PIECES, PIECE_BYTES = 2_000, 1 << 20


def _batch(rows: list[tuple], names: tuple[str, str, str]) -> pa.RecordBatch:
    """Rows of a path, a number and bytes."""
    types = (pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names)


def chunked(files: DataFrame, size: int) -> DataFrame:
    """``path, number, content``: files in pieces of at most ``size`` bytes and three, cut between characters; an empty file is one piece."""

    def pieces(path, content: bytes) -> Iterator[tuple[str, int, bytes]]:
        start, number = 0, 0
        while start < len(content) or not number:
            end = start + size
            for _ in range(3):
                if end < len(content) and content[end] & 0xC0 == 0x80:
                    end += 1
            yield path, number, content[start:end]
            start, number = end, number + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bytes_held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for piece in pieces(path, content or b""):
                        held.append(piece)
                        bytes_held += len(piece[2])
                        if len(held) == PIECES or bytes_held > PIECE_BYTES:
                            yield _batch(held, ("path", "number", "content"))
                            held, bytes_held = [], 0
        if held:
            yield _batch(held, ("path", "number", "content"))

    return files.select("path", F.col("content").cast("binary")).mapInArrow(cut, "path string, number int, content binary")


def byte_counts(chunks: DataFrame) -> DataFrame:
    """``path, byte, n``: how often each byte occurs in all pieces of a file.

    A task counts its pieces into one histogram for each file and hands on what is not
    zero, 256 rows at most, which are summed map-side once more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = None, np.zeros(256, np.int64)

        def handed_on() -> pa.RecordBatch:
            met = np.flatnonzero(held)
            return pa.RecordBatch.from_arrays([pa.array([path] * len(met), pa.string()), pa.array(met, pa.int32()), pa.array(held[met])], names=["path", "byte", "n"])

        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != path:
                    yield handed_on()
                    path, held = at, np.zeros(256, np.int64)
                held += np.bincount(np.frombuffer(content or b"", np.uint8), minlength=256)
        yield handed_on()

    return chunks.select("path", "content").mapInArrow(count, "path string, byte int, n long").groupBy("path", "byte").agg(F.sum("n").alias("n"))


def entropy_of(counts: DataFrame, least: int = 50, digits: int | None = 4) -> DataFrame:
    """``path, entropy`` in bits a byte, from :func:`byte_counts`; files of fewer than ``least`` bytes have 0, files without a byte no row.

    The histograms are whole numbers, so the result is that of the whole file. A manifest takes 50 bytes and
    4 digits; code blocks take 100 bytes and no rounding (``digits`` None).
    """
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    entropy = F.abs(entropy if digits is None else F.round(entropy, digits))  # no negative zero
    return counts.groupBy("path").agg(F.when(total < least, 0.0).otherwise(entropy).alias("entropy"))


#: What opens and closes comments of several lines.
BLOCK_COMMENTS = (("/*", "*/"), ("<!--", "-->"))
_MARKS = [m for pair in BLOCK_COMMENTS for m in pair]
_SPACE = " \t\r\x0b\x0c"
#: Characters kept from a part's ends; no mark is longer than one more.
_EDGE = 7


class Part(NamedTuple):
    """What of a part of a line decides about the line: lengths, words, marks, and a few characters from its ends."""

    n: int = 0
    lead: int = 0
    trail: int = 0
    words: int = 0
    first: str = ""
    last: str = ""
    head: str = ""
    marks: int = 0

    @staticmethod
    def of(text: str) -> Part:
        bare = text.strip(_SPACE)
        lead, trail = len(text) - len(text.lstrip(_SPACE)), len(text) - len(text.rstrip(_SPACE))
        return Part(len(text), lead, trail, len(text.split()), text[:_EDGE], text[-_EDGE:], bare[:_EDGE] if len(bare) >= _EDGE else text.lstrip(_SPACE)[:_EDGE], _marks(text))

    @property
    def blank(self) -> bool:
        return self.lead == self.n

    def __add__(self, other: Part) -> Part:
        if not self.n or not other.n:
            return other if not self.n else self
        joined = not self.last[-1].isspace() and not other.first[0].isspace()
        return Part(
            self.n + other.n, self.n + other.lead if self.blank else self.lead, self.trail + other.n if other.blank else other.trail, self.words + other.words - joined,
            (self.first + other.first)[:_EDGE], (self.last + other.last)[-_EDGE:], other.head if self.blank else (self.head + other.first)[:_EDGE] if self.n - self.lead < _EDGE else self.head,
            self.marks | other.marks | _marks(self.last + other.first),
        )


def _marks(text: str) -> int:
    return sum(1 << i for i, m in enumerate(_MARKS) if m in text)


class Body(NamedTuple):
    """Whole lines: their counts, and for each state before them (no comment, or which kind is open) the state after them and their comment and code lines."""

    lines: int = 0
    blank: int = 0
    words: int = 0
    longest: int = 0
    total: int = 0
    effect: tuple = ((0, 0, 0), (1, 0, 0), (2, 0, 0))

    def __add__(self, other: Body) -> Body:
        met = tuple((*other.effect[state][:1], comments + other.effect[state][1], code + other.effect[state][2]) for state, comments, code in self.effect)
        return Body(self.lines + other.lines, self.blank + other.blank, self.words + other.words, max(self.longest, other.longest), self.total + other.total, met)


def line(part: Part, markers: tuple[str, ...]) -> Body:
    """A whole line: in which state it leaves what follows, for each state before it, and what it counts as."""
    if part.blank:
        return Body(1, 1, part.words, 0, 0)
    single = tuple(m for m in markers if m not in ("/*", "<!--"))
    effect = []
    for state in range(3):
        opened = state or next((i for i, (begin, _) in enumerate(BLOCK_COMMENTS, 1) if begin in markers and part.marks >> 2 * (i - 1) & 1), 0)
        comment = bool(opened) or bool(single) and part.head.startswith(single)
        closed = opened and part.marks >> (2 * opened - 1) & 1
        effect.append((0 if closed else opened, int(comment), int(not comment)))
    length = part.n - part.lead - part.trail
    return Body(1, 0, part.words, length, length, tuple(effect))


class Piece(NamedTuple):
    """A piece of a file: what belongs to the line that it begins in, its whole lines, and the beginning of its last line, if it has line ends."""

    head: Part
    body: Body | None = None
    tail: Part = Part()

    @staticmethod
    def of(text: str, markers: tuple[str, ...]) -> Piece:
        first, *rest = text.split("\n")
        if not rest:
            return Piece(Part.of(first))
        return Piece(Part.of(first), reduce(Body.__add__, (line(Part.of(x), markers) for x in rest[:-1]), Body()), Part.of(rest[-1]))

    def then(self, other: Piece, markers: tuple[str, ...]) -> Piece:
        """This piece and the one after it; any grouping of pieces gives the same."""
        if self.body is None:
            return Piece(self.head + other.head, other.body, other.tail)
        if other.body is None:
            return Piece(self.head, self.body, self.tail + other.head)
        return Piece(self.head, self.body + line(self.tail + other.head, markers) + other.body, other.tail)

    def whole(self, markers: tuple[str, ...]) -> Body:
        if self.body is None:
            return line(self.head, markers)
        return line(self.head, markers) + self.body + line(self.tail, markers)


def text_metrics(chunks: DataFrame) -> DataFrame:
    """The metrics of :func:`manifest.text_metrics` for files in pieces ``(path, number, content)``, cut anywhere between characters.

    A piece is a function from the state before it (in no comment, or in one of a kind) to the state
    after it and what its lines count as, with what its first and last line need of their
    neighbours. Such functions are put together in order by thousands, then these: no
    task reads a whole file, and a line of any length is a few numbers.
    """

    def markers_of(path: str) -> tuple[str, ...]:
        name = path.rsplit("/", 1)[-1]
        at = name.rfind(".")
        return tuple(catalog.COMMENT_MARKERS.get(name[at:].lower() if at > 0 else "", ()))

    columns = ("path", "number", "piece")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Summaries; those of neighbours that a task reads one after the other are put together at once, within thousands."""
        found, path, at, last, held = [], None, 0, 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, PIECES):
                part = batch.slice(start, PIECES)
                for p, number, content in zip(*(part.column(i).to_pylist() for i in range(3))):
                    markers = markers_of(p)
                    piece = Piece.of((content or b"").decode("utf-8", "replace"), markers)
                    if held is not None and p == path and number == last + 1 and number // TOGETHER == at // TOGETHER:
                        held, last = held.then(piece, markers), number
                        continue
                    if held is not None:
                        found.append((path, at, pickle.dumps(held)))
                    path, at, last, held = p, number, number, piece
                if found:
                    yield _batch(found, columns)
                    found = []
        if held is not None:
            yield _batch([(path, at, pickle.dumps(held))], columns)

    def runs(batches: Iterator[pa.RecordBatch], by: Callable[[str, int], object]) -> Iterator[tuple[str, int, Piece] | None]:
        """The rows of each key, which come one after the other in order, put together; None after each batch."""
        key, path, number, held = None, None, 0, None
        for batch in batches:
            for p, n, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is not None and by(p, n) == key:
                    held = held.then(pickle.loads(piece), markers_of(p))
                    continue
                if held is not None:
                    yield path, number, held
                key, path, number, held = by(p, n), p, n, pickle.loads(piece)
            yield None
        if held is not None:
            yield path, number, held
        yield None

    def by_thousands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for run in runs(batches, lambda path, number: (path, number // TOGETHER)):
            if run is not None:
                found.append((*run[:2], pickle.dumps(run[2])))
            elif found:
                yield _batch(found, columns)
                found = []

    def of_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for run in runs(batches, lambda path, number: path):
            if run is not None:
                body = run[2].whole(markers_of(run[0]))
                found.append((run[0], body.lines, body.blank, *body.effect[0][1:], body.words, body.longest, body.total))
            elif found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(zip(*found))], names=["path", *names])
                found = []

    names = ("lines", "blank", "comments", "code", "words", "longest", "stripped_chars")
    schema = "path string, number int, piece binary"
    pieces = chunks.select("path", F.col("number").cast("int"), F.col("content").cast("binary")).mapInArrow(summarise, schema)
    part = F.floor(F.col("number") / TOGETHER)
    some = pieces.repartition("path", part).sortWithinPartitions("path", "number").mapInArrow(by_thousands, schema)
    return some.repartition("path").sortWithinPartitions("path", "number").mapInArrow(of_files, "path string, " + ", ".join(f"{n} long" for n in names))
