"""Packs token sequences of documents into training sequences of a fixed length."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from corpusguard.llm.runtime import fresh_names, stored, text_or_empty

#: A tokenizer file may have at most so many bytes, for each task loads it.
TOKENIZER_BYTES = 64 << 20
#: Words whose ids a Python worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Pieces that one task packs.
GROUP = 50_000
#: The bytes of ASCII words without control characters.
PRINTABLE = bytes(range(0x21, 0x7F))
#: The tokenizer's own split of such a word in lower case.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class _Words(dict):
    """The packed ids of words between ASCII white space.

    No token of this tokenizer spans white space. An ASCII word is lowered and split as
    the tokenizer would, and the parts go to its model; other words go through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.model, self.parts = self.tokenizer.model, {}

    def _part(self, part: str) -> bytes:
        found = self.model.tokenize(part)
        ids = self.parts[part] = found[0].id.to_bytes(4, "little") if len(found) == 1 else b"".join([t.id.to_bytes(4, "little") for t in found])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        if not word.translate(None, PRINTABLE):
            known = self.parts
            ids = b"".join(known.get(p) or self._part(p) for p in PARTS.findall(word.lower().decode()))
        else:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def start_afresh(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
            self.parts.clear()


#: The words of this Python worker, by tokenizer; workers serve many tasks.
_KNOWN: dict[str, _Words] = {}


def _definition(path: str) -> str:
    """The text of a tokenizer file, its size checked."""
    with open(path, "rb") as f:
        data = f.read(TOKENIZER_BYTES + 1)
    if len(data) > TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {TOKENIZER_BYTES} bytes")
    return data.decode()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids``: the ids of every whole text and ``end_id``, cut into pieces of at most ``capacity``.

    ``ids`` are little-endian unsigned 32-bit numbers in a binary column; ``start`` is the
    number of the document's ids before the piece. The tokenizer is one of words: nothing
    of it spans white space, so a worker tokenizes each distinct word once and remembers
    it, within a bound. Strings of special tokens in a text are ordinary text.

    Defined cases: null and empty texts are the one id ``end_id``; rows that repeat an
    id have pieces of their own each; a null id stays null; an empty table gives an
    empty result; other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_definition(tokenizer_path))
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    schema, last, width = pa.schema(fields), np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_path not in _KNOWN:
            _KNOWN[tokenizer_path] = _Words(shared.value)
        words = _KNOWN[tokenizer_path]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words.start_afresh()
                pieces = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = b"".join(map(words.__getitem__, text.split())) + last
                    pieces += [(doc_id, n, start // 4, len(held) // 4, held) for n, start in enumerate(range(0, len(ids), width)) if (held := ids[start : start + width])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*pieces), fields)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(cut, from_arrow_schema(schema))


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item, by sums of squares.

    Items come longest first. Of the open bins that can take an item, it goes where the
    sum of the squared numbers of open bins per residual gap becomes smallest (Csirik et
    al., On the Sum-of-Squares Algorithm for Bin Packing, 2006); of equals the smallest gap.
    A bin is opened where none can take the item.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts, opened = np.zeros(capacity + 1, np.int64), 0  # a full bin is not open: its count stays zero
    for item in np.argsort(-lengths, kind="stable"):
        length = int(lengths[item])
        here = counts[length:capacity]
        fits = np.flatnonzero(here)
        if fits.size:
            # from gap g to g - length the sum changes by 2 (N(g - length) - N(g)) + 2, and by 1 - 2 N(g) if the bin is full then
            change = 2 * (counts[fits] - here[fits]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * here[0]
            gap = length + int(fits[change.argmin()])
            chosen = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = capacity, opened
            opened += 1
        bins[item], offsets[item], left = chosen, capacity - gap, gap - length
        if left:
            open_bins[left].append(chosen)
            counts[left] += 1
    return bins, offsets


def packed(pieces: DataFrame, capacity: int = 4096, length_col: str = "length") -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``: where each lies in sequences of at most ``capacity``.

    A piece of full length is a sequence by itself. The others are dealt at random to
    groups of some ``GROUP`` pieces, whose number grows with the table, and each group is packed by ``place``
    in a task; only row numbers and lengths are shuffled to it. A group ends with
    at most a few sequences that are not full.

    Defined cases: null lengths and lengths below one or above ``capacity`` are an
    error; repeated rows are packed each; an empty table gives an empty result; columns
    of these names are kept under their own and the new ones get names with ``_`` added.
    """
    row, group = fresh_names(pieces, "row", "group")
    sequence, offset = fresh_names(pieces, "sequence_id", "offset")
    keyed = stored(pieces.withColumn(row, F.monotonically_increasing_id()))
    length = F.col(length_col)
    bad, short = keyed.agg(F.count_if(length.isNull() | (length < 1) | (length > capacity)), F.count_if(length < capacity)).first()
    if bad:
        raise ValueError(f"{bad} lengths are not between 1 and {capacity}")
    groups = max(1, -(-short // GROUP))
    narrow = keyed.where(length < capacity).select(F.pmod(F.xxhash64(row), F.lit(groups)).alias(group), F.col(row), length.cast("int").alias("length"))

    def pack(part: pa.Table) -> pa.Table:
        bins, offsets = place(part.column("length").to_numpy(), capacity)
        # odd numbers are sequences of groups, even ones pieces that fill a sequence
        number = (part.column(group).to_numpy() << 32 | bins) << 1 | 1
        return pa.table({row: part.column(row), sequence: pa.array(number), offset: pa.array(offsets)})

    placed = narrow.groupBy(group).applyInArrow(pack, f"`{row}` long, `{sequence}` long, `{offset}` long")
    joined = keyed.join(placed, row, "left")
    return joined.select(*pieces.columns, F.coalesce(sequence, F.col(row) * 2).alias(sequence), F.coalesce(offset, F.lit(0).cast("long")).alias(offset))
