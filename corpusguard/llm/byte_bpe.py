"""Byte-level byte-pair encoding and decoding."""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import map_texts, text_or_empty

#: A rank file may have at most so many bytes, for it goes to every task.
RANKS_BYTES = 64 << 20
#: Words remembered by a task before it starts afresh.
REMEMBERED = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 piece and a rank on each line."""
    with open(path, "rb") as f:
        data = f.read(RANKS_BYTES + 1)
    if len(data) > RANKS_BYTES:
        raise ValueError(f"{path} is larger than {RANKS_BYTES} bytes")
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, data.splitlines())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word: adjacent pieces merge, lowest rank first, leftmost among equals."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) > 64:
        return _encode_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    pairs = [get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs and (low := min(pairs)) < 1 << 60:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 60)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], 1 << 60)
    return tuple(ranks[p] for p in parts)


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges with a heap of pairs, for words that a scan per merge would make quadratic."""
    n = len(word)
    ends, after, before, alive = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n

    def rank(i: int) -> int | None:
        return ranks.get(word[i : ends[after[i]]]) if after[i] < n else None

    heap = [(r, i, ends[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or ends[after[i]] != end:
            continue
        j = after[i]
        alive[j], ends[i], after[i] = False, ends[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (r := rank(k)) is not None:
                heapq.heappush(heap, (r, k, ends[after[k]]))
    return tuple(ranks[word[i : ends[i]]] for i in range(n) if alive[i])


class _Words(dict):
    """The ids of words, merged once by each task."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self[word] = encode_word(word.encode("utf-8"), self.ranks)
        return ids


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids``, the token ids of every whole text.

    ``pattern`` splits a text into words; each word is merged for itself by the ranks in
    the file at ``ranks_path``. A task merges each distinct word once and remembers it,
    within a bound. The rank table is broadcast; its size is checked when it is read.

    Defined cases: null counts as empty, and an empty text has no ids; rows that repeat
    an id get a row each; a null id stays null; an empty table gives an empty result;
    other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def start():
        words, split = _Words(shared.value), regex.compile(pattern).findall

        def merge(texts: list[str]) -> list[pa.Array]:
            if len(words) > REMEMBERED:
                words.clear()
            ids = [np.fromiter(chain.from_iterable(map(words.__getitem__, split(t))), np.int32) for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]

        return merge

    return map_texts(docs, id_col, text_or_empty(text_col), {"ids": pa.list_(pa.int32())}, start)


def decode(ids: Column, ranks_path: str) -> Column:
    """The bytes that an array of ids stands for: its pieces, joined in hexadecimal and packed once.

    The pieces are a literal array, indexed by id. Null or empty ids give no bytes.
    """
    ranks = load_ranks(ranks_path)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.split(F.lit(" ".join(pieces)), " ")
    return F.unhex(F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: F.get(table, i)), ""))
