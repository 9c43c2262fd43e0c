"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusguard.llm.runtime import map_texts, text_or_empty

#: Words remembered by a task before it starts afresh.
REMEMBERED = 200_000


class LongestMatchAutomaton:
    """Counts the pieces of greedy longest-match tokenisation in one pass over the bytes.

    A trie of the vocabulary. Each node that is not a piece has a failure link to the
    node of what remains after the longest pieces of its string are popped, and the
    number of pieces so popped. A byte that no transition takes follows the link and adds
    that number; no piece is ever built. (Song et al., Fast WordPiece Tokenization, 2021.)
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}
        parent, byte, piece = [0], [0], [False]
        for word in vocabulary:
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self.step:
                    self.step[key] = len(parent)
                    parent.append(node)
                    byte.append(b)
                    piece.append(False)
                node = self.step[key]
            if node:
                piece[node] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        self.link, self.popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if piece[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            z, n = self.link[parent[v]], self.popped[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in self.step:
                n += self.popped[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.popped[v] = self.step[z << 8 | byte[v]], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; a word that the vocabulary cannot make up counts as one unknown piece."""
        step, link, popped = self.step, self.link, self.popped
        node = total = 0
        for b in word:
            while (to := step.get(node << 8 | b)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class _Counts(dict):
    """Counts of words, walked once by each task."""

    def __init__(self, automaton: LongestMatchAutomaton, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(self.prefix + word)
        return n


def token_counts(docs: DataFrame, vocabulary: Iterable[bytes], id_col: str = "doc_id", text_col: str = "text", prefix: bytes = b" ") -> DataFrame:
    """``id_col``, ``n_words`` and ``n_tokens`` of every whole text.

    Words are runs without ASCII white space; ``prefix`` marks the start of a word in
    the vocabulary. The automaton is built once and broadcast; its size is that of the
    vocabulary. There is no shuffle.

    Defined cases: null counts as empty, with no words and no tokens; rows that repeat
    an id get a row each; a null id stays null; an empty table gives an empty result;
    other columns are ignored whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatchAutomaton(vocabulary))

    def start():
        counts = _Counts(shared.value, prefix)

        def count(texts: list[bytes]) -> list[list[int]]:
            if len(counts) > REMEMBERED:
                counts.clear()
            words = [t.split() for t in texts]
            return [[len(w) for w in words], [sum(map(counts.__getitem__, w)) for w in words]]

        return count

    return map_texts(docs, id_col, text_or_empty(text_col).cast("binary"), {"n_words": pa.int64(), "n_tokens": pa.int64()}, start)
