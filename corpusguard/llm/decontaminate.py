"""Benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import broadcast_if_small, map_texts, text_or_empty

#: Benchmark text that one scan of the documents carries at most; more items take more scans.
ITEMS_BYTES = 32 << 20
#: Words remembered by a task before it starts afresh.
REMEMBERED = 200_000

_WORD = re.compile(r"\w+")
_ODD = 0x9E3779B97F4A7C15
_HIT = pa.struct([("item", pa.string()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64())])


class _Hashes(dict):
    """64-bit hashes of words, computed once by each task."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit hash for each run of ``shingle`` words (of all words, where there are fewer)."""
    size = min(shingle, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            total = total * np.uint64(_ODD) + words[i : i + len(total)]
        return _mixed(total + np.uint64(size))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)


def _packed(majority: np.ndarray) -> np.ndarray:
    return np.packbits(majority, axis=-1, bitorder="little").view("<u8").reshape(-1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles: shared over total occurrences."""
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class ItemIndex:
    """The benchmark items of one scan: fingerprints in blocks, and shingles that every match must share."""

    def __init__(self, items: list[tuple[str, str]], shingle: int, radius: int):
        words = _Hashes()
        self.shingle, self.radius = shingle, radius
        self.items, self.bags, self.prints, self.sizes = [], [], [], []
        anchors = defaultdict(set)
        for item, text in items:
            h = np.array([words[w] for w in _WORD.findall((text or "").lower())], np.uint64)
            if not len(h):
                continue
            s, number = shingle_hashes(h, shingle), len(self.items)
            self.items.append(item)
            self.bags.append(Counter(s.tolist()))
            self.sizes.append(len(h))
            self.prints.append(int(_packed(_bits(s).sum(0) * 2 > len(s))[0]))
            for x in s.tolist():
                anchors[min(shingle, len(h)), x].add(len(h))
        # radius + 1 blocks: two fingerprints within the radius agree in one of them at least
        edges = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        self.blocks = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:]) if b > a]
        self.table = defaultdict(list)
        for i, (p, n) in enumerate(zip(self.prints, self.sizes)):
            for block, (shift, mask) in enumerate(self.blocks):
                self.table[n, block, p >> shift & mask].append(i)
        self.anchors = {k: {x: sorted(n) for (size, x), n in anchors.items() if size == k} for k in sorted({k for k, _ in anchors})}
        self.known = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in self.anchors.items()}

    def near(self, fingerprint: int, size: int) -> set[int]:
        """The items of ``size`` words within the radius of a fingerprint: all of them, by the blocks."""
        met = {i for block, (shift, mask) in enumerate(self.blocks) for i in self.table.get((size, block, fingerprint >> shift & mask), ())}
        return {i for i in met if (self.prints[i] ^ fingerprint).bit_count() <= self.radius}

    def hits(self, words: np.ndarray, similarity: float) -> list[dict]:
        """The best window for each item that the text holds."""
        best: dict[int, tuple] = {}
        for k, known in self.known.items():
            if len(words) < k:
                continue
            s = shingle_hashes(words, k)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            places = np.flatnonzero(known[at] == s)
            if not len(places):
                continue
            starts = defaultdict(set)  # windows of an item's size that hold a shingle of such an item
            for p in places.tolist():
                for size in self.anchors[k][int(s[p])]:
                    starts[size].update(range(max(0, p + k - size), min(p, len(words) - size) + 1))
            for size, begins in starts.items():
                begins = np.array(sorted(begins), np.int64)
                span = size - k + 1
                for run in np.split(begins, np.flatnonzero(np.diff(begins) > 1) + 1) if len(begins) else []:
                    for cut in range(0, len(run), 4096):
                        part = run[cut : cut + 4096]
                        sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), _bits(s[part[0] : part[-1] + span])]), axis=0)
                        prints = _packed((sums[span:] - sums[:-span]) * 2 > span)
                        for begin, fp in zip(part.tolist(), prints.tolist()):
                            for i in self.near(fp, size):
                                exact = weighted_similarity(Counter(s[begin : begin + span].tolist()), self.bags[i])
                                key = (exact, -begin)
                                if exact >= similarity and (i not in best or key > best[i][0]):
                                    best[i] = (key, begin, size, (self.prints[i] ^ fp).bit_count())
        return [{"item": self.items[i], "start_word": b, "n_words": n, "distance": d, "similarity": k[0]} for i, (k, b, n, d) in sorted(best.items())]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle: int = 5, similarity: float = 0.8, radius: int = 18,
) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Words are runs of word characters in lower case. A window has as many words as the
    item; its SimHash is the majority over its five-word shingles. ``radius + 1`` blocks
    index the items' fingerprints, so that every item within the radius of a window is
    found, and the weighted similarity of the shingles (exact, with their counts) must
    then be 0.8 or more. At that similarity fingerprints differ by 10 bits on average;
    the radius of 18 is three standard deviations above. Windows are formed only where
    the text shares a shingle with an item of their size, which every window of a
    similarity above 0 does, so that nothing is lost.

    The benchmark goes to the tasks in blocks of at most 32 MB; a larger one takes more
    scans of the documents. Documents are never shuffled.

    Defined cases: null and empty documents hold nothing; null and empty items are in
    nothing; an item of fewer than five words is one shingle; equal items are each
    found; rows that repeat an id get rows each; an empty table gives an empty result;
    other columns are ignored whatever their names.

    Returns ``id_col``, ``item``, ``start_word``, ``n_words``, ``distance``, ``similarity``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), text_or_empty(item_text_col).alias("_text")).distinct()
    size = items.agg(F.sum(F.octet_length("_text") + 64)).first()[0] or 0
    scans = -(-size // (ITEMS_BYTES // 2)) or 1
    found = None
    for scan in range(scans):
        part = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(scans)) == scan) if scans > 1 else items
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most about 32 MB

        def start(shared=shared):
            index, hashes, find = ItemIndex(shared.value, shingle, radius), _Hashes(), _WORD.findall

            def search(texts: list[str]) -> list[list]:
                if len(hashes) > REMEMBERED:
                    hashes.clear()
                words = [find(t.lower()) for t in texts]
                return [[index.hits(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), similarity) for w in words]]

            return search

        rows = map_texts(docs, id_col, text_or_empty(text_col), {"hits": pa.list_(_HIT)}, start).select(id_col, F.inline("hits"))
        found = rows if found is None else found.union(rows)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with all its columns, without the documents that hold a benchmark item.

    A document without an id stays unless another document without an id is dropped.
    Other columns stay, whatever their names. The ids that go are joined in a broadcast where
    they are small; only beyond that are texts shuffled.
    """
    bad = contaminated(docs, benchmark, id_col, text_col, **settings).select(F.col(id_col).alias("_bad")).distinct()
    bad = broadcast_if_small(bad)
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
