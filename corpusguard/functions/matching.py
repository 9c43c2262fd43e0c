"""Many keywords, or many globs, against each text or path in one walk."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import product

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.session import checkpointed

#: Bytes of keywords that one automaton is built of; larger tables make several.
BLOCK_BYTES = 8 << 20
#: Bytes of globs that one trie is built of; a node takes some 500 bytes in each worker.
TRIE_BYTES = 1 << 20
#: Characters of a part that globs are joined by.
ANCHOR = 32
#: Any number of directories in a glob that is being read.
DEEP = "\0"


def blocks(rows: DataFrame, column: str, limit: int | None = None) -> Iterator[list]:
    """The rows of a table in lists of at most ``limit`` bytes in ``column`` (of one row at least); one list is held at a time."""
    limit = BLOCK_BYTES if limit is None else limit
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(row[column].encode())
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def matcher(spark: SparkSession, shared: object, find: Callable[[object, str], Iterable[str]]) -> Callable[[Column], Column]:
    """A function on columns that gives what ``find`` finds of each text with ``shared``, which is broadcast: an array, empty for null."""
    held = spark.sparkContext.broadcast(shared)

    @F.arrow_udf("array<string>")
    def met(texts: pa.Array) -> pa.Array:
        value, found = held.value, []
        for at in range(0, len(texts), 256):  # few texts of a batch are Python's at once
            part = [[] if text is None else list(find(value, text)) for text in texts.slice(at, 256).to_pylist()]
            found.append(pa.array(part, pa.list_(pa.string())))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    return met


def keyword_automaton(keywords: Iterable[str]):
    """An Aho-Corasick automaton of the keywords; empty ones are left out."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word in keywords:
        if word:
            automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


def words_in(automaton, text: str) -> set[str]:
    """The keywords that are substrings of the text."""
    return {word for _, word in automaton.iter(text)} if len(automaton) else set()


def with_keywords(rows: DataFrame, text: Column, keywords: DataFrame, name: str = "keyword") -> DataFrame:
    """``rows`` with each keyword that is a substring of ``text``: a row for each pair, none for texts without any.

    ``keywords`` is a table with a column ``keyword``; empty and null ones are never met.
    An automaton of at most ``BLOCK_BYTES`` of keywords is broadcast; a larger table makes
    several, each of which reads the texts once. There is no shuffle of texts and the plan
    does not grow with the keywords.
    """
    found = None
    for block in blocks(keywords.where("keyword <> ''").select("keyword").distinct(), "keyword"):
        met = matcher(rows.sparkSession, keyword_automaton(r.keyword for r in block), words_in)
        part = rows.withColumn(name, F.explode(met(text)))
        found = part if found is None else found.unionByName(part)
    return rows.withColumn(name, F.lit(None).cast("string")).where("false") if found is None else found


def _alternatives(glob: str) -> list[str]:
    """A glob without its braces, one for each choice; ``**/`` becomes ``DEEP``, which no two pieces make together."""
    parts, at = [], 0
    while at < len(glob):
        opened = glob.find("{", at)
        closed = glob.find("}", opened) if opened >= 0 else -1
        if closed < 0:
            break
        parts += [[glob[at:opened]], glob[opened + 1 : closed].split(",")]
        at = closed + 1
    return ["".join(piece.replace("**/", DEEP) for piece in choice) for choice in product(*parts, [glob[at:]])]


def _segments(glob: str) -> list[list[str | None]]:
    """The parts of a path that a glob of ``_alternatives`` names; None stands for any number of parts.

    ``DEEP`` inside a part stands for nothing, or for the rest of that part and any more.
    """
    head, deep, rest = re.sub(f"{DEEP}+", DEEP, glob).partition(DEEP)
    if not deep:
        return [glob.split("/")]
    first, found = head.split("/"), []
    for tail in _segments(rest):
        if first[-1]:
            found += [[*first[:-1], first[-1] + tail[0], *tail[1:]], [*first[:-1], first[-1] + "*", None, *tail]]
        else:
            found.append([*first[:-1], None, *tail])
    return found


def _ways(listed: str) -> Iterator[list[str | None]]:
    """The parts of the paths that globs between ``|`` name, as :func:`_segments` gives them."""
    for glob in listed.split("|"):
        for plain in _alternatives(glob.strip()):
            yield from _segments(plain)


def _anchor(parts: list[str | None]) -> tuple[int, str, int, str] | None:
    """The longest text that a certain part of each path must be, begin or end with: place, kind, length and text; None if there is none.

    Places count from the first part (1) where no ``None`` stands before, else from the last (-1); a part
    between two is at any place (0). Of a part that begins or ends so, ``ANCHOR`` characters count.
    """
    deep = [i for i, part in enumerate(parts) if part is None] or [len(parts)]
    found = []
    for i, part in enumerate(parts):
        if part is None:
            continue
        place = i + 1 if i < deep[0] else i - len(parts) if i > deep[-1] else 0
        head, tail = re.match("[^*?]*", part)[0], re.search("[^*?]*$", part)[0]
        if head == part:
            found.append((len(part), i, (place, "whole", 0, part)))
        else:
            found.append((len(head[:ANCHOR]), i, (place, "head", len(head[:ANCHOR]), head[:ANCHOR])))
            found.append((len(tail[-ANCHOR:]), i, (place, "tail", len(tail[-ANCHOR:]), tail[-ANCHOR:])))
    size, _, anchor = max(found)
    return anchor if size else None


def _expression(parts: list[str | None]) -> str:
    """A regular expression, of Java too, for the whole paths that the parts name."""
    each = {"*": "[^/]*", "?": "[^/]"}
    found = ["(?:[^/]*/)*" if part is None else "".join(each.get(c, c if c.isalnum() or c in "_/" else f"\\x{{{ord(c):x}}}") for c in part) + "/" for part in parts]
    return r"\A" + "".join(found)[:-1] + r"\z"


class _Node:
    """A place in the trie: the parts that may follow, by kind, and the ids of globs that end here."""

    __slots__ = ("literal", "prefix", "suffix", "other", "heads", "tails", "deep", "loops", "ids")

    def __init__(self):
        self.literal, self.prefix, self.suffix, self.other = {}, {}, {}, {}
        self.heads, self.tails = set(), set()  # the lengths of the keys of prefix and suffix
        self.deep, self.loops, self.ids = None, False, []


class GlobTrie:
    """Globs as a trie over the parts of a path.

    Literal parts are looked up, parts of a literal and one ``*`` are looked up by their
    first or last letters, and only parts with more wildcards are tried one by one. The
    walk of a path keeps the nodes that its parts so far lead to.
    """

    def __init__(self, globs: Iterable[tuple[str, str]] = ()):
        self.root = _Node()
        for ioc, listed in globs:
            for parts in _ways(listed):
                self.add(ioc, parts)

    def add(self, ioc: str, parts: list[str | None]) -> None:
        node = self.root
        for part in parts:
            if part is None:
                if node.deep is None:
                    node.deep = _Node()
                    node.deep.loops = True
                node = node.deep
                continue
            plain = re.split(r"[*?]", part)
            if len(plain) == 1:
                kind, key = node.literal, part
            elif len(plain) == 2 and "*" in part and not plain[0]:
                kind, key = node.suffix, plain[1]
            elif len(plain) == 2 and "*" in part and not plain[1]:
                kind, key = node.prefix, plain[0]
            else:
                kind, key = node.other, part
            if kind is node.prefix or kind is node.suffix:
                (node.heads if kind is node.prefix else node.tails).add(len(key))
            if key not in kind:
                kind[key] = _Node() if kind is not node.other else (re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in part) + r"\Z", re.S), _Node())
            node = kind[key] if kind is not node.other else kind[key][1]
        node.ids.append(ioc)

    def met(self, path: str) -> set[str]:
        """The ids of the globs that name the path."""
        nodes = self._reached([self.root])
        for part in path.split("/"):
            nodes = self._reached(following for node in nodes for following in self._step(node, part))
            if not nodes:
                return set()
        return {ioc for node in nodes for ioc in node.ids}

    @staticmethod
    def _reached(nodes: Iterable[_Node]) -> list[_Node]:
        """The nodes and those that any number of parts, none included, leads to."""
        found = {}
        for node in nodes:
            while node is not None and id(node) not in found:
                found[id(node)] = node
                node = node.deep
        return list(found.values())

    @staticmethod
    def _step(node: _Node, part: str) -> Iterator[_Node]:
        if node.loops:
            yield node
        if part in node.literal:
            yield node.literal[part]
        for kind, lengths, cut in ((node.prefix, node.heads, lambda n: part[:n]), (node.suffix, node.tails, lambda n: part[len(part) - n :])):
            for n in lengths:
                if n <= len(part) and cut(n) in kind:
                    yield kind[cut(n)]
        for pattern, following in node.other.values():
            if pattern.match(part):
                yield following


def glob_matcher(spark: SparkSession, globs: Iterable[tuple[str, str]]) -> Callable[[Column], Column]:
    """A function on columns of paths: the ids of the ``(id, glob)`` that name each path, in order."""
    return matcher(spark, GlobTrie(globs), lambda trie, path: sorted(trie.met(path)))


#: A row for each way in which a glob may name paths.
_WAYS = "ioc_id string, parts array<string>, expression string, place int, kind string, size int, key string, bytes long"


def _glob_ways(globs: DataFrame) -> DataFrame:
    """The globs taken apart by tasks, with what paths are joined by (a null kind where nothing is)."""

    def take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.iloc[at : at + 2_000]
                rows = [(ioc, way, _expression(way), *(_anchor(way) or (0, None, 0, "")), len(glob)) for ioc, glob in zip(part["ioc_id"], part["glob"]) for way in _ways(glob)]
                yield pd.DataFrame(rows, columns=["ioc_id", "parts", "expression", "place", "kind", "size", "key", "bytes"])

    return globs.where("ioc_id IS NOT NULL AND glob IS NOT NULL").select("ioc_id", "glob").mapInPandas(take_apart, _WAYS)


def _anchored(paths: DataFrame, ways: DataFrame, shapes: DataFrame) -> DataFrame:
    """``_path, ioc_id`` by a join of the texts at which globs of some shapes (place, kind and size) and paths meet; the whole path decides."""
    n = F.size("_parts")
    placed = paths.select("_path", F.split("_path", "/", -1).alias("_parts")).select("_path", n.alias("n"), F.posexplode("_parts").alias("i", "part"))
    placed = placed.select("_path", "part", F.explode(F.array(F.col("i") + 1, F.col("i") - F.col("n"), F.lit(0))).alias("place"))
    cut = F.when(F.col("kind") == "head", F.expr("substring(part, 1, size)")).when(F.col("kind") == "tail", F.expr("right(part, size)")).otherwise(F.col("part"))
    keyed = placed.join(F.broadcast(shapes), "place").where("length(part) >= size").select("_path", "place", "kind", "size", cut.alias("key"))
    met = keyed.join(ways.join(F.broadcast(shapes), ["place", "kind", "size"], "left_semi"), ["place", "kind", "size", "key"])
    return met.where(F.expr("_path RLIKE expression")).select("_path", "ioc_id").distinct()


def with_globs(rows: DataFrame, path: Column, globs: DataFrame, name: str = "ioc_id") -> DataFrame:
    """``rows`` with the id of each glob that names ``path``: a row for each pair, none for paths without any.

    ``globs`` is a table ``(ioc_id, glob)``. Globs are put by the place, the kind and the length of the longest text that
    a part of their paths must hold. The shapes that few globs have, ``TRIE_BYTES`` together, make a trie that is broadcast;
    those of many are joined to the paths by that text, so that neither a trie nor the passes
    over the paths grow with the table. Globs without such a text make tries of ``TRIE_BYTES``, each of which reads the paths once.
    """
    spark = rows.sparkSession
    ways = checkpointed(_glob_ways(globs))
    sums = ways.where("kind IS NOT NULL").groupBy("place", "kind", "size").agg(F.sum("bytes").alias("bytes"))
    shapes, held = [], 0  # places, kinds and lengths: their number does not grow with the globs
    for row in sorted(sums.collect(), key=lambda r: (r.bytes, r.place, r.kind, r.size)):
        held += row.bytes
        if held > TRIE_BYTES:
            shapes.append((row.place, row.kind, row.size))
    joined = spark.createDataFrame(shapes, "place int, kind string, size int")
    few = ways.join(F.broadcast(joined), ["place", "kind", "size"], "left_anti") if shapes else ways
    found = []
    for block in blocks(few.select("ioc_id", "parts", F.concat_ws("/", "parts").alias("text")), "text", TRIE_BYTES):
        trie = GlobTrie()
        for row in block:
            trie.add(row.ioc_id, row.parts)
        met = matcher(spark, trie, lambda trie, text: sorted(trie.met(text)))
        found.append(rows.withColumn(name, F.explode(met(path))))
    if shapes:
        wanted = rows.withColumn("_path", path)
        met = _anchored(wanted.select("_path").where("_path IS NOT NULL").distinct(), ways, joined)
        found.append(wanted.join(met.withColumnRenamed("ioc_id", "_ioc"), "_path").drop("_path").withColumn(name, F.col("_ioc")).drop("_ioc"))
    if not found:
        return rows.withColumn(name, F.lit(None).cast("string")).where("false")
    return reduce(DataFrame.unionByName, found).distinct()
