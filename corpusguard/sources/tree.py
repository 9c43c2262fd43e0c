"""A data source of file trees, batch and stream, that keeps dotfiles, which Spark's own file sources leave out."""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from itertools import islice

import pyarrow as pa
from pyspark.sql import datasource as ds

from corpusguard.catalogs import files as catalog

SCHEMA = pa.schema([("path", pa.string()), ("extension", pa.string()), ("length", pa.int64()), ("modified_at", pa.timestamp("us", "UTC")), ("content", pa.binary())])
#: Bytes and files that one partition reads, and that one Arrow batch holds.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 10_000
BATCH_BYTES, BATCH_FILES = 8 << 20, 1_000


def local_path(folder: str) -> str:
    """A folder as the executors' file systems name it; ``file:`` addresses lose their scheme."""
    return folder[folder.index("/") :].replace("///", "/", 1) if folder.startswith("file:") else folder


def extension_of(path: str) -> str:
    """The last suffix of a file's name in lower case, with its dot; none for a name that only begins with one."""
    stem, dot, suffix = path.rsplit("/", 1)[-1].rpartition(".")
    return (dot + suffix).lower() if stem and suffix else ""


@dataclass(frozen=True)
class Wanted:
    """Which files of a tree are read; every part must hold."""

    prefixes: tuple[str, ...] = ()
    paths: tuple[frozenset[str], ...] = ()
    extensions: tuple[frozenset[str], ...] = ()
    least: int = 0
    most: int = catalog.HASH_LIMIT

    def folder(self, path: str) -> bool:
        """Whether files below a folder (its path from the root, empty for the root) can be wanted."""
        inside = f"{path}/" if path else ""
        return all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes) and all(any(p.startswith(inside) for p in names) for names in self.paths)

    def name(self, path: str) -> bool:
        return all(path.startswith(p) for p in self.prefixes) and all(path in names for names in self.paths) and all(extension_of(path) in names for names in self.extensions)

    def size(self, length: int) -> bool:
        return self.least <= length <= self.most

    def narrowed(self, filter: ds.Filter) -> Wanted | None:
        """These files and the filter, or None if the filter is left to Spark."""
        name, value = getattr(filter, "attribute", ()), getattr(filter, "value", None)
        if isinstance(filter, ds.IsNotNull) and name in (("path",), ("extension",), ("length",)):
            return self
        if name == ("path",) and isinstance(filter, ds.StringStartsWith):
            return replace(self, prefixes=(*self.prefixes, value))
        if name in (("path",), ("extension",)) and isinstance(filter, (ds.EqualTo, ds.In)):
            field = "paths" if name == ("path",) else "extensions"
            return replace(self, **{field: (*getattr(self, field), frozenset(value if isinstance(filter, ds.In) else [value]))})
        if name == ("length",) and isinstance(value, int):
            if isinstance(filter, (ds.LessThan, ds.LessThanOrEqual)):
                return replace(self, most=min(self.most, value - isinstance(filter, ds.LessThan)))
            if isinstance(filter, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                return replace(self, least=max(self.least, value + isinstance(filter, ds.GreaterThan)))
        return None


class Tree:
    """A folder and what of it is wanted. Skipped directories and links to directories are not walked."""

    def __init__(self, root: str, wanted: Wanted):
        self.root, self.wanted = local_path(root).rstrip("/") or "/", wanted

    def files_in(self, folder: str, folders: list[str]) -> Iterator[tuple[str, os.stat_result]]:
        """The wanted files in a folder, by their paths from the root, one at a time; the folders in it come to ``folders``. What goes meanwhile is left out."""
        wanted = self.wanted
        any_name = not (wanted.prefixes or wanted.paths or wanted.extensions)
        try:
            entries = os.scandir(os.path.join(self.root, folder))
        except FileNotFoundError:
            return
        with entries:
            for entry in entries:
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in catalog.DIFF_SKIP_DIRS and wanted.folder(path):
                            folders.append(path)
                        continue
                    if not (any_name or wanted.name(path)) or not entry.is_file() or not wanted.size((told := entry.stat()).st_size):
                        continue
                except FileNotFoundError:
                    continue
                yield path, told

    def listed(self, folder: str) -> tuple[list[str], list[str]]:
        """The folders in a folder and its wanted files, in order, by their paths from the root."""
        folders = []
        files = sorted(path for path, _ in self.files_in(folder, folders))
        return sorted(folders), files

    def below(self, folder: str) -> Iterator[tuple[str, os.stat_result]]:
        """The wanted files below a folder."""
        waiting = [folder]
        while waiting:
            yield from self.files_in(waiting.pop(), waiting)

    def contents(self, paths: Iterable[str]) -> Iterator[pa.RecordBatch]:
        """The files as Arrow batches of bounded bytes; a file is judged by its present length before it is opened."""
        rows, held = [], 0
        for path in paths:
            place = os.path.join(self.root, path)
            try:
                told = os.stat(place)
                if not self.wanted.size(told.st_size):
                    continue
                with open(place, "rb", buffering=0) as f:
                    content = f.read(told.st_size + 1)
                if len(content) != told.st_size:  # another length by now, or one that is not told
                    with open(place, "rb") as f:
                        content = f.read(self.wanted.most + 1)
            except FileNotFoundError:
                continue
            if not self.wanted.size(len(content)):
                continue
            rows.append((path.encode("utf-8", "replace").decode(), extension_of(path), len(content), told.st_mtime_ns // 1000, content))
            held += len(content)
            if held >= BATCH_BYTES or len(rows) >= BATCH_FILES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


class TreeSource(ds.DataSource):
    """``spark.read.format("filetree").option("root", dir)``: the files below a folder that driver and executors can reach.

    Columns ``path`` (from the root), ``extension``, ``length``, ``modified_at`` and ``content``. Filters on
    ``path`` (equality, lists, prefixes), ``extension`` and ``length`` are pushed down:
    folders outside a prefix are not listed, and files that a filter or the option
    ``maxBytes`` leaves out are not opened. Names that are no UTF-8 show replacement characters.

    The driver lists folders in threads and keeps of each the number and bytes of its
    wanted files, no names. Folders are put together, and large ones split by a hash of the name, into
    partitions of some ``partitionBytes`` bytes or ``partitionFiles`` files; the tasks list their folders again. For
    trees too large to be listed by one process, ``depth`` says how many levels the driver lists;
    a folder at that depth is a partition with all below it.

    As a stream (``spark.readStream``) the source needs the option ``log``, a folder of its
    own in shared storage: see :class:`TreeStreamReader`.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return "path string, extension string, length bigint, modified_at timestamp, content binary"

    def reader(self, schema) -> ds.DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> ds.DataSourceStreamReader:
        return TreeStreamReader(self.options)


def _tree(options) -> Tree:
    prefix = options.get("prefix")
    return Tree(options["root"], Wanted(prefixes=(prefix,) if prefix else (), most=int(options.get("maxbytes", catalog.HASH_LIMIT))))


class TreeReader(ds.DataSourceReader):
    def __init__(self, options):
        self.tree, self.depth = _tree(options), int(options.get("depth", 1 << 30))
        self.bytes, self.files = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))

    def pushFilters(self, filters):
        for filter in filters:
            narrowed = self.tree.wanted.narrowed(filter)
            if narrowed is None:
                yield filter
            else:
                self.tree.wanted = narrowed

    def partitions(self):
        """Parts ``(folder, with all below, slices, slice)`` in the order of their levels, put together up to the wanted size."""
        parts, weight, ready = [], 0.0, []

        def add(part: tuple, share: float) -> None:
            nonlocal parts, weight
            if parts and weight + share > 1:
                ready.append(ds.InputPartition(parts))
                parts, weight = [], 0.0
            parts.append(part)
            weight += share

        level, depth = [""], 0
        with ThreadPoolExecutor(16) as pool:
            while level and depth < self.depth:
                following = []
                for folder, (folders, n, size) in zip(level, pool.map(self._measured, level)):
                    following += folders
                    share = max(size / self.bytes, n / self.files)
                    slices = max(1, math.ceil(share))
                    for number in range(slices if n else 0):
                        add((folder, False, slices, number), share / slices)
                level, depth = following, depth + 1
        for folder in level:
            add((folder, True, 1, 0), 1.0)
        return [*ready, ds.InputPartition(parts)]

    def _measured(self, folder: str) -> tuple[list[str], int, int]:
        folders, n, size = [], 0, 0
        for _, told in self.tree.files_in(folder, folders):
            n, size = n + 1, size + told.st_size
        return sorted(folders), n, size

    def read(self, partition):
        def paths() -> Iterator[str]:
            for folder, deep, slices, number in partition.value:
                for path in (p for p, _ in self.tree.below(folder)) if deep else self.tree.listed(folder)[1]:
                    if zlib.crc32(path.encode("utf-8", "surrogateescape")) % slices == number:
                        yield path

        return self.tree.contents(paths())


class TreeStreamReader(ds.DataSourceStreamReader):
    """Files as they come to a tree: each once, and again when its length or time of change is another.

    What a batch reads is written to the log before the batch is offered, and an offset
    is a number in the log: a batch that is replayed reads the same files, and a query that
    starts again goes on where it stood. Committed entries are folded into one list. A
    path is remembered until the newest file is ``lateness`` seconds (a week) newer; older
    files that come after that are left out. Files are read when they are complete if
    writers move them into the tree. ``maxFiles`` bounds a batch.
    """

    #: Committed entries of the log that are folded at once.
    FOLD = 20
    #: Partitions that a batch has at least, if they then hold so many files.
    SPREAD, SPREAD_FILES = 96, 500

    def __init__(self, options):
        self.tree, self.log = _tree(options), local_path(options["log"])
        self.lateness, self.most = int(float(options.get("lateness", 7 * 86400)) * 1e9), int(options.get("maxfiles", 1 << 60))
        self.bytes, self.files = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("partitionfiles", PARTITION_FILES))

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        os.makedirs(self.log, exist_ok=True)
        last, seen = self._known()
        newest = max((m for m, _ in seen.values()), default=None)
        fresh = []
        for path, told in self.tree.below(""):
            mark = (told.st_mtime_ns, told.st_size)
            if seen.get(path) != mark and (newest is None or path in seen or told.st_mtime_ns >= newest - self.lateness):
                fresh.append((path, *mark))
        if fresh:
            last += 1
            self._write(f"entry-{last:012d}", sorted(fresh, key=lambda f: (f[1], f[0]))[: self.most])
        return {"entry": last}

    def partitions(self, start: dict, end: dict):
        fresh = [(path, size) for number in range(start["entry"] + 1, end["entry"] + 1) for path, _, size in self._read(f"entry-{number:012d}")]
        files = min(self.files, max(self.SPREAD_FILES, math.ceil(len(fresh) / self.SPREAD)))
        parts, held, found = [], 0, []
        for path, size in fresh:
            if parts and (held + size > self.bytes or len(parts) >= files):
                found.append(ds.InputPartition(parts))
                parts, held = [], 0
            parts.append(path)
            held += size
        return [*found, ds.InputPartition(parts)] if parts else found

    def read(self, partition):
        return self.tree.contents(partition.value)

    def commit(self, end: dict) -> None:
        entries = [n for n in self._numbers("entry-") if n <= end["entry"]]
        if len(entries) < self.FOLD:
            return
        last = max(entries)
        _, seen = self._known(last)
        newest = max(m for m, _ in seen.values())
        self._write(f"folded-{last:012d}", [(p, *mark) for p, mark in seen.items() if mark[0] >= newest - self.lateness])
        for prefix, numbers in (("entry-", entries), ("folded-", [n for n in self._numbers("folded-") if n < last])):
            for n in numbers:
                os.remove(os.path.join(self.log, f"{prefix}{n:012d}"))

    def _numbers(self, prefix: str) -> list[int]:
        return sorted(int(n[len(prefix) :]) for n in os.listdir(self.log) if n.startswith(prefix) and ".tmp" not in n)

    def _known(self, until: int = 1 << 62) -> tuple[int, dict[str, tuple[int, int]]]:
        """The last number of the log and the files that it holds up to ``until``."""
        folded = max(self._numbers("folded-"), default=0)
        last, seen = folded, {p: (m, s) for p, m, s in (self._read(f"folded-{folded:012d}") if folded else ())}
        for n in self._numbers("entry-"):
            if folded < n <= until:
                last = n
                seen |= {p: (m, s) for p, m, s in self._read(f"entry-{n:012d}")}
        return last, seen

    def _read(self, name: str) -> Iterator[list]:
        with open(os.path.join(self.log, name), encoding="utf-8", errors="surrogateescape") as f:
            while lines := list(islice(f, 1000)):  # parsed at once
                yield from json.loads(f"[{','.join(lines)}]")

    def _write(self, name: str, rows: Iterable[tuple]) -> None:
        """A list of files, there as a whole or not at all."""
        path = os.path.join(self.log, name)
        with open(f"{path}.tmp-{os.getpid()}", "w", encoding="utf-8") as f:
            f.writelines(f"[{json.dumps(path)}, {changed}, {size}]\n" for path, changed, size in rows)
        os.replace(f.name, path)


def register(spark) -> None:
    """Makes the format known to a session, with the pushdown of filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
