"""The file tree source: what it lists, opens and remembers."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from corpusguard.sources import sinks, tree
from corpusguard.streaming import operators as streams


@pytest.fixture
def loaded(spark):
    tree.register(spark)

    def load(root, **options):
        return spark.read.format("filetree").options(root=str(root), **options).load()

    return load


def written(root, files):
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_files_outside_the_filters_are_not_opened(loaded, tmp_path):
    written(tmp_path, {"src/a.php": b"1", "src/deep/b.php": b"22", "src/c.txt": b"3", "other/d.php": b"4", "src/big.php": b"x" * 5000})
    for name in ("src/c.txt", "other/d.php", "src/big.php"):  # a reader that opened one of these would fail
        os.remove(tmp_path / name)
        os.symlink("/proc/1/mem" if name != "src/big.php" else tmp_path / "huge", tmp_path / name)
    (tmp_path / "huge").write_bytes(b"x" * 5000)
    os.chmod(tmp_path / "huge", 0)
    found = loaded(tmp_path).where("path LIKE 'src/%' AND extension = '.php' AND length < 1000")
    assert paths(found) == ["src/a.php", "src/deep/b.php"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)  # all of it is the source's


def test_a_prefix_keeps_folders_from_being_listed(tmp_path, monkeypatch):
    written(tmp_path, {"src/a/x": b"1", "src/b/y": b"2", "lib/z": b"3", "top": b"4"})
    listed, scandir = [], os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: listed.append(os.path.relpath(p, tmp_path)) or scandir(p))
    reader = tree.TreeReader({"root": str(tmp_path), "prefix": "src/b"})
    assert [part.value for part in reader.partitions()] == [[("src/b", False, 1, 0)]] and listed == [".", "src", "src/b"]
    files = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("path").to_pylist()]
    assert files == ["src/b/y"]


FILTERS = ["path = 'src/a.php'", "path IN ('src/a.php', 'lib/.b.JS')", "path LIKE 'src/%'", "extension = '.js'", "extension IN ('', '.php')", "length > 3", "length >= 3", "length < 3", "length <= 3", "length = 3",
           "path LIKE '%php'", "path LIKE 'src/%' OR length > 3", "extension <> '.php'", "path IS NULL", "path LIKE 'src/%' AND path LIKE '%c' AND length IS NOT NULL AND length > 0"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_give_what_spark_gives(spark, loaded, tmp_path, condition):
    contents = {"src/a.php": b"123", "lib/.b.JS": b"1234", "src/.htaccess": b"", "c.tar.gz": b"12", "src/d.": b"12345", "src/x/.user.ini": b"123"}
    written(tmp_path, contents)
    all_files = loaded(tmp_path).cache()  # the filters then are Spark's own
    assert {r.path: (bytes(r.content), r.length) for r in all_files.collect()} == {k: (v, len(v)) for k, v in contents.items()}
    want = paths(all_files.where(condition))
    all_files.unpersist()
    assert paths(loaded(tmp_path).where(condition)) == want


def test_a_flat_folder_makes_many_partitions(loaded, tmp_path):
    written(tmp_path, {f"flat/{i}.txt": b"x" * 10 for i in range(3000)} | {f"small{i}/a": b"y" for i in range(40)})
    found = loaded(tmp_path, partitionFiles="100")
    parts = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 3040 and 30 <= len(parts) <= 40 and max(r["count"] for r in parts) < 200
    by_bytes = loaded(tmp_path, partitionBytes="3000").where("path LIKE 'flat/%'")
    assert by_bytes.rdd.getNumPartitions() == 10 and by_bytes.count() == 3000


def test_batches_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "BATCH_BYTES", 100)
    written(tmp_path, {f"f{i}": b"z" * 40 for i in range(10)})
    reader = tree.TreeReader({"root": str(tmp_path)})
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [3, 3, 3, 1]


def test_empty_tree_and_links(spark, loaded, tmp_path):
    assert loaded(tmp_path).count() == 0
    written(tmp_path, {"a/b": b"1"})
    os.symlink(tmp_path, tmp_path / "a" / "around")
    assert paths(loaded(tmp_path)) == ["a/b"] and paths(loaded(tmp_path / "none")) == []


def test_saved_trees(spark, loaded, tmp_path):
    rows = spark.createDataFrame([("a/.b", bytearray(b"1")), ("c", None)], "path string, content binary")
    assert sinks.save_tree(rows, str(tmp_path / "t")) == 2 and sinks.save_tree(rows.where("false"), str(tmp_path / "t")) == 0
    assert {(r.path, bytes(r.content)) for r in loaded(tmp_path / "t").collect()} == {("a/.b", b"1"), ("c", b"")}
    with pytest.raises(Exception, match="not a path below"):
        sinks.save_tree(spark.createDataFrame([("../x", bytearray(b"1"))], "path string, content binary"), str(tmp_path / "t"))


def drained(spark, root, **options):
    """The paths that the next run of a stream from the same progress gives."""
    got = []
    files = spark.readStream.format("filetree").options(root=str(root / "tree"), log=str(root / "log"), **options).load()
    run = files.writeStream.option("checkpointLocation", str(root / "progress")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend((r.path, bytes(r.content)) for r in df.collect())).start()
    run.awaitTermination()
    return sorted(got)


def test_a_stream_gives_each_file_once(spark, tmp_path):
    tree.register(spark)
    written(tmp_path / "tree", {".htaccess": b"a", "x/.user.ini": b"b", "x/y.php": b"c"})
    assert drained(spark, tmp_path) == [(".htaccess", b"a"), ("x/.user.ini", b"b"), ("x/y.php", b"c")]
    assert drained(spark, tmp_path) == []
    written(tmp_path / "tree", {"x/new": b"d", "x/y.php": b"changed"})
    assert drained(spark, tmp_path) == [("x/new", b"d"), ("x/y.php", b"changed")]
    assert drained(spark, tmp_path) == []


def test_the_log_replays_folds_and_forgets(tmp_path, monkeypatch):
    monkeypatch.setattr(tree.TreeStreamReader, "FOLD", 2)
    options = {"root": str(tmp_path / "tree"), "log": str(tmp_path / "log"), "lateness": "100"}
    files = lambda reader, start, end: [p for part in reader.partitions(start, end) for p in part.value]
    start = tree.TreeStreamReader(options).initialOffset()
    for i, age in enumerate((1000, 950, 500)):
        written(tmp_path / "tree", {f"f{i}": b"x"})
        os.utime(tmp_path / "tree" / f"f{i}", (10_000 - age, 10_000 - age))
        reader = tree.TreeStreamReader(options)  # a new process each time
        end = reader.latestOffset()
        assert end == {"entry": i + 1} == tree.TreeStreamReader(options).latestOffset()  # an offer that was not taken is not made twice
        assert files(reader, start, end) == files(tree.TreeStreamReader(options), start, end) == [f"f{i}"]
        reader.commit(end)
        start = end
    assert sorted(os.listdir(tmp_path / "log")) == ["entry-000000000003", "folded-000000000002"]
    written(tmp_path / "tree", {"late": b"x", "fresh": b"x"})
    os.utime(tmp_path / "tree" / "late", (9_300, 9_300))
    os.utime(tmp_path / "tree" / "fresh", (9_450, 9_450))
    reader = tree.TreeStreamReader(options)
    assert files(reader, start, reader.latestOffset()) == ["fresh"]
    assert [json.loads(x)[0] for x in (tmp_path / "log" / "entry-000000000004").read_text().splitlines()] == ["fresh"]


def test_bounded_batches_of_a_stream(tmp_path):
    written(tmp_path / "tree", {f"f{i}": b"x" for i in range(5)})
    reader = tree.TreeStreamReader({"root": str(tmp_path / "tree"), "log": str(tmp_path / "log"), "maxfiles": "2"})
    sizes = []
    start = reader.initialOffset()
    while (end := reader.latestOffset()) != start:
        sizes.append(sum(len(part.value) for part in reader.partitions(start, end)))
        start = end
    assert sizes == [2, 2, 1]


def test_a_batch_of_a_stream_reads_each_file_once_and_in_many_parts(spark, tmp_path):
    """The checks of settings come with the rules, in one reading of a batch; a batch is dealt to many tasks before a task has its full share."""
    tree.register(spark)
    settings = {"conf/.htaccess": b"php_value auto_prepend_file /tmp/x.php\n", "conf/x/.user.ini": b"", "conf/y/.htaccess": b"# none\n"}
    written(tmp_path / "tree", {f"src/{i}.php": b"<?php eval($_POST['x']); ?>" for i in range(600)} | settings)
    files = spark.readStream.format("filetree").options(root=str(tmp_path / "tree"), log=str(tmp_path / "log")).load()
    got = []
    run = streams.check_arrivals(files).writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).foreachBatch(lambda df, _: got.extend((r.path, r.rule_id) for r in df.collect())).start()
    run.awaitTermination()
    assert sum(p["numInputRows"] for p in run.recentProgress) == 603
    assert {g for g in got if g[0].startswith("conf/")} == {("conf/.htaccess", "SEC080"), ("conf/.htaccess", "htaccess_directive"), ("conf/x/.user.ini", "user_ini")} and len({g for g in got if g[1] == "WEB000"}) == 600
    reader = tree.TreeStreamReader({"root": str(tmp_path / "tree"), "log": str(tmp_path / "log")})
    parts = [p.value for p in reader.partitions({"entry": 0}, {"entry": 1})]
    assert [len(p) for p in parts] == [500, 103] and len({f for p in parts for f in p}) == 603


def test_files_that_grow_or_do_not_tell_their_length_are_read_whole(tmp_path, monkeypatch):
    written(tmp_path, {"grown": b"x" * 20_000, "even": b"y" * 9_000, "none": b"", "large": b"z" * 30_000})
    stat = os.stat
    earlier = lambda p: os.stat_result((*stat(p)[:6], 10, *stat(p)[7:10]), {"st_mtime_ns": stat(p).st_mtime_ns}) if p.endswith(("grown", "large")) else stat(p)
    with monkeypatch.context() as patched:
        patched.setattr(tree.os, "stat", earlier)
        found = [r for b in tree.Tree(str(tmp_path), tree.Wanted(most=20_000)).contents(["grown", "even", "none", "large", "gone"]) for r in b.to_pylist()]
    assert [(r["path"], r["length"], len(r["content"])) for r in found] == [("grown", 20_000, 20_000), ("even", 9_000, 9_000), ("none", 0, 0)]


def test_the_log_keeps_odd_names(tmp_path):
    names = ["a], [b", 'q"\\', "n\nl", "é\u2028", os.fsdecode(b"\xff"), *(f"f{i}" for i in range(2500))]
    written(tmp_path / "tree", dict.fromkeys(names, b"1"))
    options = {"root": str(tmp_path / "tree"), "log": str(tmp_path / "log")}
    reader = tree.TreeStreamReader(options)
    end = reader.latestOffset()
    assert sorted(f for p in reader.partitions({"entry": 0}, end) for f in p.value) == sorted(names) and tree.TreeStreamReader(options).latestOffset() == end
