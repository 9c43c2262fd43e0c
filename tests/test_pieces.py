import pyarrow as pa
"""Files in pieces, values carried across ranges, bounded groups, the SQL face of the scan, and snapshots as a stream."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusguard.functions import ranges
from corpusguard.operators import chunks, manifest, rollup, scan
from corpusguard.sources import interop
from corpusguard.streaming import operators as streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


WORDS = ["/*", "*/", "<!--", "-->", "//", "#", "--", "REM", " ", "\t", "\r", "\n", "\n\n", "x", "word", "é", "😀", " ", "\x85", "/", "*", "<", "!", "-", ">", "\xa0"]


def texts(n):
    rng = random.Random(n)
    return {f"d/{i}{rng.choice(['.php', '.js', '.html', '.sql', '.bat', '.txt', ''])}": "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))).encode() for i in range(n)}


def frame(spark, contents):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in contents.items()], "path string, content binary")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 10_000])
def test_metrics_of_pieces_are_those_of_the_file(spark, monkeypatch, size):
    monkeypatch.setattr(chunks, "TOGETHER", 3)
    contents = texts(150) | {"long.php": b"/* " + b"a " * 400 + b"*/ x\n" + b"y" * 500, "bad.php": b"\xff\xfe/*\x80\x80\x80\x80\n\xc3*/", "empty.js": b""}
    files = frame(spark, contents)
    pieces = chunks.chunked(files, size)
    assert rows(chunks.text_metrics(pieces)) == rows(manifest.text_metrics(files))
    assert {r.path: b"".join(bytes(x) for _, x in sorted(r.c)) for r in pieces.groupBy("path").agg(F.collect_list(F.struct("number", "content")).alias("c")).collect()} == contents


def test_any_grouping_of_pieces_is_the_same():
    rng = random.Random(4)
    for path, content in texts(200).items():
        markers = tuple(chunks.catalog.COMMENT_MARKERS.get("." + path.rsplit(".", 1)[-1], ()))
        text = content.decode()
        cuts = sorted(rng.sample(range(len(text) + 1), min(4, len(text) + 1)))
        parts = [chunks.Piece.of(text[a:b], markers) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        left, right = parts[0], parts[-1]
        for p in parts[1:]:
            left = left.then(p, markers)
        for p in parts[-2::-1]:
            right = p.then(right, markers)
        assert left.whole(markers) == right.whole(markers) == chunks.Piece.of(text, markers).whole(markers)


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_entropy_of_pieces(spark, pieces):
    rng = random.Random(pieces)
    contents = {f"f{i}": bytes(rng.randrange(1 + i * 5) for _ in range(rng.choice((0, 10, 49, 50, 700, 5000)))) for i in range(40)} | {"same": b"a" * 100}
    files = frame(spark, contents)
    counts = chunks.byte_counts(chunks.chunked(files, 5000 // pieces))
    want = files.where(F.length("content") > 0).select("path", manifest.byte_entropy(F.col("content")).alias("e"))
    assert rows(chunks.entropy_of(counts)) == rows(want)
    exact = dict(rows(chunks.entropy_of(counts, 100, None)))
    assert exact["same"] == 0.0 and all(abs(exact[p] - (e if len(contents[p]) >= 100 else 0)) < 1e-4 for p, e in rows(want))
    assert rows(chunks.byte_counts(frame(spark, {"n": None}))) == []


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_values_are_carried_across_ranges(spark, n):
    rng = random.Random(n)
    data = [(g, at, rng.choice([None, None, None, f"v{at}"])) for g in ("a", "b", None, "long") for at in range(60 if g == "long" else rng.randint(1, 8))]
    frame_ = spark.createDataFrame(data, "g string, at int, v string")
    want, last = [], {}
    for g, at, v in data:
        last[g] = v or last.get(g)
        want.append((g, at, v, last[g]))
    found = ranges.last_known(frame_, "g", "at", F.col("v"), "carried", n)
    assert rows(found) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 6])
def test_signature_output_cut_inside_matches(spark, n):
    out = ["0x1:$a: lost", "Rule one", "0x1:$a: " + "z" * 300, "  ", "0x2:$b:x:y", "0x3 bad", "lonely", "0x4:$c: lost", "Two  file b.php", "Three c", "0x5:$d: ", "0x6:$e: e"]
    lines = spark.createDataFrame([(f, i, t) for f in ("f", "g") for i, t in enumerate(out)] + [("h", 0, None), ("h", 1, "0x1:$a: b")], "file string, line int, text string")
    one = [("Rule", "one", ["z" * 200, "x:y"]), ("Two", "file b.php", []), ("Three", "c", ["", "e"])]
    found = [(r.file, r.rule, r.target, r.strings) for r in interop.signature_matches(lines, n).collect()]
    assert sorted(found) == sorted((f, *m) for f in ("f", "g") for m in one)
    strings = rows(interop.signature_strings(lines, n).where("file = 'f' AND rule = 'Rule'").drop("file", "data"))
    assert strings == [(1, "Rule", "one", 2, "0x1", "$a"), (1, "Rule", "one", 4, "0x2", "$b"), (1, "Rule", "one", None, None, None)]


def test_groups_are_bounded_before_the_shuffle(spark):
    found = spark.createDataFrame([(c, s, f"p{i}", i, "r") for c, n in (("a", 30), ("b", 2), (None, 3)) for i in range(n) for s in [["LOW", "CRITICAL"][i % 2]]], "category string, severity string, path string, line int, rule_id string")
    capped = rollup.capped_by_category(found, 5)
    assert sorted((str(r.category), r.severity, r.path) for r in capped.collect()) == sorted(
        [("a", "CRITICAL", p) for p in ("p1", "p11", "p13", "p15", "p17")] + [("b", "LOW", "p0"), ("b", "CRITICAL", "p1"), ("None", "LOW", "p0"), ("None", "CRITICAL", "p1"), ("None", "LOW", "p2")]
    )
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("WindowGroupLimit", plan.split("Initial Plan")[0])) == 2  # in the tasks that read, and after the shuffle
    assert [r.signals for r in rollup.suspicious_files(found.selectExpr("'f' AS path", "concat('s', line % 3) AS source", "concat('r', line) AS rule_id", "severity")).collect()] == [
        [f"s{i % 3}:r{i}" for i in sorted(range(1, 30, 2), key=lambda i: f"s{i % 3}:r{i}")][:10]
    ]


def test_the_scan_in_sql(spark):
    texts_ = ["mail bob@example.com or (555) 555-1234", "4111 1111 1111 1111", None, "", "nothing", "password = 'hunter2hunter2' a@b.cc"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts_)], "path string, line int, text string")
    scan.register_sensitive(spark)
    lines.createOrReplaceTempView("pieces_lines")
    found = spark.sql("SELECT path, line, s.* FROM pieces_lines, LATERAL sensitive_data(text) AS s")
    want = scan.sensitive_scan(lines.where("text IS NOT NULL"))
    assert found.columns == want.columns and rows(found) == rows(want) and len(rows(found)) >= 4
    assert {r.data_type for r in spark.sql("SELECT s.* FROM pieces_lines, LATERAL sensitive_data(text, 'email') AS s").collect()} == {"email"}
    for wrong in ("sensitive_data(line)", "sensitive_data(text, 'none')", "sensitive_data(text, text)"):
        with pytest.raises(Exception, match="must be|data type"):
            spark.sql(f"SELECT s.* FROM pieces_lines, LATERAL {wrong} AS s").collect()


def test_files_that_go_are_told(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    streams.use_rocksdb(spark)
    got = []
    days = [
        [("kept", "1"), ("changed", "1"), ("gone", "1"), ("back", "1"), (None, "1")],
        [("kept", "1"), ("changed", "2"), ("changed", "2"), ("new", "1")],
        [("kept", "1"), ("changed", "2"), ("new", "1"), ("back", "1")],
        [],
    ]
    try:
        for day, snapshot in enumerate(days):
            data = [(p, h, 86400 * (100 + day)) for p, h in snapshot] + [("always", "1", 86400 * (100 + day))]
            spark.createDataFrame(data, "path string, hash string, s long").select("path", "hash", F.timestamp_seconds("s").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("path string, hash string, ts timestamp").parquet(str(tmp_path / "in"))
            run = streams.file_snapshots(stream, "30 hours").writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
            run.foreachBatch(lambda df, _: got.extend((r.path, r.event, r.hash, round(r.ts.timestamp() / 3600) - 2400) for r in df.collect())).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(got) == sorted(
        [(p, "added", "1", 0) for p in ("always", "kept", "changed", "gone", "back")]
        + [("changed", "changed", "2", 24), ("new", "added", "1", 24), ("gone", "removed", "1", 30), ("back", "removed", "1", 30), ("back", "added", "1", 48)]
    )


def test_pieces_go_in_batches_and_files_in_one_row(spark):
    files = spark.createDataFrame([(f"f{i}.php", bytearray((f"a {i}\n/* b\n" * 300).encode())) for i in range(40)], "path string, content binary").coalesce(1)
    pieces = chunks.chunked(files, 20)
    sizes = pieces.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    assert sizes.count() < 50 < 2_000 < pieces.count()
    assert rows(chunks.text_metrics(pieces)) == rows(manifest.text_metrics(files)) == rows(chunks.text_metrics(pieces.repartition(7)))
