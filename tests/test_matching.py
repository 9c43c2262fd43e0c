"""Keywords, globs and symbols against brute force, and rows that must not be lost."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusguard.functions import matching
from corpusguard.operators import findings, investigation, keywords, scan
from corpusguard.sources import interop


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


PIECES = ["a", "b", "ab", "*", "**", "?", "/", "**/", "{a,b}", "{a/b,*}", "{,b}", ".", "|", "{", "}", " ", "(", "é"]


def test_the_trie_is_the_regular_expression():
    rng = random.Random(8)
    names = ["", "a", "b", "ab", "ba", "aab", ".a", "a.b", "é", "(", "aé"]
    paths = ["/".join(rng.choice(names) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    for _ in range(400):
        globs = [(str(i), "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 5)))) for i in range(rng.randint(1, 6))]
        trie, patterns = matching.GlobTrie(globs), [(i, re.compile(scan.glob_pattern(g))) for i, g in globs]
        for path in paths:
            assert trie.met(path) == {i for i, p in patterns if p.match(path)}, (path, globs)


def test_a_walk_does_not_try_every_glob(monkeypatch):
    trie = matching.GlobTrie([(str(i), f"src/d{i}/**/*.x{i}") for i in range(5000)] + [("all", "**/*.php"), ("odd", "src/*a*b")])
    seen = []
    step = matching.GlobTrie._step
    monkeypatch.setattr(matching.GlobTrie, "_step", staticmethod(lambda node, part: seen.append(part) or step(node, part)))
    assert trie.met("src/d77/p/q/r.x77") == {"77"} and len(seen) < 20


def test_glob_tables(spark):
    paths = spark.createDataFrame([("a/b.php",), ("a/b.php",), (None,), ("",)], "path string")
    globs = spark.createDataFrame([("1", "a/*"), ("2", "**/*.php"), ("2", "a/b.*"), ("3", None), (None, "*"), ("4", "")], "ioc_id string, glob string")
    assert rows(matching.with_globs(paths, F.col("path"), globs)) == [("", "4"), ("a/b.php", "1"), ("a/b.php", "2")]
    assert rows(matching.with_globs(paths, F.col("path"), globs.where("false"))) == []
    sized = len(scan.path_indicators(paths, {str(i): f"x{i}/*" for i in range(2000)})._jdf.queryExecution().optimizedPlan().toString())
    assert sized < 3 * len(scan.path_indicators(paths, {"1": "x/*"})._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
def test_keywords_are_substrings(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BLOCK_BYTES", limit)  # automata of one word, of a few, of all
    rng = random.Random(limit)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None]
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(12)}
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(w,) for w in [*words, *words, "", None]], "keyword string")
    want = sorted(((i, t, w) for i, t in enumerate(texts) for w in words if t and w in t), key=str)
    assert rows(matching.with_keywords(frame, F.col("text"), table)) == want
    assert rows(matching.with_keywords(frame, F.col("text"), table.where("false"))) == []


def test_vectors_by_words_and_indicators(spark):
    vectors = spark.createDataFrame(
        [("V1", ["**/Shell.php, uploads"], ["content_regex: eval"], ["I1"]), ("V2", ["abc"], None, ["I2", "I3"]), ("V3", None, None, None), ("V4", [None], ["x y z"], [])],
        "vector string, artifacts array<string>, patterns array<string>, iocs array<string>",
    )
    assert rows(keywords.vector_words(vectors)) == [("V1", "content_regex:"), ("V1", "eval"), ("V1", "shell"), ("V1", "uploads")]
    found = spark.createDataFrame(
        [("a", "a webshell", None, "x", None), ("b", None, None, None, ["I3", "I1"]), ("c", "abc", "EVALuation", "", []), ("c", "abc", "EVALuation", "", []), ("d", "php", "", "", ["I9", None])],
        "id string, title string, description string, category string, ioc_ids array<string>",
    )
    assert rows(keywords.vectors_related(found, vectors)) == [("a", "V1"), ("b", "V1"), ("b", "V2"), ("c", "V1")]


def test_components_of_vulnerabilities(spark):
    flaws = spark.createDataFrame([("f1", "CVE in (acme/widget), fixed"), ("f2", "acme/widget-extra: bad"), ("f3", None), ("f4", "plain words - /")], "id string, description string")
    assert rows(keywords.vulnerable_components(flaws)) == [("-",), ("/",), ("acme/widget",), ("acme/widget-extra",)]
    code = spark.createDataFrame(
        [("c1", "use Acme/Widget-Extra;", None, "LOW"), ("c2", None, "none here", "LOW"), ("c3", "x", "acme/widget", "CONFIRMED"), ("c4", None, None, None)], "id string, snippet string, description string, confidence string"
    )
    named, related = keywords.dependency_synergy(code, flaws.where("id <> 'f4'"))
    assert rows(named) == [("c1", "acme/widget", 2, "HIGH"), ("c3", "acme/widget", 2, "CONFIRMED")]
    assert rows(keywords.related_to(named, related)) == [("c1", "f1"), ("c1", "f2"), ("c3", "f1"), ("c3", "f2")]
    assert [rows(x) for x in keywords.dependency_synergy(code, flaws.where("false"))] == [[], []]


def told(path, line, symbols):
    """The symbol of a line by trial of all."""
    around = [s for s in symbols if s[0] == path and path is not None and s[3] <= line <= s[4]]
    inner = lambda kind: max((s for s in around if kind(s)), key=lambda s: (s[3], -s[4]), default=None)
    c, m, f = inner(lambda s: s[1] and not s[2]), inner(lambda s: s[1] and s[2]), inner(lambda s: not s[1] and s[2])
    if m and (not c or m[1] == c[1]):
        return m[1], m[2], m[5]
    if c:
        return c[1], "", 0
    return (None, f[2], f[5]) if f else (None, None, None)


def test_symbols_as_all_of_them_tried(spark):
    rng = random.Random(2)
    symbols = []
    for path in ("p", "q", None):
        ends = set()
        for i in range(60):  # nested, side by side and across each other; no two of one kind with equal bounds
            first = rng.randint(1, 300)
            last = first + rng.choice((0, 1, 5, 40, 300))
            if (first, last) not in ends:
                ends.add((first, last))
                kind = rng.randint(0, 2)
                symbols.append((path, f"C{i % 9}" if kind else None, f"f{i}" if kind < 2 else None, first, last, rng.randint(1, 9)))
    places = [(rng.choice(("p", "q", "r", None)), rng.randint(0, 320)) for _ in range(400)]
    places += places[:50] + [("p", None)]
    found = findings.with_symbols(
        spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, path string, line int"),
        spark.createDataFrame(symbols, "path string, class string, function string, line int, end_line int, complexity int"),
    )
    want = [(i, p, n, *(told(p, n, symbols) if n else (None, None, None))) for i, (p, n) in enumerate(places)]
    assert rows(found) == sorted(want, key=str)


def test_a_line_meets_the_symbols_around_it_alone(spark):
    n = 100_000
    symbols = spark.range(n).selectExpr("'hot' AS path", "CAST(NULL AS STRING) AS class", "'f' || id AS function", "CAST(id * 10 + 1 AS INT) AS line", "CAST(id * 10 + 9 AS INT) AS end_line")
    places = spark.range(2 * n).selectExpr("'hot' AS path", "CAST(id * 5 + 3 AS INT) AS line")
    found = findings.with_symbols(places, symbols)
    assert found.where("function = 'f' || CAST((line - 1) DIV 10 AS STRING)").count() == 2 * n
    found.collect()
    metrics = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in metrics and "BroadcastNestedLoopJoin BuildLeft, Cross, " not in metrics
    covered = symbols.select(F.explode(findings._covering(F.col("line").cast("long"), F.col("end_line").cast("long"))))
    assert covered.count() < 8 * n


def test_rows_of_other_tools_stay(spark):
    raw = spark.createDataFrame(
        [("CVE-1", "error", "m", None, 1, "", "high", 9.0), ("CVE-1", "error", "m", "p", None, "", None, 7.0), ("CVE-1", "error", "m", "p", None, "", None, 3.0), ("x", None, None, "p", 2, None, None, None)],
        "rule_id string, level string, message string, uri string, start_line int, cwe_id string, given_severity string, given_score double",
    )
    assert sorted(((r.path, r.score) for r in investigation.from_dependencies(raw).collect()), key=str) == [("p", 3.0), ("p", 7.0), ("p", None), (None, 9.0)]
    ok = '{"suites":[{"title":"s","specs":[{"title":"t","tests":[{"results":[{"status":"passed","duration":5}]},{"results":null}]},{"title":"u"}]},{"title":"v","specs":[]}]}'
    reports = spark.createDataFrame([("x" + ok,), ("not json",), (None,), ('{"suites":[]}',), ("{}",)], "json string")
    assert rows(interop.runtime_results(reports)) == rows(spark.createDataFrame([("s", "t", "passed", 5), *[(None, None, "parse_error", None)] * 3], "a string, b string, c string, d long"))


def test_upgrade_files(spark):
    text = "<?php\n// return\n# exit\n/* die */ unlink($a); unlink($b);\nx(); /* open\nreturn 1;\n*/ RETURN; # skip\n"
    files = spark.createDataFrame([("a/UPGRADE.php", bytearray(text.encode())), ("b/upgrade.PHP", bytearray(b"eval($sql)")), ("c/other.php", bytearray(text.encode())), (".htaccess", bytearray(b"SetHandler x\nreturn"))], "path string, content binary")
    found = [(r.path, r.rule_id, r.line, r.evidence) for r in scan.upgrade_hits(files).collect()]
    assert sorted(found) == [
        (".htaccess", "UPG020", 1, "SetHandler x"), ("a/UPGRADE.php", "UPG011", 4, "/* die */ unlink($a); unlink($b);"), ("a/UPGRADE.php", "UPG011", 4, "/* die */ unlink($a); unlink($b);"),
        ("a/UPGRADE.php", "UPG030", 7, "*/ RETURN; # skip"), ("b/upgrade.PHP", "UPG001", 1, "eval($sql)"),
    ]


@pytest.mark.parametrize("limit", [0, 9, 60, 1 << 20])
def test_many_globs_meet_by_their_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "TRIE_BYTES", limit)  # all joined, some, or one trie of all
    rng = random.Random(limit)
    part = lambda: "".join(rng.choice("ab.(é😀") for _ in range(rng.randint(0, 4)))
    paths = ["/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(150)] + ["", "a\nb/.a", "a" * 40 + ".x", "/", "d/", None]
    globs = ["/".join(rng.choice(["**", part(), part() + "*", "*" + part(), part() + "?" + part(), "{a,b}*" + part()]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    globs += ["*", "**/*", "", "a*b/.a", "a" * 40 + ".*", "a" * 39 + "?.x", "**/|d/", "a|**/b*/**/a?", "**/**/a**/b"]
    frame = spark.createDataFrame([(i % 3, p) for i, p in enumerate(paths)], "n int, path string")
    table = spark.createDataFrame([(f"G{i % 50}", g) for i, g in enumerate(globs)], "ioc_id string, glob string")
    trie = matching.GlobTrie([(f"G{i % 50}", g) for i, g in enumerate(globs)])
    want = sorted({(i % 3, p, ioc) for i, p in enumerate(paths) if p is not None for ioc in trie.met(p)}, key=str)
    assert len(want) > 300 and rows(matching.with_globs(frame, F.col("path"), table)) == want


def test_a_step_does_not_read_every_key():
    trie = matching.GlobTrie([(str(i), f"**/f{i}.*|**/*.x{i}") for i in range(3000)])
    node = trie.root.deep
    assert node.heads == {3, 4, 5, 6} and node.tails == {3, 4, 5, 6} and trie.met("a/f77.x5") == {"77", "5"}


@pytest.mark.parametrize("limit", [4, 1 << 20])
def test_pairs_of_vectors_are_not_shuffled(spark, monkeypatch, limit):
    monkeypatch.setattr(matching, "BLOCK_BYTES", limit)  # several tables of words and indicators, or one
    vectors = spark.createDataFrame([(f"V{i}", [f"word{i % 4} other"], None, [f"I{i % 3}", None]) for i in range(8)], "vector string, artifacts array<string>, patterns array<string>, iocs array<string>")
    found = spark.createDataFrame([(f"f{i}", f"a word{i % 5}", None, "x", [f"I{i % 7}", None]) for i in range(40)], "id string, title string, description string, category string, ioc_ids array<string>")
    want = {(f"f{i}", f"V{v}") for i in range(40) for v in range(8) if v % 4 == i % 5 or v % 3 == i % 7}
    related = keywords.vectors_related(found, vectors)
    assert rows(related) == sorted(want, key=str)
    assert limit == 4 or "Exchange" not in related._jdf.queryExecution().executedPlan().toString()
    twice = found.union(found.where("id < 'f2'"))
    assert rows(keywords.vectors_related(twice, vectors)) == sorted(want, key=str)
    assert rows(keywords.vectors_hit(related, vectors, each_once=True)) == rows(keywords.vectors_hit(related.union(related), vectors))
