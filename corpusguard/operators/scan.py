"""Pattern scans of file contents: rules, sensitive data, indicators by path."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Collection, Iterator
from itertools import accumulate
from re import _parser

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from corpusguard.catalogs import files as catalog
from corpusguard.catalogs import rules as rule_catalog
from corpusguard.functions import columns as C
from corpusguard.functions.matching import glob_matcher

#: Rules as ``(id, severity, category, pattern, weakness)``.
RULES = [*rule_catalog.SECURITY_RULES, *((i, s, "webshell", p, "CWE-94") for i, s, _, p in rule_catalog.WEBSHELLS)]


def text_of(content: Column) -> Column:
    """UTF-8 with replacement characters for what is not."""
    return F.make_valid_utf8(content.cast("string"))


def scannable(path: Column, size: Column, limit: int = catalog.SCAN_LIMIT) -> Column:
    """Files that content scans read."""
    return (C.extension(path).isin(catalog.SCANNABLE) | C.filename(path).isin(catalog.SCANNABLE)) & (size <= limit) & ~C.in_dirs(path, catalog.SKIP_DIRS)


def rule_table(spark, rules=RULES) -> DataFrame:
    """The rules as a table: ``rule_id, severity, category, pattern, cwe_id``."""
    return spark.createDataFrame([(i, s, c, p, w) for i, s, c, p, w in rules], "rule_id string, severity string, category string, pattern string, cwe_id string")


def rule_hits(files: DataFrame, rules=RULES, also: Column | None = None) -> DataFrame:
    """``path, rule_id, severity, category``: which rules a file meets, comments included; ``also`` tells one more of a file, of no severity."""
    return _scanned(files, rules, whole=False, also=also).select("path", "rule_id", "severity", "category")


def rule_scan(files: DataFrame, rules=RULES, snippet: int = 120, comments: bool = False) -> DataFrame:
    """Every match of every rule, outside ``comments`` or anywhere: ``path, rule_id, severity, category, line, snippet, cwe_id``."""
    return _scanned(files, rules, whole=True, snippet=snippet, comments=comments)


def _scanned(files: DataFrame, rules, whole: bool, snippet: int = 120, comments: bool = False, names: dict[str, list[str]] | None = None, marks: str = "//", also: Column | None = None) -> DataFrame:
    """One pass over the contents in Arrow batches where they are; nothing is shuffled.

    A pattern is searched only in files that hold the literals which each of its
    matches must hold; finding these costs a fraction of a regular expression, and is done
    for a batch at once. Native
    expressions would evaluate each pattern and rebuild the text twice, once to filter.
    With ``names``, a rule is for files of its names alone, in any case; ``marks`` begin the comments of a line.
    """
    named = {i: (s, c, w) for i, s, c, _, w in rules}
    patterns = [(i, p) for i, _, _, p, _ in rules]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = RuleMatcher(patterns, marks)
        only = {}
        for rule, listed in (names or {}).items():
            for name in listed:
                only.setdefault(name.lower(), set()).add(rule)
        for batch in batches:
            likely = matcher.likely(batch.column(1))
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for path, text, more, among in zip(*(part.column(i).to_pylist() for i in range(3)), likely[at : at + 256]):
                    if whole:
                        rows += [(path, rule, *named[rule][:2], line, shown[:snippet], named[rule][2]) for rule, line, shown in matcher.matches(text, comments, only.get(path.rsplit("/", 1)[-1].lower(), ()) if names else None, among)]
                    else:
                        rows += [(path, rule, *named[rule][:2], 0, "", named[rule][2]) for rule in matcher.rules_met(text, among)]
                    if more is not None:
                        rows.append((path, more, None, None, 0, "", None))
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], schema=kinds)

    kinds = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in ("path", "rule_id", "severity", "category", "line", "snippet", "cwe_id")])
    schema = "path string, rule_id string, severity string, category string, line int, snippet string, cwe_id string"
    more = F.lit(None) if also is None else also
    return files.select("path", F.coalesce(text_of(F.col("content")), F.lit("")).alias("text"), more.cast("string").alias("also")).mapInArrow(find, schema)


def rarity(literals: frozenset[str]) -> int:
    """The letters of the shortest literal; one of more than a character that holds a sign counts for three more."""
    return min(len(x) + 3 * (len(x) > 1 and not x.isalnum()) for x in literals)


def required_literals(pattern: str) -> list[frozenset[str]]:
    """Sets of literals in lower case, the rarest first, of each of which any match of a pattern (without regard to case) holds one."""

    def of(tokens) -> list[frozenset[str]]:
        found, run = [], ""
        for kind, value in [*tokens, (None, None)]:
            if kind is _parser.LITERAL and value < 128:
                run += chr(value).lower()
                continue
            if run:
                found.append(frozenset([run]))
                run = ""
            if kind is _parser.SUBPATTERN:
                found += of(value[3])
            elif kind is _parser.BRANCH:
                branches = [of(b) for b in value[1]]
                found += [frozenset().union(*(b[0] for b in branches))] if all(branches) else []
            elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] > 0:
                found += of(value[2])
        return sorted(dict.fromkeys(found), key=lambda x: (-rarity(x), len(x)))

    return of(_parser.parse(pattern))


#: What, in the 200 characters from a match on or in its line, takes the match back.
EXCEPTIONS = {"SEC012": ("ahead", r"allowed_classes\W+\s*(?:=>)?\s*false"), "SEC070": ("ahead", r"allowed_classes\W+\s*(?:=>)?\s*false"), "SEC004": ("line", r"\bconst\b")}


class RuleMatcher:
    """Rules compiled with the literals that they need."""

    #: Rules whose literals are sought at once, and how rare these are at least.
    GROUP, RARE = 8, 4

    def __init__(self, patterns: list[tuple[str, str]], marks: str = "//"):
        self.marks = marks
        self.rules = [(i, re.compile(p, re.I), required_literals(p)) for i, p in patterns]
        self.exceptions = {i: (scope, re.compile(p, re.I)) for i, (scope, p) in EXCEPTIONS.items()}
        rare = [n for n, (_, _, needed) in enumerate(self.rules) if needed and rarity(needed[0]) >= self.RARE]
        self.common = [n for n in range(len(self.rules)) if n not in set(rare)]
        self.groups = [(rare[at : at + self.GROUP], self._any_of(rare[at : at + self.GROUP])) for at in range(0, len(rare), self.GROUP)]
        self.rare = self._any_of(rare)

    def _any_of(self, rules: list[int]) -> str:
        """An expression for Arrow that any text meets in which one of the rules matches."""
        letter = {"i": "[iı\u0130]"}  # the others' forms in another case are known to it
        return "|".join(sorted({"".join(letter.get(c) or re.escape(c) for c in x) for n in rules for x in self.rules[n][2][0]}))

    def likely(self, texts: pa.Array) -> list[list[int]]:
        """For each text the numbers of the rules that can match, told by their rarest literals; most texts hold none of them all."""
        found = [self.common] * len(texts)
        held = pc.indices_nonzero(pc.match_substring_regex(texts, self.rare, ignore_case=True)) if self.groups else pa.array([], pa.uint64())
        some = texts.take(held)
        masks = [pc.match_substring_regex(some, literals, ignore_case=True).to_pylist() for _, literals in self.groups] if len(some) else []
        for at, met in zip(held.to_pylist(), zip(*masks)):
            found[at] = sorted(sum((rules for (rules, _), there in zip(self.groups, met) if there), self.common))
        return found

    def candidates(self, text: str, only: Collection[str] | None = None, among: list[int] | None = None) -> Iterator[tuple[str, re.Pattern]]:
        folded = text.casefold().replace("ı", "i")
        held = {}
        for rule, pattern, needed in self.rules if among is None else [self.rules[n] for n in among]:
            if (only is None or rule in only) and all(any(held[x] if x in held else held.setdefault(x, x in folded) for x in literals) for literals in needed):
                yield rule, pattern

    def rules_met(self, text: str, among: list[int] | None = None) -> list[str]:
        return [rule for rule, pattern in self.candidates(text, among=among) if pattern.search(text)]

    def matches(self, text: str, comments: bool = False, only: Collection[str] | None = None, among: list[int] | None = None) -> list[tuple[str, int, str]]:
        """Rule (of ``only`` these), line from 1 and the line's text of every match that is neither in a comment (unless these count) nor excepted."""
        found, places = [], None
        for rule, pattern in self.candidates(text, only, among):
            for m in pattern.finditer(text):
                places = places or Places(text, self.marks)
                line = places.line(m.start())
                if not comments and places.commented(m.start()) or self._excepted(rule, text, m.start(), places.text_of(line)):
                    continue
                found.append((rule, line + 1, places.text_of(line).strip()))
        return found

    def _excepted(self, rule: str, text: str, at: int, line: str) -> bool:
        scope, pattern = self.exceptions.get(rule, (None, None))
        return pattern is not None and pattern.search(text[at : at + 200] if scope == "ahead" else line) is not None


class Places:
    """Lines and comments of a text, found once; places are then told by bisection."""

    def __init__(self, text: str, marks: str = "//"):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        spans = [(m.end(1), m.end()) for m in re.finditer(rf"({marks})[^\n]*", text)]
        for m in re.finditer(r"/\*", text):
            close = text.find("*/", m.start())
            spans.append((m.end(), close + 1 if close >= 0 else len(text)))
        spans.sort()
        self.opened, self.closed = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def text_of(self, line: int) -> str:
        end = self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[line] : end]

    def commented(self, at: int) -> bool:
        """Whether a place is inside a block comment or after a comment's mark on its line."""
        before = bisect_right(self.opened, at)
        return before > 0 and self.closed[before - 1] >= at


def scan_rollup(findings: DataFrame) -> DataFrame:
    """One row: findings, files, and findings by severity."""
    per = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in catalog.SEVERITIES]
    return findings.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("path").alias("files"), *per)


def sensitive_matches(lines: DataFrame, data_type: str, gate: bool = False) -> DataFrame:
    """``path, line, value`` of one type of sensitive data, in native expressions, over ``lines(path, line, text)``."""
    rows = lines.where(F.col("text").rlike(rule_catalog.QUICK_GATE)) if gate else lines
    patterns = [p for t, _, _, _, p in rule_catalog.SENSITIVE if t == data_type]
    found = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)) for p in patterns]))
    return rows.select("path", "line", F.explode(found).alias("value"))


def gated(lines: DataFrame) -> DataFrame:
    """The lines that the quick gate lets pass to the scan for sensitive data."""
    return lines.where(F.col("text").rlike(rule_catalog.QUICK_GATE))


#: A line without any of these holds no sensitive data: each pattern needs one of them.
SENSITIVE_SIGNS = r"""[0-9@=:'"]|[A-Fa-f]{32}|(?i:akia|eyj|begin\s)"""


def sensitive_scan(lines: DataFrame, gate: bool = False) -> DataFrame:
    """All sensitive data in pattern order: an earlier match keeps a later one from starting or ending inside it.

    Card numbers must pass the check digit; ``column`` counts from 0. The snippet shows
    the line with the match replaced. Lines with none of the signs that each pattern
    needs stay in native code; the others are scanned in Arrow batches where they are, and
    nothing is shuffled.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = SensitiveScanner()
        for batch in batches:
            rows = [(path, line, *hit) for path, line, text in zip(batch["path"], batch["line"], batch["text"]) for hit in scanner.scan(text)]
            yield pd.DataFrame(rows, columns=["path", "line", "column", "data_type", "category", "severity", "hipaa", "length", "snippet"])

    rows = (gated(lines) if gate else lines).where(F.col("text").rlike(SENSITIVE_SIGNS))
    schema = "path string, line int, column int, data_type string, category string, severity string, hipaa boolean, length int, snippet string"
    return rows.select("path", "line", "text").mapInPandas(find, schema)


#: The columns of a match of sensitive data.
SENSITIVE_COLUMNS = {
    "column": T.IntegerType(), "data_type": T.StringType(), "category": T.StringType(), "severity": T.StringType(), "hipaa": T.BooleanType(), "length": T.IntegerType(), "snippet": T.StringType()
}


def register_sensitive(spark: SparkSession, name: str = "sensitive_data") -> None:
    """Makes the scan a table function of SQL: ``SELECT ... FROM lines, LATERAL sensitive_data(text)``.

    Its columns are those of :func:`sensitive_scan` after path and line. An optional second
    argument, a constant, names one data type; matches of others still claim their text.
    """

    class SensitiveData:
        @staticmethod
        def analyze(text: AnalyzeArgument, only: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(text.dataType, T.StringType):
                raise ValueError("the text must be a string")
            if only is not None and (not only.isConstantExpression or only.value not in {kind for kind, *_ in rule_catalog.SENSITIVE}):
                raise ValueError("the data type must be a constant that the catalog has")
            return AnalyzeResult(T.StructType([T.StructField(n, kind) for n, kind in SENSITIVE_COLUMNS.items()]))

        def __init__(self):
            self.scanner, self.signs = SensitiveScanner(), re.compile(SENSITIVE_SIGNS)

        def eval(self, text: str | None, only: str | None = None) -> Iterator[tuple]:
            if text is not None and self.signs.search(text):
                yield from (hit for hit in self.scanner.scan(text) if only in (None, hit[1]))

    spark.udtf.register(name, F.udtf(SensitiveData))


class SensitiveScanner:
    """The patterns of sensitive data, compiled, and the order in which they claim text."""

    def __init__(self):
        self.kinds = [(row[:4], re.compile(row[4], re.I), row[0].startswith("credit_card")) for row in rule_catalog.SENSITIVE]

    def scan(self, text: str) -> list[tuple]:
        """Column, type, category, severity, health privacy, length and redacted line of each match, in pattern order.

        Every match claims its characters; one whose first or last character is claimed
        already gives way.
        """
        spans = [(*m.span(1), kind) for kind, pattern, card in self.kinds for m in pattern.finditer(text) if not card or _luhn(re.sub(r"\D", "", m[1]))]
        claimed, kept = bytearray(len(text)), []
        for start, end, kind in spans:
            if not (claimed[start] or claimed[end - 1]):
                claimed[start:end] = b"\1" * (end - start)
                kept.append((start, *kind, end - start, (text[:start] + rule_catalog.REDACTED + text[end:]).strip()[:200]))
        return kept


def _luhn(digits: str) -> bool:
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return len(digits) >= 12 and sum(v - 9 * (v > 9) for v in values) % 10 == 0


def lines_of(files: DataFrame) -> DataFrame:
    """``path, line, text``: the lines of text files, counted from 1."""
    numbered = F.posexplode(F.split(text_of(F.col("content")), "\n"))
    return files.select("path", numbered.alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ``**/`` any directories, ``*`` within a part, ``{a,b}`` either, ``|`` between globs."""

    def one(g: str) -> str:
        out, at = "", 0
        while at < len(g):
            if g.startswith("**/", at):
                out, at = out + "(?:.*/)?", at + 3
                continue
            c = g[at]
            if c == "{" and "}" in g[at:]:
                end = g.index("}", at)
                out, at = out + "(?:" + "|".join(map(one, g[at + 1 : end].split(","))) + ")", end + 1
                continue
            out, at = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), at + 1
        return out

    return "^(?:" + "|".join(one(g.strip()) for g in glob.split("|")) + ")$"


def path_indicators(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """``path, ioc_id``: the files that each indicator's globs name, all in one walk of a path."""
    return files.select("path", F.explode(glob_matcher(files.sparkSession, globs.items())(F.col("path"))).alias("ioc_id"))


def directory_indicators(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """``dir, ioc_id``: the directories above any file that each indicator's globs name."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = files.where(F.col("path").contains("/")).select(F.explode(above).alias("path")).distinct()
    return path_indicators(dirs, globs).withColumnRenamed("path", "dir")


def location_indicators(files: DataFrame, forbidden: dict[str, list[str]]) -> DataFrame:
    """``path, directory``: files whose extension is not allowed in the directory that begins their path, or its second part."""
    parts = F.split("path", "/")
    found = F.lit(None).cast("string")
    for directory, extensions in forbidden.items():
        here = ((F.get(parts, F.lit(0)) == directory) | (F.get(parts, F.lit(1)) == directory)) & C.extension(F.col("path")).isin(extensions)
        found = F.coalesce(found, F.when(here, directory))
    return files.select("path", found.alias("directory")).where("directory IS NOT NULL")


def unguarded_directories(files: DataFrame, guard: str = ".htaccess") -> DataFrame:
    """``dir``: directories that hold files but no guard file."""
    dirs = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), C.filename(F.col("path")).alias("name"))
    return dirs.select("dir").distinct().join(dirs.where(F.col("name") == guard).select("dir").distinct(), "dir", "left_anti")


def sensitive_scannable(path: Column) -> Column:
    """Files that scans for sensitive data read: by a name with a dot, by all suffixes together, or by the last."""
    name = F.lower(C.filename(path))
    suffixes = F.regexp_extract(name, r"^\.*[^.]+((?:\.[^.]*)*)$", 1)
    last = F.regexp_extract(suffixes, r"(\.[^.]*)$", 1)
    return name.isin(catalog.SCANNABLE_DOT_FILES) | suffixes.isin(catalog.SCANNABLE) | last.isin(catalog.SCANNABLE)


def critical_directories(files: DataFrame, policies: DataFrame, guard: str = ".htaccess") -> DataFrame:
    """``directory, type, severity, path, detail``: what breaks the policies ``(directory, forbidden array<string>, guarded boolean, must_contain string)``.

    A policy is for a directory that has files below it. Files below it whose names end in
    a forbidden suffix are critical, with their size; a directory that should be guarded and has no
    ``guard`` file is high, and one whose guard lacks ``must_contain`` is critical. Policies
    meet the directories above files by equality; contents are read of guards alone.
    """
    rules = policies.select("directory", F.coalesce("forbidden", F.array().cast("array<string>")).alias("forbidden"), F.coalesce("guarded", F.lit(False)).alias("guarded"), F.coalesce("must_contain", F.lit("")).alias("must_contain"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    text = F.when(C.filename(F.col("path")) == guard, text_of(F.col("content")))
    rows = files.where(F.col("path").contains("/")).select("path", F.length("content").cast("long").alias("size"), text.alias("guard"), F.explode(above).alias("directory")).join(rules, "directory")
    ends = F.exists("forbidden", lambda e: F.endswith(C.filename(F.col("path")), e))
    bad = rows.where(ends).select("directory", F.lit("forbidden_file").alias("type"), F.lit("CRITICAL").alias("severity"), "path", F.concat(F.lit("Size: "), F.col("size").cast("string"), F.lit(" bytes")).alias("detail"))
    own = F.col("guard").isNotNull() & (F.col("path") == F.concat("directory", F.lit("/" + guard)))
    # one guard of a directory at most; repeated rows of it count as tampered if any is
    state = rows.where("guarded").groupBy("directory", "must_contain").agg(F.count_if(own).alias("guards"), F.bool_or(own & ~F.col("guard").contains(F.col("must_contain"))).alias("altered"))
    kind = F.when(F.col("guards") == 0, "missing_htaccess").when(F.col("altered"), "htaccess_tampered")
    severity = F.when(F.col("guards") == 0, "HIGH").otherwise("CRITICAL")
    detail = F.when(F.col("guards") > 0, F.concat(F.lit("missing "), "must_contain")).otherwise("")
    found = state.select("directory", kind.alias("type"), severity.alias("severity"), F.concat("directory", F.lit("/" + guard)).alias("path"), detail.alias("detail")).where("type IS NOT NULL")
    return bad.unionByName(found)


def functions_outside(files: DataFrame, allowed: list[str]) -> DataFrame:
    """``path, name``: functions that a file defines and the allow-list does not name."""
    names = F.array_distinct(F.regexp_extract_all(text_of(F.col("content")), F.lit(r"(?i)\bfunction\s+(\w+)"), F.lit(1)))
    return files.select("path", F.explode(names).alias("name")).where(~F.col("name").isin(allowed))


def sql_strings(files: DataFrame) -> DataFrame:
    """``path, verb, snippet``: string literals of more than 10 characters that begin with an SQL verb."""
    literals = F.regexp_extract_all(text_of(F.col("content")), F.lit(r"""["']((?i:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\s[^"']{4,})["']"""), F.lit(1))
    rows = files.select("path", F.explode(literals).alias("literal")).where(F.length("literal") > 10)
    return rows.select("path", F.upper(F.substring_index(F.col("literal"), " ", 1)).alias("verb"), F.substring("literal", 1, 100).alias("snippet"))


def upgrade_hits(files: DataFrame, rules=rule_catalog.UPGRADE_RULES) -> DataFrame:
    """``path, rule_id, severity, category, line, evidence``: every match of rules that are for files of certain names.

    Names count in any case; matches in block comments and after ``//`` or ``#`` on
    their line do not. The evidence is the line, 150 characters at most.
    """
    names = {i: listed for i, _, _, listed, _ in rules}
    named = files.where(F.lower(C.filename(F.col("path"))).isin(sorted({n.lower() for listed in names.values() for n in listed})))
    found = _scanned(named, [(i, s, c, p, "") for i, s, c, _, p in rules], whole=True, snippet=150, names=names, marks="//|#")
    return found.select("path", "rule_id", "severity", "category", "line", F.col("snippet").alias("evidence"))


def upgrade_report(hits: DataFrame) -> DataFrame:
    """One row: totals and whether each kind of tampering was met."""
    kinds = ["upgrade_hijack", "file_deletion_bypass", "persistence_injection", "skip_logic"]
    return hits.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("path").alias("files"), *[F.coalesce(F.bool_or(F.col("category") == k), F.lit(False)).alias(k) for k in kinds])


def config_check(path: Column, content: Column) -> Column:
    """What is reported of a settings file, null of any other: directives in ``.htaccess`` files, and every ``.user.ini``."""
    name = C.filename(path)
    return F.when(name == ".user.ini", "user_ini").when((name == ".htaccess") & text_of(content).rlike("(?i)" + rule_catalog.HTACCESS_DIRECTIVES), "htaccess_directive")


def config_checks(files: DataFrame) -> DataFrame:
    """``path, check, severity``: directives in ``.htaccess`` files, and every ``.user.ini``."""
    name, text = C.filename(F.col("path")), text_of(F.col("content"))
    check = config_check(F.col("path"), F.col("content"))
    severity = F.when((name == ".user.ini") & ~text.rlike("(?i)" + rule_catalog.USER_INI_CRITICAL), "HIGH").otherwise("CRITICAL")
    return files.select("path", check.alias("check"), severity.alias("severity")).where("check IS NOT NULL")


def directive_lines(files: DataFrame) -> DataFrame:
    """``path, line, directive``: the lines of ``.htaccess`` files with a directive that is reported."""
    lines = lines_of(files.where(C.filename(F.col("path")) == ".htaccess"))
    return lines.where(F.col("text").rlike("(?i)" + rule_catalog.HTACCESS_DIRECTIVES)).select("path", "line", F.trim("text").alias("directive"))


def obfuscated(files: DataFrame, least: int = 100, threshold: float = 5.5) -> DataFrame:
    """``path, entropy`` of files whose code blocks (together ``least`` characters and more) have a high entropy."""
    from corpusguard.operators.manifest import byte_entropy

    blocks = F.array_join(F.regexp_extract_all(text_of(F.col("content")), F.lit(r"(?s)<\?php(.*?)(?:\?>|$)"), F.lit(1)), "")
    rows = files.select("path", blocks.alias("code")).where(F.length("code") >= least)
    return rows.select("path", byte_entropy(F.col("code").cast("binary")).alias("entropy")).where(F.col("entropy") > threshold)


def first_candidates(files: DataFrame, names: list[str]) -> DataFrame:
    """``name, path, sha256``: for each tracked name the first file by path, with its digest."""
    rows = files.select(C.filename(F.col("path")).alias("name"), "path", F.sha2("content", 256).alias("sha256")).where(F.col("name").isin(names))
    return rows.groupBy("name").agg(F.min(F.struct("path", "sha256")).alias("f")).select("name", "f.path", "f.sha256")


def credential_file_checks(files: DataFrame, names: tuple[str, ...] = ("database.php",)) -> DataFrame:
    """``path, check, severity, detail`` of credential files: code they must not hold, variables they must not set, odd connections."""
    text = F.col("_text")
    none = F.array().cast("array<string>")
    forbidden = [F.when(text.rlike("(?i)" + p), F.struct(F.lit("forbidden_pattern").alias("check"), F.lit("CRITICAL").alias("severity"), F.lit(n).alias("detail"))) for n, p in rule_catalog.CREDENTIAL_FORBIDDEN]
    heuristics = {
        ("suspicious_connection", "HIGH"): (F.regexp_count(text, F.lit("mysqli_connect")) > 1) | (F.regexp_count(text, F.lit(r"\$mysqli")) > 1),
        ("obfuscated_creds", "CRITICAL"): text.rlike("(?i)base64_decode|gzinflate|gzuncompress"),
        ("arbitrary_sql", "CRITICAL"): text.rlike(r"(?i)\$mysqli->query\s*\(\s*\$"),
    }
    odd = [F.when(c, F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.lit("").alias("detail"))) for (n, s), c in heuristics.items()]
    set_ = F.array_except(F.coalesce(F.regexp_extract_all(text, F.lit(r"(?m)^\s*\$(\w+)\s*="), F.lit(1)), none), F.array(*map(F.lit, rule_catalog.CREDENTIAL_VARIABLES)))
    variables = F.transform(set_, lambda v: F.struct(F.lit("unexpected_variable").alias("check"), F.lit("HIGH").alias("severity"), v.alias("detail")))
    rows = files.where(C.filename(F.col("path")).isin(*names)).select("path", text_of(F.col("content")).alias("_text"))
    return rows.select("path", F.inline(F.concat(F.filter(F.array(*forbidden, *odd), lambda x: x.isNotNull()), variables)))
