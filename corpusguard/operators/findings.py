"""Findings in one schema: normalised, deduplicated, numbered, enriched and correlated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.catalogs import files as file_catalog
from corpusguard.catalogs import rules as catalog
from corpusguard.functions import columns as C
from corpusguard.functions.session import checkpointed

COLUMNS = ["id", "rule_id", "title", "severity", "confidence", "source", "category", "cwe_id", "path", "line", "snippet", "fingerprint"]


def unified(rows: DataFrame, source: str, confidence: str = "MEDIUM", title: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of one source in the common columns; rows need rule_id, severity, category, path, line, snippet and cwe_id.

    ``keep`` names columns of the rows that stay beside them. A row gives a finding, whatever is null in it.
    """
    line = F.col("line").cast("int")
    return rows.select(
        C.finding_id(F.lit(source), F.col("rule_id"), F.col("path"), line).alias("id"), "rule_id", (F.col("rule_id") if title is None else title).alias("title"),
        C.severity_named(F.col("severity")).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), "category",
        C.weakness_id(F.col("cwe_id")).alias("cwe_id"), "path", line.alias("line"), "snippet", C.fingerprint(F.col("rule_id"), F.col("path"), line, F.col("snippet")).alias("fingerprint"), *keep,
    )


def from_sensitive(rows: DataFrame) -> DataFrame:
    """Sensitive data as findings; the snippet is redacted already."""
    return unified(rows.select(F.col("data_type").alias("rule_id"), "severity", F.lower("category").alias("category"), "path", "line", "snippet", F.lit("CWE-312").alias("cwe_id")), "sensitive")


def from_mismatches(rows: DataFrame) -> DataFrame:
    """Content-type mismatches as findings at line 0; matching rows go."""
    severity = C.looked_up(F.col("mismatch_severity"), {"critical": "CRITICAL", "suspicious": "HIGH", "info": "LOW", "none": "INFO"}, "MEDIUM")
    bad = rows.where(~F.col("is_match"))
    return unified(bad.select(F.lit("MAGIKA").alias("rule_id"), severity.alias("severity"), F.lit("content_type").alias("category"), "path", F.lit(0).alias("line"), F.col("label").alias("snippet"), F.lit("CWE-434").alias("cwe_id")), "content_type")


def from_sarif(rows: DataFrame, source: str) -> DataFrame:
    """Flattened results of a static analyser; levels become severities, the first keyword a category."""
    severity = C.looked_up(F.col("level"), {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}, "MEDIUM")
    return unified(rows.select("rule_id", severity.alias("severity"), keyword_category(F.col("rule_id")).alias("category"), F.col("uri").alias("path"), F.col("start_line").alias("line"), F.col("message").alias("snippet"), "cwe_id"), source)


def keyword_category(text: Column) -> Column:
    """The category of the first keyword that the text holds."""
    # Keywords in order, with their categories.
    ordered = [
        ("sql", "injection"), ("inject", "injection"), ("xss", "xss"), ("command", "rce"), ("exec", "rce"), ("eval", "rce"), ("deserial", "deserialization"),
        ("path", "path_traversal"), ("traversal", "path_traversal"), ("ssrf", "ssrf"), ("xxe", "xxe"), ("crypto", "crypto"), ("hash", "crypto"),
        ("secret", "credentials"), ("password", "credentials"), ("token", "credentials"), ("auth", "authorization"), ("upload", "upload"), ("redirect", "redirect"),
        ("cookie", "session"), ("session", "session"), ("config", "config"),
    ]
    lower, found = F.lower(text), F
    for word, name in ordered:
        found = found.when(lower.contains(word), name)
    return found.otherwise("other")


def deduplicated(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """The first finding of each fingerprint in the order of ``seq``: a map-side combined minimum, no window over a hot key."""
    others = [c for c in findings.columns if c not in ("fingerprint", seq)]
    first = findings.groupBy("fingerprint").agg(F.min_by(F.struct(*others), F.struct(seq, *[c for c in ("id", "path", "line") if c in others])).alias("f"), F.min(seq).alias(seq))
    return first.select("fingerprint", seq, "f.*")


def numbered(findings: DataFrame, *order: str, prefix: str = "INV-") -> DataFrame:
    """Findings with sequential ids in the given order, without a one-partition sort.

    A range partitioning orders them; numbers inside a range are a window over the
    range, and the offsets are the counts of the ranges before. There are as many ranges
    as the session has shuffle partitions, or fewer where they are small. The placement
    is checkpointed, so that a lost executor cannot change it.
    """
    placed = checkpointed(findings.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    number = F.col("_base") + F.col("_inside")
    rows = placed.withColumn("_inside", inside).join(F.broadcast(base), "_range")
    shown = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return rows.withColumn("seq_id", F.concat(F.lit(prefix), shown)).drop("_range", "_base", "_inside")


def enriched(findings: DataFrame) -> DataFrame:
    """Technique, score and weakness by rule id with prefix fallback; the weakness name where the id is known."""
    rule = F.col("rule_id")
    cwe = F.coalesce(F.nullif(F.col("cwe_id"), F.lit("")), C.prefix_lookup(rule, catalog.WEAKNESSES), F.lit(""))
    rows = findings.withColumn("technique", C.prefix_lookup(rule, catalog.TECHNIQUES)).withColumn("score", C.prefix_lookup(rule, catalog.SCORES)).withColumn("cwe_id", cwe)
    return rows.withColumn("cwe_name", C.looked_up(F.col("cwe_id"), catalog.WEAKNESS_NAMES, ""))


def corroborated(findings: DataFrame) -> DataFrame:
    """``corroborated_by`` (the other sources at a path and line) and confidence CONFIRMED where there are any.

    Sources of a place are few, so the set is small however many findings the place has;
    it is aggregated map-side and joined back. The findings are checkpointed first, for
    what makes them (a scan of contents) must not run twice.
    """
    findings = checkpointed(findings)
    places = findings.where("line > 0").groupBy("path", "line").agg(F.sort_array(F.collect_set("source")).alias("_sources")).where(F.size("_sources") > 1)
    rows = findings.join(places, ["path", "line"], "left")
    others = F.coalesce(F.array_except("_sources", F.array("source")), F.array().cast("array<string>"))
    rows = rows.withColumn("corroborated_by", others)
    return rows.withColumn("confidence", F.when(F.size("corroborated_by") > 0, "CONFIRMED").otherwise(F.col("confidence"))).drop("_sources")


#: Levels of the dyadic ranges of lines: a file has fewer than 2 to this power of lines.
LINE_LEVELS = 31


def _covering(first: Column, last: Column) -> Column:
    """The fewest dyadic ranges ``(level, node)`` that together are the lines from ``first`` to ``last``: two of a level at most."""

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(first / size).cast("long"), F.floor((last + 1) / size).cast("long")  # the whole nodes of the level, high excluded
        left, right = F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1)
        return F.transform(F.array_compact(F.array_distinct(F.array(left, right))), lambda node: F.struct(level.alias("level"), node.alias("node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LINE_LEVELS - 1)), of_level))


def with_symbols(findings: DataFrame, symbols: DataFrame) -> DataFrame:
    """Findings with ``class`` and ``function`` around their line, and the function's ``complexity`` where the symbols tell it.

    ``symbols(path, class, function, line, end_line[, complexity])`` has classes (no function), methods
    (both) and functions (no class). The innermost class of a line is told, and its innermost method
    around the line; in a class outside its methods the function is empty; outside classes the
    innermost function is told. Of symbols that begin on one line the shorter is inside.

    An interval join of any nesting and skew: the lines of a symbol are a few dyadic ranges, a line lies in one
    range of each level that occurs, and these meet by equality. So a line meets the symbols
    around it and no others, however many its file has, and a file with very many findings is many keys.
    Lines are looked up once however many findings they have, and all findings stay: those
    without a line or a symbol have nulls, and so have those with a null path.
    """
    findings = checkpointed(findings)
    complexity = F.col("complexity") if "complexity" in symbols.columns else F.lit(None).cast("int")
    spans = symbols.where("line <= end_line").select("path", "class", "function", complexity.alias("complexity"), F.col("line").cast("long").alias("first"), F.col("end_line").cast("long").alias("last"))
    spans = checkpointed(spans.select("*", F.inline(_covering(F.col("first"), F.col("last")))))
    levels = F.broadcast(spans.select("level").distinct())  # 31 rows at most
    places = findings.where("line > 0").select("path", F.col("line").cast("long").alias("line")).distinct()
    met = places.join(levels).withColumn("node", F.call_function("shiftright", F.col("line"), F.col("level"))).join(spans, ["path", "level", "node"])
    inside = F.struct("first", -F.col("last"), "class", "function")
    is_class, is_function = F.col("class").isNotNull(), F.col("function").isNotNull()
    told = F.struct("class", "function", "complexity")
    best = met.groupBy("path", "line").agg(
        F.max_by("class", F.when(is_class & ~is_function, inside)).alias("c"), F.max_by(told, F.when(is_class & is_function, inside)).alias("m"), F.max_by(told, F.when(~is_class & is_function, inside)).alias("f")
    )
    of_class = F.col("m.class").isNotNull() & (F.col("c").isNull() | (F.col("m.class") == F.col("c")))
    holder = F.when(of_class, F.col("m.class")).otherwise(F.col("c"))
    shown = F.when(of_class, F.col("m.function")).when(F.col("c").isNotNull(), F.lit("")).otherwise(F.col("f.function"))
    measured = F.when(of_class, F.col("m.complexity")).when(F.col("c").isNotNull(), F.lit(0)).otherwise(F.col("f.complexity"))
    best = best.select("path", "line", holder.alias("class"), shown.alias("function"), measured.alias("complexity"))
    return findings.join(best, ["path", "line"], "left").select(*findings.columns, "class", "function", "complexity")


def linked_by_rule(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """``id, rule_id, n_related``: findings of either kind whose rule the other kind has too, with the number of their partners.

    All partners of a finding are those of its rule, so the rule stands for them: their
    product is never built. :func:`related_ids` gives them for chosen findings.
    """
    sides = [df.select("id", "rule_id", F.lit(side).alias("side")) for side, df in enumerate((static, runtime))]
    both = checkpointed(sides[0].union(sides[1]))  # narrow; the scans that they come from run once
    counts = both.groupBy("rule_id").agg(*[F.countDistinct(F.when(F.col("side") == s, F.col("id"))).alias(f"n{s}") for s in (0, 1)])
    partners = F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
    return both.join(counts.where("n0 > 0 AND n1 > 0"), "rule_id").select("id", "rule_id", partners.alias("n_related"))


def related_ids(chosen: DataFrame, others: DataFrame) -> DataFrame:
    """``id, related_id``: a row for each finding of the other kind with the rule of a chosen one."""
    return chosen.select("id", "rule_id").join(others.select(F.col("id").alias("related_id"), "rule_id"), "rule_id").select("id", "related_id")


def content_types(files: DataFrame, expected: dict[str, list[str]] = file_catalog.EXPECTED_LABELS) -> DataFrame:
    """``path, label, ext_label, is_match, mismatch_severity``: a label by content against what the extension expects.

    Magic numbers are leading bytes; marks of scripts and pages count anywhere. Plain
    text matches an extension that expects a kind of text without a mark of its own.
    """
    head = F.upper(F.hex(F.substring("content", 1, 270)))
    text = F.decode("content", "ISO-8859-1")
    label = F
    for digits, skipped, name in file_catalog.MAGIC_LABELS:
        label = label.when(F.substring(head, 2 * skipped + 1, len(digits)) == digits, name)
    label = label.when(text.rlike(r"<\?php|<\?="), "php").when(text.rlike(r"(?i)<!doctype html|<html"), "html").when(F.length("content") == 0, "empty").otherwise("txt")
    ext = C.extension(F.col("path"))
    labels = F.split(C.literal_map({k: ",".join(v) for k, v in expected.items()})[ext], ",")
    plain = (label == "txt") & F.arrays_overlap(labels, F.array(*map(F.lit, file_catalog.PLAIN_LABELS)))
    rows = files.select("path", label.alias("label"), F.substring(ext, 2, 20).alias("ext_label"), (labels.isNull() | F.array_contains(labels, label) | plain).alias("is_match"))
    severity = F.when(F.col("is_match"), "none").when((F.col("label") == "php") & (F.col("ext_label") != "php"), "critical").when(F.col("label").isin("zip", "html"), "suspicious").otherwise("info")
    return rows.withColumn("mismatch_severity", severity)


def with_standards(findings: DataFrame) -> DataFrame:
    """``technique``, ``technique_name`` and ``score`` by the exact rule id; null where the rule has none."""
    rule = F.col("rule_id")
    rows = findings.withColumns({"technique": C.literal_map(catalog.TECHNIQUES)[rule], "score": C.literal_map(catalog.SCORES)[rule]})
    return rows.withColumn("technique_name", C.literal_map(catalog.TECHNIQUE_NAMES)[F.col("technique")])


def with_weaknesses(findings: DataFrame, weaknesses: DataFrame) -> DataFrame:
    """Findings with ``cwe_name``, and ``recommendation`` filled from ``weaknesses(cwe_id, name, mitigation)`` where it is empty.

    A finding without a known weakness keeps what it has; all findings stay. Of rows with one id the first name and mitigation by order count.
    """
    known = weaknesses.groupBy(C.weakness_id(F.col("cwe_id")).alias("_cwe")).agg(F.min("name").alias("_name"), F.min("mitigation").alias("_mitigation")).where("_cwe <> ''")
    rows = findings.join(known, C.weakness_id(F.col("cwe_id")) == F.col("_cwe"), "left")
    given = F.nullif(F.col("recommendation"), F.lit("")) if "recommendation" in findings.columns else F.lit(None).cast("string")
    return rows.withColumns({"cwe_name": F.coalesce("_name", F.lit("")), "recommendation": F.coalesce(given, F.col("_mitigation"), F.lit(""))}).drop("_cwe", "_name", "_mitigation")


def _first_held(text: Column, ordered: list[tuple[list[str], str]], default: str | None) -> Column:
    """The value of the first entry of which the text holds any word."""
    found = F
    for words, value in ordered:
        found = found.when(reduce(lambda a, w: a | text.contains(w), words, F.lit(False)), value)
    return found.otherwise(default)


def from_static_sarif(rows: DataFrame, source: str) -> DataFrame:
    """Flattened results of a static analyser as findings of high confidence with score, technique and category.

    The level gives the severity and that the score, none for information. The technique is that of the
    rule's kind, else of the first words that rule and message hold; the category goes by words alone.
    """
    severity = C.looked_up(F.col("level"), {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}, "MEDIUM")
    text = F.lower(F.concat_ws(" ", "rule_id", "message"))
    category = _first_held(text, [([word], name) for word, name in catalog.STATIC_CATEGORIES], "security")
    technique = F.coalesce(C.literal_map(catalog.STATIC_RULE_TECHNIQUES)[F.col("rule_id")], _first_held(text, catalog.STATIC_TECHNIQUES, None))
    score = F.nullif(C.literal_map({k: float(v) for k, v in file_catalog.SEVERITY_SCORES.items()})[severity], F.lit(0.0))
    shaped = rows.select(
        "rule_id", severity.alias("severity"), category.alias("category"), F.col("uri").alias("path"), F.col("start_line").alias("line"), F.col("message").alias("snippet"), "cwe_id",
        technique.alias("technique"), C.literal_map(catalog.TECHNIQUE_NAMES)[technique].alias("technique_name"), score.alias("score"),
    )
    return unified(shaped, source, confidence="HIGH", title=F.concat(F.lit("[Static] "), F.substring("snippet", 1, 120)), keep=("technique", "technique_name", "score"))


def vectors_met(findings: DataFrame, vectors: dict[str, list[str]]) -> DataFrame:
    """``fingerprint, vectors``: the attack vectors that a finding's words name; few vectors, so each is a literal test."""
    text = F.lower(F.concat_ws(" ", "title", "rule_id", "category", "snippet"))
    met = []
    for name, words in vectors.items():
        test = F.lit(False)
        for w in words:
            test = test | text.contains(w)
        met.append(F.when(test, name))
    found = F.filter(F.array(*met), lambda x: x.isNotNull())
    return findings.select("fingerprint", found.alias("vectors")).where(F.size("vectors") > 0).distinct()


def from_runtime(tests: DataFrame) -> DataFrame:
    """Failed runtime tests as findings: the rule of the first keyword of the suite that the name holds, or a default."""
    lower = F.lower("test")
    rule, cwe, category = F, F, F
    for suite, word, rule_id, weakness, name in catalog.RUNTIME_RULES:
        met = (F.col("suite") == suite) & lower.contains(word.lower())
        rule, cwe, category = rule.when(met, rule_id), cwe.when(met, weakness), category.when(met, name)
    rows = tests.where("status = 'failed'").select(
        rule.otherwise("RUNTIME").alias("rule_id"), F.lit("HIGH").alias("severity"), category.otherwise("runtime").alias("category"),
        F.concat_ws("/", "suite", "test").alias("path"), F.lit(0).alias("line"), F.col("test").alias("snippet"), cwe.otherwise("").alias("cwe_id"),
    )
    return unified(rows, "runtime", confidence="HIGH")


def escalated(findings: DataFrame, mismatches: DataFrame) -> DataFrame:
    """Signature findings on files with a content-type mismatch become critical and confirmed."""
    bad = mismatches.where(~F.col("is_match")).select(F.col("path").alias("_bad")).distinct()
    met = F.col("_bad").isNotNull()
    rows = findings.join(bad, F.col("path") == F.col("_bad"), "left")
    return rows.withColumn("severity", F.when(met, "CRITICAL").otherwise(F.col("severity"))).withColumn("confidence", F.when(met, "CONFIRMED").otherwise(F.col("confidence"))).drop("_bad")


def dependency_links(descriptions: DataFrame, code: DataFrame) -> DataFrame:
    """``token, files``: package-like tokens (with ``/`` or ``-``) of descriptions that code files name, by an equi-join of tokens."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9/_@.-]+"), lambda t: t.rlike("[/-]") & (F.length(t) > 3)))
    wanted = descriptions.select(F.explode(split("text")).alias("token")).distinct()
    found = code.select("path", F.explode(split("text")).alias("token"))
    return found.join(wanted, "token").groupBy("token").agg(F.countDistinct("path").alias("files"))
