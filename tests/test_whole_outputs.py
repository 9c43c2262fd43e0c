"""Whole outputs of scans and manifests on the small tables, against plain Python."""

import hashlib
import math
import re
from collections import Counter

import pytest

from corpusguard.catalogs import files as file_catalog
from corpusguard.catalogs import rules as catalog
from corpusguard.operators import scan
from corpusguard.plans import catalogue
from corpusguard.plans.registry import files, planted

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.path: bytes(r.content).decode("utf-8", "replace") for r in planted(spark, SF).collect()}


def commented(text, at):
    """By looking back from the place: an open block comment, or a mark on the line."""
    opened = text.rfind("/*", 0, at)
    closed = text.find("*/", opened) if opened >= 0 else 0
    return opened >= 0 and (closed < 0 or closed >= at) or "//" in text[text.rfind("\n", 0, at) + 1 : at]


def excepted(rule, text, at, line):
    if rule in ("SEC012", "SEC070"):
        return re.search(r"allowed_classes\W+\s*(?:=>)?\s*false", text[at : at + 200], re.I)
    return rule == "SEC004" and re.search(r"\bconst\b", line, re.I)


def test_rule_scan(spark, texts):
    want = []
    for path, text in texts.items():
        for rule, severity, category, pattern, weakness in scan.RULES:
            for m in re.finditer(pattern, text, re.I):
                number = text.count("\n", 0, m.start())
                line = text.split("\n")[number]
                if not commented(text, m.start()) and not excepted(rule, text, m.start(), line):
                    want.append((path, rule, severity, category, number + 1, line.strip()[:120], weakness))
    found = [tuple(r) for r in catalogue.QUERIES["rule_scan"](spark, SF).select("path", "rule_id", "severity", "category", "line", "snippet", "cwe_id").collect()]
    assert sorted(found) == sorted(want) and len({r[1] for r in want}) > 8


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return len(digits) >= 12 and total % 10 == 0


def test_sensitive_scan(spark):
    want = []
    for r in files(spark, SF).collect():
        for number, line in enumerate(bytes(r.content).decode("utf-8", "replace").split("\n"), 1):
            taken = set()
            for kind, category, severity, hipaa, pattern in catalog.SENSITIVE:
                for m in re.finditer(pattern, line, re.I):
                    a, b = m.span(1)
                    if kind.startswith("credit_card") and not luhn(re.sub(r"\D", "", m[1])) or {a, b - 1} & taken:
                        continue
                    taken |= set(range(a, b))
                    want.append((r.path, number, a, kind, category, severity, hipaa, b - a, (line[:a] + "***REDACTED***" + line[b:]).strip()[:200]))
    for name in ("pii_scan", "pii_udtf"):
        found = [tuple(r) for r in catalogue.QUERIES[name](spark, SF).select("path", "line", "column", "data_type", "category", "severity", "hipaa", "length", "snippet").collect()]
        assert sorted(found) == sorted(want) and len(want) > 5


def test_hash_algorithms(spark):
    rows = {r.path: r.asDict() for r in catalogue.QUERIES["hash_algorithms"](spark, SF).collect()}
    for r in files(spark, SF).collect():
        got = rows.pop(r.path)
        for name, value in got.items():
            if name in hashlib.algorithms_available and value is not None:
                assert value == hashlib.new(name, bytes(r.content)).hexdigest(), name
        assert sum(name in hashlib.algorithms_available for name in got) >= 5
    assert not rows


def test_manifest(spark):
    rows = {r.path: r for r in catalogue.QUERIES["manifest_full"](spark, SF).collect()}
    for r in files(spark, SF).collect():
        got, content = rows.pop(r.path), bytes(r.content)
        counts = Counter(content)
        entropy = -sum(n / len(content) * math.log2(n / len(content)) for n in counts.values()) if len(content) >= 50 else 0.0
        ext = "." + r.path.rsplit(".", 1)[1]
        assert (got.filename, got.extension, got.size_bytes) == (r.path.rsplit("/", 1)[1], ext, len(content))
        assert (got.sha256, got.sha512) == (hashlib.sha256(content).hexdigest(), hashlib.sha512(content).hexdigest())
        assert abs(got.entropy - round(entropy, 4)) < 1.1e-4 and got.is_binary == (b"\0" in content[:8192])
        assert got.mime_type == file_catalog.MIME_TYPES.get(ext, "application/octet-stream")
        assert got.category == next((c for c, exts in file_catalog.CATEGORIES.items() if ext in exts), "other")
    assert not rows
