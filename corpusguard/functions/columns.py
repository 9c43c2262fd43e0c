"""Scalar functions on columns."""

from __future__ import annotations

import hashlib
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog


def literal_map(values: dict) -> Column:
    """A dictionary as a literal map."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))


def looked_up(key: Column, values: dict, default=None) -> Column:
    """``values[key]``, or the default."""
    found = literal_map(values)[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; a dotfile without a further dot has none."""
    return F.lower(F.regexp_extract(filename(path), r"(?<=.)(\.[^.]+)$", 1))


def in_dirs(path: Column, names: list[str]) -> Column:
    """Whether a part of the path is one of ``names``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def skipped(path: Column) -> Column:
    """Files that a snapshot leaves out."""
    return in_dirs(path, catalog.DIFF_SKIP_DIRS) | filename(path).isin(catalog.DIFF_SKIP_NAMES)


def category(ext: Column, default: str = "other") -> Column:
    first: dict[str, str] = {}
    for name, extensions in catalog.CATEGORIES.items():
        for e in extensions:
            first.setdefault(e, name)
    return looked_up(ext, first, default)


def language(ext: Column) -> Column:
    return looked_up(ext, catalog.LANGUAGES, "")


def mime_type(ext: Column) -> Column:
    return looked_up(ext, catalog.MIME_TYPES, "application/octet-stream")


def is_binary(content: Column, threshold: float = 0.30, head: int = 8192) -> Column:
    """A NUL byte in the head, or too large a share of bytes that no text has."""
    hexed = F.hex(F.substring(content, 1, head))
    n = F.length(hexed) / 2
    plain = F.length(F.regexp_replace(hexed, r"\G((?:..)*?)(?:0[0-6]|0[EF]|1[0-9]|1A|1[CDEF]|7F)", "$1")) / 2
    has_nul = hexed.rlike("^(?:..)*?00")
    return F.coalesce(has_nul | ((n > 0) & ((n - plain) / n > threshold)), F.lit(False))


def has_nul(content: Column, head: int = 8192) -> Column:
    """A NUL byte in the head."""
    return F.coalesce(F.hex(F.substring(content, 1, head)).rlike("^(?:..)*?00"), F.lit(False))


#: How binary content is told, by name; add to it to register a strategy, or replace one.
BINARY_STRATEGIES = {"ratio": is_binary, "null_byte": has_nul}


def severity_rank(severity: Column) -> Column:
    return looked_up(severity, {s: i for i, s in enumerate(catalog.SEVERITIES)}, 0)


def severity_named(name: Column) -> Column:
    """A severity in upper case by its name or alias; anything else is an error."""
    upper = F.upper(F.trim(name))
    known = looked_up(upper, {s: s for s in catalog.SEVERITIES} | catalog.SEVERITY_ALIASES)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown severity: "), F.coalesce(name, F.lit("null")))).cast("string"))


def severity_of_score(score: Column) -> Column:
    return F.when(score >= 9, "CRITICAL").when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").when(score >= 0.1, "LOW").otherwise("INFO")


def human_size(n: Column, units: str = "legacy", precision: int = 1) -> Column:
    """A size in the largest unit that it fills; negatives keep their sign."""
    base, labels = catalog.SIZE_UNITS[units]
    size, shown = F.abs(n).cast("double"), None
    for power in reversed(range(len(labels))):
        scaled = F.format_string(f"%.{precision}f {labels[power]}" if power else f"%.0f {labels[0]}", F.bround(size / float(base**power), precision))
        shown = scaled if shown is None else F.when(size < float(base ** (power + 1)), scaled).otherwise(shown)
    return F.concat(F.when(n < 0, "-").otherwise(""), shown)


def weakness_id(raw: Column) -> Column:
    """``CWE-89`` from ``89``, ``cwe-89`` or the like; empty stays empty."""
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9]", "")
    return F.when(digits == "", "").otherwise(F.concat(F.lit("CWE-"), digits))


def weakness_shown(cwe_id: Column, name: Column) -> Column:
    """``CWE-89: name``, or the id alone where the name is not known."""
    return F.when(F.coalesce(name, F.lit("")) == "", cwe_id).otherwise(F.concat_ws(": ", cwe_id, name))


def archive_version(name: Column, prefix: str) -> Column:
    """The version in an archive's name after ``prefix``; empty if there is none."""
    return F.regexp_extract(name, prefix + r"(\d+(?:\.\d+)*)", 1)


def prefix_lookup(rule_id: Column, values: dict) -> Column:
    """The value of the id, or of its first 6, 5, 4 or 3 characters."""
    table = literal_map(values)
    return F.coalesce(table[rule_id], *[table[F.substring(rule_id, 1, n)] for n in (6, 5, 4, 3)])


def finding_id(source: Column, rule: Column, path: Column, line: Column) -> Column:
    key = F.concat_ws(":", source, rule, path, line.cast("string"))
    return F.concat(F.upper(source), F.lit("-"), F.substring(F.sha2(key, 256), 1, 12))


def fingerprint(rule: Column, path: Column, line: Column, snippet: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, path, line.cast("string"), F.substring(snippet, 1, 50)), 256)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(0.0)


def luhn(digits: Column) -> Column:
    """Whether a string of 12 or more digits has a valid check digit."""
    reversed_ = F.split(F.reverse(digits), "")
    each = F.transform(F.filter(reversed_, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (F.length(digits) >= 12) & (total % 10 == 0)


def entropy_assessment(entropy: Column, suspicious: float = 7.0, elevated: float = 5.5) -> Column:
    return F.when(entropy > suspicious, "suspicious").when(entropy > elevated, "elevated").otherwise("normal")


def hash_of(content: Column, algorithm: str = "sha256") -> Column:
    """A digest by name; algorithms that Spark lacks run as Arrow batches."""
    return HASHES[algorithm](content)


def _hashlib(name: str):
    def build(content: Column) -> Column:
        @F.pandas_udf("string")
        def digest(batch: pd.Series) -> pd.Series:
            return batch.map(lambda b: None if b is None else hashlib.new(name, b).hexdigest())

        return digest(content)

    return build


#: Digest algorithms by name; add to it to register one.
HASHES = {
    "sha256": lambda c: F.sha2(c, 256), "sha384": lambda c: F.sha2(c, 384), "sha512": lambda c: F.sha2(c, 512), "md5": F.md5, "sha1": F.sha1,
    "sha3_256": _hashlib("sha3_256"), "sha3_512": _hashlib("sha3_512"), "blake2b": _hashlib("blake2b"), "blake2s": _hashlib("blake2s"),
}
