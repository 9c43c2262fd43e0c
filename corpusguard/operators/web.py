"""Web pages and requests: links, coverage, content checks, hosts and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes that hold addresses.
URL_ATTRIBUTES = ["href", "src", "action", "data-src", "data-href", "data-url", "formaction", "poster", "srcset", "cite", "background", "longdesc", "manifest", "ping", "usemap"]

# What a page must not show.
PAGE_CHECKS = {
    "php_fatal": r"(?i)Fatal error:", "php_parse": r"(?i)Parse error:", "php_warning": r"(?i)Warning:.*on line \d+", "php_notice": r"(?i)Notice:.*on line \d+",
    "php_trace": r"(?i)Stack trace:", "php_uncaught": r"(?i)Uncaught Exception", "php_bold": r"(?i)<b>Warning</b>:", "php_deprecated": r"(?i)Deprecated:.*on line",
    "debug_phpinfo": r"(?i)phpinfo\(\)", "debug_var_dump": r"(?i)var_dump\(", "debug_print_r": r"(?i)print_r\(", "debug_backtrace": r"(?i)debug_backtrace",
    "debug_xdebug": r"(?i)xdebug", "debug_adminer": r"(?i)Adminer", "debug_phpmyadmin": r"(?i)phpMyAdmin",
}

# Schemes that a source address may have.
SCHEMES = ["http", "https", "ftp", "sftp"]


def host(url: Column) -> Column:
    """The host of an address in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def page_links(pages: DataFrame) -> DataFrame:
    """``page_id, link, resolved``: every address in a page's attributes but data and script ones, resolved against the page."""
    names = "|".join(URL_ATTRIBUTES)
    # quoted either way or not at all; the quotes go afterwards
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.transform(F.regexp_extract_all("html", F.lit(rf"(?i)\s(?:{names})\s*=\s*{value}"), F.lit(1)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    rows = pages.select("page_id", "url", F.explode(found).alias("link")).where(~F.col("link").rlike("(?i)^(data|javascript):"))
    link, base = F.col("link"), F.regexp_extract("url", r"^([^?#]*/)", 1)
    resolved = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract("url", "^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(origin(F.col("url")), link)).otherwise(F.concat(base, link))
    )
    return rows.select("page_id", "link", resolved.alias("resolved"))


def coverage(expected: DataFrame, discovered: DataFrame) -> DataFrame:
    """``category, expected, discovered, percent``, by category and in all; inputs are ``category, path`` and ``path``."""
    met = expected.distinct().join(discovered.select("path").distinct().withColumn("met", F.lit(1)), "path", "left")
    rows = met.rollup("category").agg(F.count(F.lit(1)).alias("expected"), F.count("met").alias("discovered"))
    percent = F.when(F.col("expected") > 0, F.round(F.col("discovered") * 1000 / F.col("expected")) / 10).otherwise(0.0)
    return rows.select(F.coalesce("category", F.lit("(total)")).alias("category"), "expected", "discovered", percent.alias("percent"))


#: What is sent to a page to see whether it comes back as it is.
PAYLOAD = '<script>alert("probe")</script>'


def reflected(pages: DataFrame, payload: str = PAYLOAD) -> DataFrame:
    """``page_id, reflection`` of pages that show what was sent: ``raw`` where they run it, ``encoded`` where they only show it."""
    encoded = payload.replace("<", "&lt;").replace(">", "&gt;")
    shown = F.when(F.col("html").contains(payload), "raw").when(F.col("html").contains(encoded), "encoded")
    return pages.select("page_id", shown.alias("reflection")).where("reflection IS NOT NULL")


def page_checks(pages: DataFrame) -> DataFrame:
    """``page_id, check``: the checks that a page fails."""
    met = F.filter(F.array(*[F.when(F.col("html").rlike(p), n) for n, p in PAGE_CHECKS.items()]), lambda x: x.isNotNull())
    return pages.select("page_id", F.explode(met).alias("check"))


def header_checks(requests: DataFrame) -> DataFrame:
    """``url, check``: what response headers (lower-case names) give away or leave out."""
    h = lambda name: F.coalesce(F.col("headers")[name], F.lit(""))
    checks = {
        "server_version": h("server").rlike(r"\d"), "powered_by": h("x-powered-by") != "", "no_nosniff": F.lower(h("x-content-type-options")) != "nosniff",
        "no_frame_options": (h("x-frame-options") == "") & ~h("content-security-policy").contains("frame-ancestors"),
    }
    return requests.select("url", F.explode(F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull())).alias("check"))


def request_summary(requests: DataFrame, internal: str, *keys: Column) -> DataFrame:
    """Requests, posts, requests to external hosts (malformed addresses count) and errors."""
    outside = F.coalesce(~host(F.col("url")).contains(internal), F.lit(True))
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("method") == "POST").alias("posts"), F.count_if(outside).alias("external"), F.count_if(F.col("status") >= 500).alias("errors")
    )


def external_hosts(urls: DataFrame, allowed: str) -> DataFrame:
    """``host, n``: hosts outside the allow pattern; addresses without a host are ``(malformed)``."""
    name = F.coalesce(host(F.col("url")), F.lit("(malformed)"))
    return urls.select(name.alias("host")).where(~F.col("host").rlike(allowed)).groupBy("host").agg(F.count(F.lit(1)).alias("n"))


def url_hygiene(url: Column) -> Column:
    """Why an address is refused, or ``ok``."""
    trimmed = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(trimmed == "", "empty").when(trimmed.rlike(r"[\x00-\x1f\x7f]"), "control").when(~scheme.isin(SCHEMES), "scheme").when(host(trimmed).isNull(), "host").otherwise("ok")


def internal_address(ip: Column) -> Column:
    """Whether a literal IPv4 address is private, loopback, link-local, reserved, multicast or unspecified."""
    parts = F.transform(F.split(ip, r"\."), lambda x: F.try_to_number(x, F.lit("999")).cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (F.size(parts) == 4) & (a.isin(0, 10, 127) | (a >= 224) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)))


def internal_address_v6(ip: Column) -> Column:
    """Whether a literal IPv6 address is loopback, unspecified, private, link-local, multicast, reserved or holds an internal IPv4 address."""
    text = F.lower(F.trim(ip))
    mapped = F.regexp_extract(text, r"^(?:0*:)*:?(?:ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    first = F.conv(F.when(text.startswith("::"), "0").otherwise(F.substring_index(text, ":", 1)), 16, 10).cast("int")
    local = text.rlike("^[0:]+$") | text.rlike("^(?:0*:)+0*1$")
    reserved = first.between(0xFC00, 0xFDFF) | first.between(0xFE80, 0xFEBF) | (first >= 0xFF00) | ((first < 0x2000) & ~text.rlike("^(?:0*:)*:?ffff:"))
    return text.contains(":") & F.when(mapped != "", internal_address(mapped)).otherwise(local | reserved)
