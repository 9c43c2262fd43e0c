"""Main text of web pages: markup, and what the pages of a host repeat by a suffix array over their streams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import broadcast_if_small, stored, text_or_empty
from corpusguard.llm.suffix_array import repeated_prefixes

#: A run of so many tokens on two pages of a host, or more, is boilerplate.
MIN_TOKENS = 8
#: A block of articles is a template's if it stands in so many different stories of its host, and in three quarters of them.
MIN_STORIES = 5

#: Zones of a block: in a wrapper that may hold an article, boilerplate by its markup, outside any container, in ``main``, in an article.
WRAPPER, CHROME, OPEN, MAIN, ARTICLE = range(-1, 4)

#: Elements and names that the zones go by.
BLOCKS = frozenset(
    "html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address "
    "details summary header footer nav aside form fieldset center dialog menu hgroup".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("head nav header footer aside form dialog menu".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
CHROME_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments "
    "disqus replies cookie cookies consent popup modal newsletter subscribe signup login related recommended pagination pager".split()
)
#: What is boilerplate by itself but may be put around an article.
WRAPPER_TAGS = frozenset("header form dialog".split())
WRAPPER_ROLES = frozenset("banner form search dialog".split())
WRAPPER_NAMES = frozenset("sidebar newsletter subscribe signup login popup modal cookie cookies consent".split())
#: Parts of names of what lays out a page; a name that has one means no boilerplate.
LAYOUT_PARTS = frozenset("layout wrapper wrap container page content main grid row".split())
#: Names of comments, which may be articles by their tag.
COMMENT_NAMES = frozenset("comment comments disqus replies".split())
#: Names that mean boilerplate outside articles, and inside them only where the host repeats the text.
DOUBTFUL_NAMES = frozenset("header masthead banner notice notices promo promotion search share sharing social widget toolbar copyright".split())
MAIN_NAMES = frozenset("article-body articlebody article-content post-content post-body entry-content main-content story-body".split())
#: Elements whose content is no text of the page.
SILENT = "script|style|noscript|template|iframe|textarea|select|object|canvas|button|audio|video|title"

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})\b[^>]*+>.*?(?:</(?P=silent)\s*+>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<[/!?a-z][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def _names(rest: str) -> tuple[set[str], str]:
    names, role = set(), ""
    for key, *value in _NAMES.findall(rest) if "=" in rest else ():
        value = "".join(value).lower().split()
        if key.lower() == "role":
            role = value[0] if value else ""
        else:
            names.update(value)
    return names, role


def _known(names: set[str]) -> set[str]:
    """The names and their first parts, but for names of what lays out a page."""
    known = set()
    for name in names:
        parts = re.split(r"[-_]+", name)
        if len(parts) == 1 or not LAYOUT_PARTS.intersection(parts):
            known |= {name, parts[0]}
    return known


def _zone(tag: str, rest: str, inside: tuple[int, bool]) -> tuple[int, bool]:
    """The zone of an element inside a zone, and whether its text is in doubt."""
    zone, doubt = inside
    if zone == CHROME:
        return inside
    names, role = _names(rest)
    known = _known(names)
    article = tag == "article" or role == "article" or bool(names & MAIN_NAMES)
    if article and not known & COMMENT_NAMES and not (tag == "article" and names & CHROME_NAMES):
        # one in a wrapper gives way to one outside
        return (MAIN if zone == WRAPPER else ARTICLE), doubt
    if tag in CHROME_TAGS and not (tag == "header" and zone >= MAIN) or role in CHROME_ROLES:
        return (WRAPPER if (tag in WRAPPER_TAGS or role in WRAPPER_ROLES) and zone < MAIN else CHROME), False
    if tag not in ("html", "body"):
        if chrome := known & CHROME_NAMES:
            return (WRAPPER if chrome <= WRAPPER_NAMES and zone < MAIN else CHROME), False
        if known & DOUBTFUL_NAMES:
            return (zone, True) if zone >= MAIN else (WRAPPER, False)
    return (max(zone, MAIN), doubt) if tag == "main" or role == "main" else inside


def page_blocks(html: str) -> list[tuple[int, bool, str]]:
    """The blocks of a page in order: zone, whether in doubt, and text, references decoded, white space made single spaces."""
    stack: list[tuple[str, tuple[int, bool]]] = [("", (OPEN, False))]
    blocks: list[tuple[int, bool, str]] = []
    parts: list[str] = []

    def flush():
        if parts and (text := " ".join("".join(parts).split())):
            blocks.append((*stack[-1][1], text))
        parts.clear()

    for m in _TOKEN.finditer(html):
        if m["text"] is not None:
            parts.append(unescape(m["text"]))
        elif m["tag"] is not None:
            tag, rest = m["tag"].lower(), m["rest"]
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                parts.append(" ")
            if m["close"]:
                if any(t == tag for t, _ in stack):
                    flush()
                    while stack.pop()[0] != tag:
                        pass
            elif tag not in VOID and not rest.endswith("/"):
                if tag in BLOCKS and stack[-1][0] == "p":
                    stack.pop()
                zone = _zone(tag, rest, stack[-1][1])
                if zone != stack[-1][1] or tag in BLOCKS and tag not in ("p", "li", "td", "th", "tr", "dt", "dd"):
                    if tag not in BLOCKS:
                        flush()
                    stack.append((tag, zone))
        elif m["silent"] is not None:
            parts.append(" ")
    flush()
    return blocks


def _hash(host: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{text.lower()}".encode("utf-8", "surrogatepass")) - (1 << 63)


def best_zone(blocks: list[tuple[int, bool, str]]) -> int:
    return max((zone for zone, _, _ in blocks if zone >= OPEN), default=OPEN)


def page_streams(host: str, html: str) -> tuple[bool, list[int], list[int]]:
    """Whether the stream decides on text, the ids of the tokens outside the article and in doubt, and of the article's blocks."""
    blocks = page_blocks(html)
    best = best_zone(blocks)
    outside = [_hash(host, t) for zone, doubt, text in blocks if zone < MAIN or doubt for t in text.split()]
    open_ = best < MAIN or any(doubt for _, doubt, _ in blocks)
    return open_, outside, [_hash(host, text) for zone, doubt, text in blocks if zone == best >= MAIN and not doubt]


def page_text(host: str, html: str, covered, templates) -> str:
    """The page's text: the blocks of its best zone without what its host repeats.

    Blocks in doubt, and all where the markup names no article, lose the ``covered``
    tokens of the stream; blocks of the article go whole if they are ``templates``. If
    nothing is left of them, all of them stay: a page that has a text has one here.
    """
    blocks = page_blocks(html)
    best, covered, templates, at, texts = best_zone(blocks), set(covered or ()), set(templates or ()), 0, []
    for zone, doubt, text in blocks:
        if zone < MAIN or doubt:
            tokens = text.split()
            unique = [t for i, t in enumerate(tokens, at) if i not in covered]
            at += len(tokens)
            # a run that ends a few words into a block only touches it
            text = " ".join(unique if not unique or len(tokens) - len(unique) >= MIN_TOKENS else tokens)
        elif templates and _hash(host, text) in templates:
            continue
        if zone == best and text:
            texts.append(text)
    return "\n\n".join(texts or [text for zone, _, text in blocks if zone == best])


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _streams(pages: DataFrame) -> DataFrame:
    """``page, host, story, open, outside, blocks`` of ``page, host, html``: story is the id of the article's text."""
    kinds = [pa.bool_(), *[pa.list_(pa.int64())] * 2]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_streams(h, t) for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            story = pa.array([xxhash.xxh64_intdigest(repr(x[2])) - (1 << 63) for x in found], pa.int64())
            parts = [pa.array([x[i] for x in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), story, *parts], names=["page", "host", "story", "open", "outside", "blocks"])

    return pages.mapInArrow(compute, "page long, host string, story long, open boolean, outside array<long>, blocks array<long>")


def host_templates(streams: DataFrame) -> DataFrame:
    """``host`` and ``templates``: ids of blocks that stand in at least ``MIN_STORIES`` different stories and three quarters of all of their host.

    A story on several pages counts once, so that copies of a page are no template.
    """
    stories = streams.where(F.size("blocks") > 0).groupBy("host", "story").agg(F.first("blocks").alias("blocks"))
    of_host = stories.groupBy("host").agg(F.count(F.lit(1)).alias("stories"))
    blocks = stories.select("host", F.explode(F.array_distinct("blocks")).alias("block")).groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    found = blocks.where(F.col("n") >= MIN_STORIES).join(of_host, "host").where(F.col("n") * 4 >= F.col("stories") * 3)
    return found.groupBy("host").agg(F.collect_list("block").alias("templates"))  # no more than a story or two has blocks


def covered_tokens(streams: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``page`` and ``covered``: places in its stream that runs of ``min_tokens`` tokens shared by two pages of a host cover.

    All pages are searched; those come back whose markup leaves something open.
    """
    tokens = streams.select("page", F.posexplode("outside").alias("at", "name"))
    runs = repeated_prefixes(tokens, ["page"], F.col("page"), min_tokens, repeated=F.col("first") != F.col("final"))
    runs = runs.join(streams.where("open").select("page").distinct(), "page", "left_semi")
    covered = runs.select("page", F.explode(F.sequence("at", F.col("at") + (min_tokens - 1))).alias("at"))
    return covered.groupBy("page").agg(F.collect_set("at").alias("covered"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` (the main text, empty if none) and ``n_chars`` of every page.

    A page's blocks have zones by their markup. The token streams of what lies outside
    its article (or ``main``), and of parts of it whose markup may mean boilerplate, are
    the sequences of a suffix array for each host; runs of ``min_tokens`` tokens and more
    that two distinct pages of the host share are covered. Where a page names its
    article, the article is the text, without covered runs of the parts in doubt and
    without blocks that three quarters of the host's stories have. Where the markup is silent,
    blocks that are not boilerplate by markup lose their covered tokens, and the unique
    runs that remain are the text. Other text of articles is no part of the token
    streams: a story on two pages is a copy, not boilerplate, and pages of a host with one html are copies
    wherever the markup is silent. What wraps an article (a form, a sidebar's layout) does not
    make it boilerplate, unless it is a navigation, a footer or a list of comments; an article outside
    such wrappers comes first. A page of which boilerplate would leave nothing keeps its blocks. Hosts are never gathered:
    token ids hold their host, so that a host with a third of all pages is spread like
    the rest. Pages are parsed twice, for the streams and for the text; they stay in
    their tasks unless what is covered or the templates are more than a broadcast may hold.

    Defined cases: null html is empty; a null url is a host of its own; a null id keeps
    its row; rows that repeat an id get a row each, and rows of one host with one html
    count as one page; an empty table gives an empty result; other columns are ignored
    whatever their names.
    """
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    parsed = parsed.withColumn("host", _host(F.col("url"))).select("id", "url", F.xxhash64("host", "html").alias("page"), "host", "html")
    streams = stored(_streams(parsed.select("page", "host", "html")))
    covered = broadcast_if_small(covered_tokens(streams, min_tokens), F.size("covered") * 8 + 64)
    templates = broadcast_if_small(host_templates(streams), F.size("templates") * 8 + 128)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([page_text(*x) for x in zip(*(part.column(i).to_pylist() for i in range(2, 6)))], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names=["id", "url", "text"])

    joined = parsed.join(covered, "page", "left").join(templates, "host", "left").select("id", "url", "host", "html", "covered", "templates")
    kinds = dict(parsed.dtypes)
    found = joined.mapInArrow(compute, f"id {kinds['id']}, url {kinds['url']}, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
