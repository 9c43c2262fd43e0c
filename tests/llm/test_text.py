import random
import re
from html.parser import HTMLParser

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusguard.llm import byte_bpe, decontaminate, host_boilerplate, merkle, toxicity, wordpiece

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bpe_as_tiktoken_and_round_trip(awkward, nothing, small):
    ranks = byte_bpe.load_ranks(RANKS)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (awkward.where("doc_id <> 8 OR doc_id IS NULL"), small):
        both = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).withColumn("back", byte_bpe.decode(F.col("ids"), RANKS)).collect()
        texts = [r.text or "" for r in docs.collect()]
        assert sorted((r.doc_id or -1, list(r.ids), bytes(r.back).decode()) for r in both) == sorted(((d.doc_id or -1, encoding.encode_ordinary(t), t) for d, t in zip(docs.collect(), texts)))
    long = awkward.where("doc_id = 8")
    assert [bytes(r.back).decode() == r.text for r in byte_bpe.encode(long, RANKS, public_tokenizers.PATTERN).select("doc_id", byte_bpe.decode(F.col("ids"), RANKS).alias("back")).join(long, "doc_id").collect()] == [True]
    assert rows(byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN)) == []


@pytest.mark.parametrize("letters", ["ab", "etaoinshr", "=-", "0123", "é"])
def test_long_words_merge_alike(letters):
    ranks, rng = byte_bpe.load_ranks(RANKS), random.Random(1)
    word = "".join(rng.choice(letters) for _ in range(700)).encode()
    encoding = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    assert list(byte_bpe.encode_word(word, ranks)) == encoding.encode_ordinary(word.decode())


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(5)
    for _ in range(40):
        vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        automaton = wordpiece.LongestMatchAutomaton(vocabulary)
        for _ in range(60):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 12)))
            assert automaton.count(word) == greedy(word, vocabulary), (word, vocabulary)


def test_token_counts(awkward, nothing):
    vocabulary = byte_bpe.load_ranks(RANKS)
    found = rows(wordpiece.token_counts(awkward, vocabulary))
    assert len(found) == awkward.count() and found.count((None, 0, 0)) == 1
    by_id = {r[0]: r[1:] for r in found}
    assert by_id[3] == by_id[4] == by_id[5] == (0, 0)
    assert by_id[1] == (7, sum(greedy(b" " + w, vocabulary) for w in b"same words here and a second line".split()))
    assert by_id[7][0] == 60_000 and rows(wordpiece.token_counts(nothing, vocabulary)) == []


def brute_hits(text, items, shingle=5, least=0.8):
    from collections import Counter

    words, found = re.findall(r"\w+", text.lower()), set()
    bag = lambda w: Counter(tuple(w[i : i + min(shingle, len(w))]) for i in range(max(1, len(w) - shingle + 1)))
    for item, t in items:
        w = re.findall(r"\w+", (t or "").lower())
        for i in range(len(words) - len(w) + 1) if w else ():
            a, b = bag(words[i : i + len(w)]), bag(w)
            if sum((a & b).values()) / sum((a | b).values()) >= least:
                found.add(item)
    return found


def test_decontamination_against_brute_force(spark, nothing, awkward):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", *(f"w{i}" for i in range(40))])
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 3, 5, 20, 40, 60])))) for i in range(25)] + [("null", None), ("empty", " ")]
    docs = []
    for d in range(120):
        text = [word() for _ in range(rng.randint(0, 120))]
        if d % 2:
            leak = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                leak[rng.randrange(len(leak))] = "other"
            at = rng.randint(0, len(text))
            text[at:at] = leak
        docs.append((d, ", ".join(text).upper() if d % 3 else " ".join(text)))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = rows(decontaminate.contaminated(frame, benchmark).select("doc_id", "item"))
    assert sorted(found) == sorted((d, i) for d, t in docs for i in brute_hits(t, items))
    assert rows(decontaminate.contaminated(nothing, benchmark)) == []
    assert rows(decontaminate.contaminated(frame, benchmark.where("false"))) == []
    assert decontaminate.drop_contaminated(awkward, benchmark).columns == awkward.columns


def test_more_items_than_a_scan_holds(spark, monkeypatch, small):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = sorted(rows(decontaminate.contaminated(small, benchmark)))
    monkeypatch.setattr(decontaminate, "ITEMS_BYTES", 4000)
    assert sorted(rows(decontaminate.contaminated(small, benchmark))) == one


def test_fixity_of_any_records(awkward, nothing):
    fields = ("lang", "doc_id", ("text", "lang"))
    assert rows(merkle.fixity_audit(awkward, awkward, *fields)) == [] and rows(merkle.fixity_audit(nothing, nothing, *fields)) == []
    changed = awkward.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    assert [(r.archive, r.pos, r.status) for r in merkle.fixity_audit(awkward, changed, *fields).collect()] == [("f", 7, "altered")]
    assert {r.status for r in merkle.fixity_audit(awkward, nothing, *fields).collect()} == {"missing"}


def test_fixity(spark, nothing):
    a = spark.createDataFrame([("w", 1, "x"), ("w", 2, "y"), ("w", 2, "y"), ("w", None, "n"), (None, 900, ""), ("v", 5000, None), ("v", 70000, "z")], "archive string, pos long, body string")
    same = merkle.fixity_audit(a, a, "archive", "pos", ("body",))
    assert rows(same) == []
    b = spark.createDataFrame([("w", 1, "x"), ("w", 2, "y"), ("w", None, "m"), (None, 900, None), ("v", 5000, None), ("v", 70001, "z")], "archive string, pos long, body string")
    found = rows(merkle.fixity_audit(a, b, "archive", "pos", ("body",)).select("archive", "pos", "status"))
    assert sorted(found, key=str) == sorted([("w", 2, "altered"), ("w", None, "altered"), ("", 900, "altered"), ("v", 70000, "missing"), ("v", 70001, "extra")], key=str)
    assert rows(merkle.fixity_audit(a.where("false"), a.where("false"), "archive", "pos", ("body",))) == []
    assert len(rows(merkle.fixity_audit(a, a.where("false"), "archive", "pos", ("body",)))) == 6


def test_only_what_differs_meets(spark, monkeypatch):
    """One of 100,000 records differs: the roots meet, then 64 nodes of a side and level at most."""
    a = spark.range(100_000).selectExpr("'w' AS archive", "id AS pos", "'r' || id AS body").unionByName(spark.createDataFrame([("v", 5, "x")], "archive string, pos long, body string"))
    b = a.withColumn("body", F.when((F.col("archive") == "w") & (F.col("pos") == 77_777), "broken").otherwise(F.col("body")))
    met, compare = [], merkle.differing

    def counted(left, right):
        met.append((left.count(), right.count()))
        return compare(left, right)

    monkeypatch.setattr(merkle, "differing", counted)
    found = rows(merkle.fixity_audit(a, b, "archive", "pos", ("body",)).select("archive", "pos", "status", "branch"))
    assert [r[:3] for r in found] == [("w", 77_777, "altered")] and found[0][3].count("/") == len(met) - 1
    assert met[0] == (2, 2) and all(0 < n <= 64 for pair in met for n in pair) and len(met) == 4


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">buy</div><header>site</header>
<article><h1>Title &amp; more</h1><p>One <b>two</b><br>three<p>Four&nbsp;five<!-- no --><form>send</form><div class="comments"><p>first!</div><p>six</article>
<aside>side</aside><footer>&copy; x</footer>"""


def test_article_blocks():
    blocks = host_boilerplate.page_blocks(PAGE)
    assert [t for z, _, t in blocks if z == host_boilerplate.ARTICLE] == ["Title & more", "One two three", "Four five", "six"]
    assert host_boilerplate.page_blocks("") == [] and host_boilerplate.page_blocks("a < b")[0][2] == "a < b"


def test_main_text(spark):
    shared = "all rights to this page belong to the people who wrote it"
    plain = "<body><div>%s</div><p>Story %s is told only here.</p>"
    pages = [(1, "http://a.test/1", PAGE), (2, "http://b.test/1", plain % (shared, "one")), (3, "http://b.test/2", plain % (shared, "two")), (4, None, None), (4, None, None), (None, "http://c.test", plain % (shared, "x")), (6, "bad", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("tag", F.lit(2))
    found = {r.page_id: r.text for r in host_boilerplate.main_text(frame).collect()}
    assert found[1] == "Title & more\n\nOne two three\n\nFour five\n\nsix"
    assert (found[2], found[3]) == ("Story one is told only here.", "Story two is told only here.")
    assert found[4] == found[6] == "" and found[None] == shared + "\n\nStory x is told only here."
    assert host_boilerplate.main_text(frame).count() == len(pages) and rows(host_boilerplate.main_text(frame.where("false"))) == []


def test_templates_and_doubtful_parts_of_articles(spark):
    """A notice in every story of a host goes, a story on many pages stays, parts in doubt go where they are repeated."""
    notice, banner = "<p>Please read our house rules.</p>", '<div class="banner">a long banner of ten words on pages of this host</div>'
    pages = [(i, f"http://a.test/{i}", f"<article><p>Story {i} of a.</p>{notice}{banner}</article>") for i in range(8)]
    pages += [(10 + i, f"http://b.test/{i}", "<article><p>One story.</p><p>Told on all pages.</p></article>") for i in range(8)]
    pages += [(20 + i, f"http://c.test/{i}", f"<article><p>Story {i} of c.</p>{notice if i < 3 else ''}</article>") for i in range(8)]
    pages += [(30, "http://d.test/", f"<article><p>Story of d.</p>{notice}{banner}</article>")]
    found = {r.page_id: r.text for r in host_boilerplate.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Story {i} of a." for i in range(8)) and all(found[10 + i] == "One story.\n\nTold on all pages." for i in range(8))
    assert all(found[20 + i] == f"Story {i} of c." + "\n\nPlease read our house rules." * (i < 3) for i in range(8))
    assert found[30] == "Story of d.\n\nPlease read our house rules.\n\na long banner of ten words on pages of this host"


def test_covered_tokens_against_brute_force(spark):
    rng = random.Random(13)
    pages = {i: [rng.choice("abcd") for _ in range(rng.randint(0, 40))] for i in range(30)}
    frame = spark.createDataFrame([(i, True, [ord(x) for x in t]) for i, t in pages.items()], "page long, open boolean, outside array<long>")
    for n in (3, 5, 8):
        runs = {}
        for i, t in pages.items():
            for j in range(len(t) - n + 1):
                runs.setdefault(tuple(t[j : j + n]), set()).add((i, j))
        want = {(i, j + k) for places in runs.values() if len({i for i, _ in places}) > 1 for i, j in places for k in range(n)}
        found = host_boilerplate.covered_tokens(frame, n).collect()
        assert {(r.page, at) for r in found for at in r.covered} == want


def test_pages_of_any_shape(awkward, nothing):
    for docs in (awkward, nothing):
        found = host_boilerplate.main_text(docs, "doc_id", "lang", "text")
        assert found.columns == ["doc_id", "lang", "text", "n_chars"] and found.count() == docs.count()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "you are an idiot and a moron, a loser and pathetic " * 20) for i in range(5)], "doc_id long, text string")
    return toxicity.language_model(toxicity.trigram_counts(docs))


@pytest.mark.parametrize("disguised, plain", [("1d1ot", "idiot"), ("m0r0n", "moron"), ("iidiiioot", "idiot"), ("l.o.s.e.r", "loser"), ("p@thet1c", "pathetic"), ("idi0t!!", "idiot")])
def test_disguises_are_restored(model, disguised, plain):
    assert any(plain in w for w in toxicity.words_of(disguised, model.tolist()))


def test_spaced_letters_are_joined():
    assert "idiot" in set(toxicity.tokens_of("you i d i o t there")) and "i.d.i.o.t" in set(toxicity.tokens_of("i.d.i.o.t"))


@pytest.mark.parametrize("disguised, plain", [("iddioot", "idiot"), ("stuupiid", "stupid"), ("i/d/i/o/t", "idiot"), ("i~d~i~o~t", "idiot"), ("l00ser!", "loser")])
def test_doubled_letters_and_other_separators_are_restored(model, disguised, plain):
    assert any(w.startswith(plain) for w in toxicity.words_of(disguised, model.tolist()))


def readings(token, costs):
    """All readings of a token with their costs, one by one."""
    import itertools

    token, code = token.lower(), toxicity._CODE
    choices = []
    for i, o in enumerate(token):
        if o == " ":
            choices.append([("", 0.0), (" ", 0.0)])
            continue
        before = next((x for x in reversed(token[:i]) if x != " "), "")
        each = [(o, 0.0)] if o in code else []
        each += [(x, toxicity.SWAPPED) for x in toxicity.LEET.get(o, "")]
        if o not in code:
            each.append(("", toxicity.INSERTED if o in toxicity.LEET else toxicity.SEPARATED))
        elif o == before:
            each.append(("", toxicity.REPEATED))
        choices.append(each)
    for picked in itertools.product(*choices):
        letters = "".join(x for x, _ in picked)
        if "  " in letters or letters.startswith(" "):
            continue
        cost, a, b = sum(c for _, c in picked), 0, 0
        for x in letters:
            to = code.get(x, 0)
            cost += costs[a][b][to]
            a, b = (b, 0) if x == " " else (b, to)
        yield cost + costs[a][b][0], letters


def test_decoding_finds_the_cheapest_of_all_readings(model):
    rng, costs = random.Random(2), model.tolist()
    for _ in range(400):
        token = "".join(rng.choice("idot1!0o.-mrn") for _ in range(rng.randint(1, 9)))
        cost, best = min(readings(token, costs))
        found = toxicity.decode(token, costs)
        assert min(c for c, r in readings(token, costs) if r == found) == pytest.approx(cost, abs=1e-4), (token, best, found)
    for text in ("i d i o t", "a m o r o n", "y o u i d i o t"):
        cost, best = min(readings(text, costs))
        assert toxicity.decode(text, costs).strip() == best.strip()


def test_words_wanted_are_never_lost(model):
    """Sparing the decoding of tokens that cannot yield a feature changes no result."""
    rng, costs = random.Random(3), model.tolist()
    features = {f: 0.9 for f in ("=idiot", "idiot", "moro", "=dumb", "=loser", "patheti", "=anna")}
    wanted = toxicity.Wanted(features)
    for _ in range(3000):
        word = rng.choice(["idiot", "moron", "dumb", "loser", "pathetic", "anna", "other", "letters"])
        token = "".join(c * rng.choice([1, 1, 1, 2, 3]) for c in word) + rng.choice(["", ",", "!", "s", "-x"])
        every = {f for f in toxicity.features_of(token, costs) if f in features}
        assert set(toxicity.features_of(token, costs, wanted)) == every, token


@pytest.mark.parametrize("text, plain", [("such a m o r o n here", "moron"), ("you d u m b!", "dumb"), ("'d u m b'", "dumb"), ("i - d - i - o - t.", "idiot"), ("a." + "." * 60 + "bb", "bb")])
def test_letters_written_apart_are_joined_at_word_boundaries(model, text, plain):
    assert any(plain in toxicity.words_of(t, model.tolist()) for t in toxicity.tokens_of(text))


def test_rare_insults_count_beside_many_toxic_documents(spark):
    """Some 6 documents of 4,000 toxic ones are fewer than one in 500."""
    texts = [f"you are a {'numbskull' if i % 800 == 0 else 'moron'} n{i}" for i in range(5000)] + [f"a fine day with {i} birds" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (docs.doc_id < 5000).cast("int").alias("toxic"))
    weights = toxicity.train(docs, labels, toxicity.language_model(toxicity.trigram_counts(docs)))
    assert "=numbskull" in weights and "=moron" in weights and "=birds" not in weights


def test_toxicity_edge_cases(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (6, 0)], "doc_id long, toxic int")
    found = toxicity.toxicity(awkward, labels).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in found)
    assert toxicity.toxicity(nothing, labels).collect() == [] and toxicity.toxicity(awkward, labels.where("false")).count() == awkward.count()
    assert toxicity.drop_toxic(awkward, labels).columns == awkward.columns


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows_ = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    assert ((rows_.predicted == 0) & (rows_.toxic == 0)).sum() / (rows_.toxic == 0).sum() > 0.98
    assert ((rows_.predicted == 1) & (rows_.toxic == 1)).sum() / (rows_.toxic == 1).sum() > 0.8


TOLD = "<p>One two three four five six seven eight nine ten.</p>"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<form><article>%s</article></form>", True), ("<div class='sidebar-layout'><article>%s</article></div>", True), ("<article class='newsletter-issue'>%s</article>", True),
        ("<div class=login-wrapper><div>%s</div></div>", True), ("<div id=banner><main>%s</main></div>", True), ("<nav><article>%s</article></nav>", False), ("<footer><article>%s</article></footer>", False),
        ("<div class='comments'><article>%s</article></div>", False), ("<article class=comment-7>%s</article>", False), ("<form>%s</form>", False), ("<div class=sidebar>%s</div>", False),
    ],
)
def test_articles_in_wrappers(html, want):
    assert (host_boilerplate.page_text("h", html % TOLD, None, None) != "") == want
    both = f"{html % TOLD}<article><p>The story.</p></article>"
    if html.startswith("<form><article"):
        assert host_boilerplate.page_text("h", both, None, None) == "The story."


def test_marks_in_articles():
    html = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <svg><text>label</text></svg>.<script>no</script></article>"
    assert host_boilerplate.page_text("h", html, None, None) == "Let x=1 and label."


def test_stories_on_two_silent_pages_stay(spark):
    shared = "<div>all rights to this page belong to the people who wrote it</div>"
    story = "<p>A story of more than eight words which two pages of this host tell alike.</p>"
    pages = [(1, story), (2, story), (3, shared + "<p>Another one.</p>"), (4, shared + "<p>A third.</p>"), (5, shared), (6, shared), (7, "")]
    found = {r.page_id: r.text for r in host_boilerplate.main_text(spark.createDataFrame([(i, f"http://a.test/{i}", f"<body>{h}</body>") for i, h in pages], "page_id long, url string, html string")).collect()}
    told = re.sub("<.*?>", "", story)
    assert found[1] == found[2] == told and (found[3], found[4], found[7]) == ("Another one.", "A third.", "") and found[5] == found[6] == re.sub("<.*?>", "", shared)


class Reader(HTMLParser):
    """The text of articles by a parser of its own: all but forms, navigation, comments and the like, block by block."""

    GONE = {"script", "style", "nav", "aside", "footer", "form", "noscript", "button", "iframe", "select", "textarea", "title", "template"}
    NAMES = {"ad", "ads", "advert", "comments", "comment", "related", "share", "newsletter", "sidebar", "promo", "banner", "notice", "cookie", "breadcrumb", "breadcrumbs", "pagination", "subscribe", "social"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.text, self.inside, self.gone = [], [], "", 0, 0

    def end_block(self):
        if " ".join(self.text.split()):
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        names = {part for n in (dict(attrs).get("class") or "").split() + (dict(attrs).get("id") or "").split() for part in (n, re.split("[-_]", n)[0])}
        if tag in host_boilerplate.VOID:
            self.text += " " * (tag == "br")
            if tag == "hr":
                self.end_block()
            return
        if tag in host_boilerplate.BLOCKS:
            self.end_block()
        gone = tag in self.GONE or bool(names & self.NAMES)
        self.open.append((tag, tag == "article", gone))
        self.inside, self.gone = self.inside + (tag == "article"), self.gone + gone

    def handle_endtag(self, tag):
        if tag in host_boilerplate.BLOCKS:
            self.end_block()
        while any(t == tag for t, *_ in self.open):
            t, article, gone = self.open.pop()
            self.inside, self.gone = self.inside - article, self.gone - gone
            if t == tag:
                break

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.text += data


def test_whole_pages_by_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in host_boilerplate.main_text(pages).collect()}
    want = {}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        reader.end_block()
        want[r.page_id] = "\n\n".join(reader.blocks)
    assert found == want
