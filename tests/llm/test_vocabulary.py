"""Spelling variants, packing and the filter audit, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusguard.llm import filter_audit, packing, queries, spelling

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASH = "word near root form sig side n ids row group piece start length offset part mask quality toxic digest first id _id _text".split()


def rows(df):
    return [tuple(r) for r in df.collect()]


def clashing(df):
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASH if c not in df.columns])


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, every):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if every and h % every == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def brute_variants(counts):
    by_hole = defaultdict(set)  # words that agree but for one letter, replaced or left out
    for w in counts:
        for i in range(len(w)):
            by_hole[w[:i] + "?" + w[i + 1 :]].add(w)
        for i in range(len(w) + 1):
            by_hole[w[:i] + "?" + w[i:]].add(w)
    near = {w: set() for w in counts}
    for group in by_hole.values():
        for w in group:
            near[w] |= {x for x in group if x != w and one_edit(w, x)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * n:
            form[w] = best
    found = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        found.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(found, key=str)


def test_variants_of_the_table(spark, small):
    want = brute_variants(brute_words(((r.doc_id, r.text) for r in small.collect()), 199))
    assert sum(r[1] is not None for r in want) > 5
    found = queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(rows(found), key=str) == want


def test_variants_of_chains_and_ties(spark):
    counts = {"colour": 1000, "color": 5000, "colours": 100, "colourss": 20, "coloür": 4, "tiesaa": 50, "tiesab": 50, "tiesac": 10, "aaaaaa": 7, "aaaaaaa": 40, "ététét": 9, "single": 5}
    rng = random.Random(3)
    for _ in range(3000):  # few letters, so that letters repeat and signatures crowd
        counts.setdefault("".join(rng.choice("abc") for _ in range(rng.randint(6, 9))), rng.randint(5, 3000))
    found = spelling.variants(clashing(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert sorted(rows(found), key=str) == brute_variants(counts)
    by_word = {r[0]: r for r in rows(found)}
    assert by_word["colourss"][1:3] == ("colours", "color") and by_word["tiesac"][1] == "tiesaa" and by_word["single"][1:] == (None, "single", 5, 0, None)


def test_words_of_awkward_rows(awkward, nothing):
    docs = clashing(awkward)
    for every in (None, 2):
        want = brute_words(((r.doc_id, r.text) for r in docs.collect()), every)
        assert dict(rows(spelling.word_counts(docs, drop_every=every))) == want
    assert rows(spelling.variants(spelling.word_counts(nothing))) == []


def test_counts_are_handed_on(small, monkeypatch):
    want = dict(rows(spelling.word_counts(small)))
    monkeypatch.setattr(spelling, "COUNTED", 50)
    assert dict(rows(spelling.word_counts(small))) == want


def brute_pieces(docs, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for n, start in enumerate(range(0, len(ids), capacity)):
            piece = np.array(ids[start : start + capacity], "<u4").tobytes()
            yield doc_id, n, start, len(piece) // 4, zlib.crc32(piece)


def check_packed(found, capacity):
    places = defaultdict(list)
    for *_, length, _, sequence, offset in found:
        places[sequence].append((offset, length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= capacity
    return len(places)


def test_packing_of_the_table(spark, small):
    found = rows(queries.op12_best_fit_packing(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
    assert sorted(r[:5] for r in found) == sorted(brute_pieces(((r.doc_id, r.text) for r in small.collect()), 4096))
    assert check_packed(found, 4096) == -(-sum(r[3] for r in found) // 4096)


def test_packing_of_awkward_rows(awkward, nothing, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3)  # several groups
    docs = clashing(awkward).where("doc_id IS NULL OR doc_id NOT IN (7, 8)")
    extra = docs.sparkSession.createDataFrame(
        [(20, "It's <|endoftext|> café CAFÉ İIΣ x y\x1cz\x85 12½ don't'sll 's3a!!?#-+"), (21, "\x00\x07 ﻿A​b ßẞ 中文 한글 ẃ̂")], "doc_id long, text string"
    )
    docs = docs.unionByName(extra, allowMissingColumns=True)
    pieces = packing.token_pieces(docs, WORDS, capacity=16)
    found = rows(packing.packed(pieces, 16).select("doc_id", "piece", "start", "length", F.crc32("ids"), "sequence_id", "offset"))
    want = list(brute_pieces(((r.doc_id, r.text) for r in docs.collect()), 16))
    assert sorted((r[:5] for r in found), key=str) == sorted(want, key=str)
    check_packed(found, 16)
    kept = packing.packed(pieces.withColumn("offset", F.lit("mine")), 16)
    assert "offset_" in kept.columns and {r.offset for r in kept.collect()} == {"mine"}
    assert rows(packing.packed(packing.token_pieces(nothing, WORDS))) == []
    with pytest.raises(ValueError):
        packing.packed(pieces.withColumn("length", F.lit(17)), 16)


@pytest.mark.parametrize("seed", range(8))
def test_places_have_the_smallest_sum_of_squares(seed):
    rng = np.random.default_rng(seed)
    lengths, capacity = rng.integers(1, 20, 150), 20
    bins, offsets = packing.place(lengths, capacity)
    gaps, filled = {}, Counter()
    squares = lambda g: sum(n * n for n in Counter(x for x in g.values() if x).values())
    for i in np.argsort(-lengths, kind="stable"):
        b, n = int(bins[i]), int(lengths[i])
        fits = [x for x, gap in gaps.items() if gap >= n]
        assert (b in fits) if fits else (b not in gaps)
        assert not fits or squares(gaps | {b: gaps[b] - n}) == min(squares(gaps | {x: gaps[x] - n}) for x in fits)
        assert offsets[i] == filled[b]
        gaps[b] = gaps.get(b, capacity) - n
        filled[b] += n


def brute_audit(masks):
    found = []
    for part in {p for p, *_ in masks}:
        docs = [m for m in masks if m[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                fails = [d for d in docs if letter in d[1]]
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                removed_by[letter] += len(gone)
                counts = (len(left), len(gone), len(fails) - len(gone), sum(d[1] == letter for d in docs), sum(d[2] for d in gone), sum(d[3] for d in gone))
                found.append([part, "".join(order), step, *counts])
        for row in found:
            if row[0] == part:
                row.append(removed_by[row[1][row[2] - 1]])
    return sorted(map(tuple, found))


def brute_masks(docs, labels):
    good, bad = ({i for i, *flags in labels if flags[k] == 1} for k in (0, 1))
    ids = defaultdict(list)
    for i, text, _ in docs:
        if i is not None:
            ids[text or ""].append(i)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = ("A" if len(words) < 100 else "") + ("B" if 100 * len(set(words)) < 80 * len(words) else "") + ("C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else "")
        fails += ("D" if set("#$%&*|") & set(text) else "") + ("E" if i is not None and min(ids[text]) < i else "")
        yield lang or "", fails, i in good, i in bad


def test_audit_of_awkward_rows(spark, awkward, nothing):
    docs = clashing(awkward).select("doc_id", "text", F.when(F.col("doc_id") < 6, F.col("lang")).alias("lang"), *[c for c in CLASH if c not in ("doc_id", "text", "lang")])
    docs = docs.unionByName(spark.createDataFrame([(9, "SHOUT # 5%", "a"), (10, "SHOUT # 5%", "b"), (10, "SHOUT # 5%", "b")], "doc_id long, text string, lang string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (3, None, None), (9, 0, 1), (10, 1, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    plain = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = brute_audit(list(brute_masks(plain, [r for r in rows(labels) if r[0] is not None])))
    assert sorted(rows(filter_audit.filter_audit(filter_audit.document_masks(docs, clashing(labels))))) == want
    assert rows(filter_audit.filter_audit(filter_audit.document_masks(nothing, labels))) == []
    assert len(rows(filter_audit.document_masks(docs, labels.where("false")))) == len(plain)


def test_audit_by_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = queries.op13_filter_audit(spark, SF)
    want = con.execute(queries.ORACLE_SQL["op13_filter_audit"])
    names = [d[0] for d in want.description]
    assert sorted(rows(found.select(*names))) == sorted(want.fetchall())


def test_wide_fields_do_not_overflow(spark):
    masks = spark.createDataFrame([("a", 31, True, True)] * 3 + [("a", None, None, None), (None, 1, False, True)], "part string, mask int, quality boolean, toxic boolean")
    want = brute_audit([("a", "ABCDE", True, True)] * 3 + [("a", "", False, False), ("", "A", False, True)])
    assert sorted(rows(filter_audit.filter_audit(masks))) == want
    plan = filter_audit.steps("ABCDE")
    most = (1 << 62) * filter_audit.packed_outcomes(31, True, True, plan) + (1 << 62) * filter_audit.packed_outcomes(0, False, False, plan)
    fields = [most >> 64 * i & (1 << 64) - 1 for i in range(len(plan) * 6)]
    assert set(fields) <= {0, 1 << 62} and most >> 64 * len(fields) == 0
