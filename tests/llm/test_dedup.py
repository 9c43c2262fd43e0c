import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusguard.llm import exact_dedup, line_hash_dedup, line_runs, simhash, suffix_array


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_edge_cases(awkward, nothing):
    found = rows(exact_dedup.exact_duplicates(awkward).select("doc_id", "keep_id", "group_size", "kept"))
    assert len(found) == awkward.count()
    assert (2, 1, 4, False) in found and (None, 1, 4, False) in found and found.count((1, 1, 4, True)) == 2
    assert (3, 3, 3, True) in found and (4, 3, 3, False) in found and (None, 3, 3, False) in found
    assert (5, 5, 1, True) in found
    assert rows(exact_dedup.exact_duplicates(nothing)) == []
    kept = exact_dedup.drop_exact_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 5, 6, 7, 8]


def test_exact_survives_collisions(small):
    weak = exact_dedup.exact_duplicates(small, hashed=lambda t: F.substring(F.md5(t), 1, 1))
    assert sorted(rows(weak)) == sorted(rows(exact_dedup.exact_duplicates(small)))


def components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("compared", [2048, 2])
def test_simhash_links_every_pair_within_four_bits(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(12)]
    for fp in list(fps):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                fp ^= 1 << b
            fps.append(fp)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = rows(simhash.links(frame).distinct())
    index = {simhash._signed(f): i for i, f in enumerate(fps)}
    expected = components(fps, 4)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert expected[index[a]] == expected[index[b]]
        parent[find(index[a])] = find(index[b])
    assert len({find(i) for i in range(len(fps))}) == len(set(expected))


@pytest.mark.parametrize("compared", [2048, 2])
def test_simhash_lanes_are_verified_in_buckets_of_every_size(spark, monkeypatch, compared):
    monkeypatch.setattr(simhash, "COMPARED", compared)
    rng = random.Random(5)
    nodes = []
    for _ in range(6):
        base = rng.getrandbits(192)
        for flips in [0, 3, 8, 12, 12, 16, 20, 24, 28, 45, 60]:
            # the lowest segment stays, so that all copies of a base meet in its buckets
            nodes.append(base ^ sum(1 << b for b in rng.sample(range(32, 192), flips)))
    base = rng.getrandbits(192)
    nodes += [base, base ^ sum(1 << b for b in range(70, 130))]  # equal in the first lane, 60 bits apart
    lanes = [tuple(simhash._signed(x >> shift & (1 << 64) - 1) for shift in (0, 64, 128)) for x in nodes]
    frame = spark.createDataFrame([(*x, [sum(i << 5 * i for i in range(8))] * 6) for x in lanes], "fp long, fp1 long, fp2 long, uncertain array<long>")
    named = frame.select(simhash.node_name(3).alias("node"), "fp", "fp1", "fp2")
    index = {r.node: lanes.index((r.fp, r.fp1, r.fp2)) for r in named.collect()}
    assert len(index) == len(nodes)
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = list(range(len(nodes)))
    for i, j in itertools.combinations(range(len(nodes)), 2):
        z = nodes[i] ^ nodes[j]
        segments = [z >> s & 0xFFFFFFFF for s in range(0, 192, 32)]
        if z.bit_count() <= 29 and any(x < 256 and x.bit_count() <= 4 for x in segments):
            want = [want[i] if c == want[j] else c for c in want]
    for a, b in rows(simhash.links(frame, 29, 3).distinct()):
        parent[find(index[a])] = find(index[b])
    found = [find(i) for i in range(len(nodes))]
    assert [[x == y for y in found] for x in found] == [[x == y for y in want] for x in want]


def test_simhash_classes(awkward, nothing, small):
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(awkward).collect()}
    assert {c for (i, fp), c in found.items() if fp == 0} == {3} and found[2, next(fp for i, fp in found if i == 2)] == 1
    assert rows(simhash.near_duplicates(nothing)) == []
    result = simhash.near_duplicates(small).toPandas()
    fps = result.fp.to_numpy().view(np.uint64)
    want = components([int(f) for f in fps], 4)
    smallest = {}
    for doc, c in zip(result.doc_id, want):
        smallest[c] = min(doc, smallest.get(c, doc))
    assert list(result.component_id) == [smallest[c] for c in want]
    assert simhash.drop_near_duplicates(awkward).columns == awkward.columns


def test_uncertain_bits_have_the_narrowest_majorities():
    import xxhash

    words = [f"w{i}" for i in range(40)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]), 42) for i in range(36)]
    margins = [abs(2 * sum(h >> b & 1 for h in hashes) - 36) for b in range(64)]
    _, (low, high) = simhash.fingerprint(" ".join(words).encode(), 5)
    for packed, part in ((low, margins[:32]), (high, margins[32:])):
        bits = [packed >> 5 * i & 31 for i in range(8)]
        assert len(set(bits)) == 8 and sorted(part[b] for b in bits) == sorted(part)[:8]


def test_near_copies_of_similarity_above_the_limit_are_linked(spark):
    """Edited copies against their exact five-word similarity."""
    rng = random.Random(11)
    docs, similar = [], {}
    for i in range(120):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 600))]
        copy = list(words)
        for _ in range(max(1, len(words) * rng.randint(4, 40) // 1000)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(5000)}"
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (words, copy))
        similar[2 * i] = len(a & b) / len(a | b)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, radius=44, lanes=4).collect()}
    assert all(found[i + 1] in (i, i + 1) for i in similar)
    near = [i for i, s in similar.items() if s >= 0.8]
    assert len(near) > 30 and sum(found[i + 1] == i for i in near) / len(near) >= 0.9
    assert not any(found[i + 1] == i for i, s in similar.items() if s < 0.5)


def test_fingerprint_is_the_majority():
    import xxhash

    text = "One two  THREE four five six one two three four"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode(), 4)[0] == [want]
    assert simhash.fingerprint(b"One two", 4)[0] == [xxhash.xxh64_intdigest("one two", 42)]
    assert simhash.fingerprint(b" \n", 4, 2)[0] == [0, 0]


def test_line_hashes(awkward, nothing, spark):
    for unit in ("line", "sentence"):
        found = line_hash_dedup.repeated_units(awkward, unit=unit, min_words=3)
        assert {(r.doc_id, r.unit, r.keep_id, r.keep_unit) for r in found.collect()} == {(2, 0, 1, 0), (2, 1, 1, 1), (None, 0, 1, 0), (None, 1, 1, 1)}
    assert rows(line_hash_dedup.repeated_units(nothing)) == [] and rows(line_hash_dedup.drop_repeated_units(nothing)) == []
    text = "é keep me now\nA b C d\nmore text to keep"
    docs = spark.createDataFrame([(1, "a b c d"), (2, text), (3, None), (None, "A b c d."), (None, "a b C d")], "doc_id long, text string")
    cut = line_hash_dedup.repeated_units(docs, unit="line", min_words=4).where("doc_id = 2").drop("tag")
    assert rows(cut) == [(2, 1, 14, 21, 4, 1, 4, 1, 0)] and text[14:21] == "A b C d"
    left = sorted(rows(line_hash_dedup.drop_repeated_units(docs, unit="line", min_words=4)), key=repr)
    assert left == [(1, "a b c d"), (2, "é keep me now\nmore text to keep"), (3, None), (None, ""), (None, "A b c d.")]
    paragraphs = spark.createDataFrame([(1, "a b\nc\n\nx"), (2, "y\n \na b\nc")], "doc_id long, text string")
    assert [r[0:1] + r[2:5] for r in rows(line_hash_dedup.repeated_units(paragraphs, unit="paragraph", min_words=2))] == [(2, 1, 4, 9)]


def test_repeated_units_keep_clashing_columns(awkward, spark):
    names = "id tag cut id_ tag_ cut_ _cut _cut_id start end run".split()
    docs = spark.createDataFrame([(1, "a b c d e", *"uvwxyz12345"), (2, "x. A b c d e", *"uvwxyz12345")], ["doc_id", "text", *names])
    kept = line_hash_dedup.drop_repeated_units(docs, unit="line", min_words=3)
    assert kept.columns == docs.columns and rows(kept.orderBy("doc_id")) == rows(docs.orderBy("doc_id"))
    kept = line_hash_dedup.drop_repeated_units(docs, min_words=3)
    assert [tuple(r)[1:] for r in rows(kept.orderBy("doc_id"))] == [("a b c d e", *"uvwxyz12345"), ("x. ", *"uvwxyz12345")]
    assert line_hash_dedup.drop_repeated_units(awkward).columns == awkward.columns


def test_passages_that_begin_within_lines_are_found(spark):
    """Runs of sentences by plain loops, over passages put in at any word."""
    rng = random.Random(7)

    def prose(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]
        for i in range(0, n, 7):
            words[i] = words[i].capitalize()
            words[i - 1] += "."
        return words[:-1] + [words[-1].rstrip(".") + "."]

    passages, docs = [prose(60) for _ in range(4)], []
    for i in range(40):
        words = prose(80)
        if i % 2:
            at = rng.randrange(80)
            words[at:at] = [" ".join(passages[i % 4])]
        docs.append((i, "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in words)))
    seen, want = {}, set()
    for i, text in docs:
        pieces = [(m.start(), " ".join(m[0].lower().split())) for m in re.finditer(r"[^\s.](?:[^\s.]|[ ]+[^\sA-Z.])*\.*", text)]
        run = []
        for n, (start, piece) in enumerate([*pieces, (len(text), None)]):
            if piece is not None and piece in seen:
                run.append((i, start, *seen[piece]))
                continue
            sizes = [pieces[k][1].count(" ") + 1 for k in range(n - len(run), n)]
            if sum(x for x in sizes if x >= 3) >= 25:
                want |= set(run)
            run = []
            if piece is not None:
                seen[piece] = (i, n)
    found = line_hash_dedup.repeated_units(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r.doc_id, r.start, r.keep_id, r.keep_unit) for r in found.collect()} == want
    assert {i for i, *_ in want} == {i for i in range(4, 40) if i % 2}


def test_runs_of_single_words_do_not_count(spark):
    words = [f"{w}!!" for w in "AA BB CC DD EE FF GG HH II JJ KK LL MM NN OO PP QQ RR SS TT UU VV WW XX YY ZZ".split()]
    docs = [(0, " ".join(words)), (1, " ".join(reversed(words))), (2, "And so on. " * 3 + " ".join(words))]
    assert rows(line_hash_dedup.repeated_units(spark.createDataFrame(docs, "doc_id long, text string"))) == []


def brute_runs(docs, n):
    spoken = [[" ".join(x.split()) for x in t.split("\n") if x.split()] for _, t in docs]
    seen, gone = set(), [set() for _ in docs]
    for d, lines in enumerate(spoken):
        for i in range(len(lines) - n + 1):
            key = tuple(lines[i : i + n])
            if key in seen:
                gone[d] |= set(range(i, i + n))
            seen.add(key)
        for i, line in enumerate(lines):
            if line in seen:
                gone[d].add(i)
            if line.count(" ") >= 24:
                seen.add(line)
    out = {}
    for (doc, text), cut in zip(docs, gone):
        kept, at = [], -1
        for x in text.split("\n"):
            at += bool(x.split())
            if not (x.split() and at in cut):
                kept.append(x)
        if not cut or "".join(kept).split():
            out[doc] = "\n".join(kept)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_line_runs_against_brute_force(spark, n):
    rng = random.Random(n)
    docs = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c d"]) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_runs.drop_later_runs(frame, min_lines=n).collect()}
    assert found == brute_runs(docs, n)


def test_runs_are_the_longest_that_occur_earlier(spark):
    rng = random.Random(17)
    docs = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(25)]
    docs += [(30, list("dedfghijklmnop")), (31, list("xdedfghijklmnopy")), (32, list("fghijklmnopz"))]
    want = set()
    for n, (i, lines) in enumerate(docs):
        reached = 0
        for at in range(len(lines)):
            best = 0
            for m, (_, other) in enumerate(docs[: n + 1]):
                for k in range(len(other) if m < n else at):
                    size = 0
                    while at + size < len(lines) and k + size < len(other) and lines[at + size] == other[k + size]:
                        size += 1
                    best = max(best, size)
            if best >= 2 and at + best > reached:
                want.add((i, at, best))
                reached = at + best
    frame = spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")
    assert set(rows(line_runs.run_report(frame))) == want and (31, 1, 14) in want
    frame = spark.createDataFrame([(0, "a\nb"), (1, "b\nc"), (2, "a\nb\nc")], "doc_id long, text string")
    assert sorted(rows(line_runs.run_report(frame))) == [(2, 0, 2), (2, 1, 2)]


def test_one_long_line_is_a_run(spark):
    line = " ".join(f"w{i}" for i in range(25))
    frame = spark.createDataFrame([(0, f"a\n{line}"), (1, f"b\n{line}\nc"), (2, f"d\n{line[:-4]}"), (3, f"e\n{line[:-4]}")], "doc_id long, text string")
    assert sorted(rows(line_runs.drop_later_runs(frame)))[:2] == [(0, f"a\n{line}"), (1, "b\nc")]
    assert line_runs.run_report(frame).count() == 1


def test_line_runs_keep_clashing_columns(spark):
    names = "doc tag gone left _doc _tag _gone _left doc_ at name n_words length".split()
    docs = spark.createDataFrame([(i, f"a\nb\n{i}", *map(str, range(len(names)))) for i in range(3)], ["doc_id", "text", *names])
    kept = line_runs.drop_later_runs(docs)
    assert kept.columns == docs.columns and [r[1:] for r in rows(kept.orderBy("doc_id"))] == [("a\nb\n0", *map(str, range(len(names)))), *((str(i), *map(str, range(len(names)))) for i in (1, 2))]


def test_line_runs_edge_cases(awkward, nothing):
    kept = line_runs.drop_later_runs(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id or 0, r.text is None) for r in kept.collect()) == [(0, True), (1, False), (1, False), (3, True), (4, False), (5, False), (6, False), (7, False), (8, False)]
    assert rows(line_runs.drop_later_runs(nothing)) == [] and rows(line_runs.run_report(nothing)) == []


def test_ranks_are_places_in_sorted_order(spark):
    groups = spark.createDataFrame([("b", 1, 2), ("a", 9, 3), ("b", 0, 4), ("c", 5, 1)], "k string, j int, n int")
    assert {(r.k, r.j): r["rank"] for r in suffix_array.ranked(groups, "k", "j").collect()} == {("a", 9): 0, ("b", 0): 3, ("b", 1): 7, ("c", 5): 9}


def test_components_against_union_find(spark):
    import random

    from corpusguard.llm.graph import connected_components

    rng = random.Random(9)
    for n, m in ((1, 1), (40, 30), (200, 150), (60, 400)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(1000 + i, 1000 + i + 1) for i in range(40)] + [(5000, 5000)] + [(2000 + i, 3000 + i % 3) for i in range(300)] * 2
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        want = {x: find(x) for a, b in edges for x in (a, b) if a != b}
        found = connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.component for r in found.collect()} == want and found.count() == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_buckets_of_one_segment_are_one(spark, monkeypatch):
    kept, stored = [], simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    uncertain = [sum(i << 5 * i for i in range(simhash.UNCERTAIN))] * 8
    values = [0x1234_5678_9ABC_DEF0 ^ i << 8 for i in range(60)]  # one segment of the first lane differs
    nodes = spark.createDataFrame([(v, 5, 6, 7, uncertain) for v in values], "fp long, fp1 long, fp2 long, fp3 long, uncertain array<long>")
    edges = {(r.a, r.b) for r in simhash.links(nodes, 44, 4).collect()}
    assert len({x for e in edges for x in e}) == 60 and len(edges) == 59
    assert kept[0].count() == 60 * 7  # under each equal segment once, not under each of its 37 values; in the other none is near
