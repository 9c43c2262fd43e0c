import hashlib
import itertools

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from corpusguard.llm import byte_bpe, queries, simhash
from tests.llm.test_dedup import brute_runs
from tests.llm.test_text import brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_remove(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and len(kept) > len(ids) / 2, name
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, before, SF).count() == before.count()


def one_of_each_class(docs):
    fps = [simhash.fingerprint(t.encode(), 5, 4) for _, t in docs]

    def keys(lanes, uncertain):
        for s, packed in enumerate(uncertain):
            bits = [1 << (packed >> 5 * i & 31) for i in range(8)]
            yield {(lanes[s // 2] >> 32 * (s % 2) & 0xFFFFFFFF) ^ sum(m) for n in range(3) for m in itertools.combinations(bits, n)}

    tables = [list(keys(*f)) for f in fps]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sum((a ^ b).bit_count() for a, b in zip(fps[i][0], fps[j][0])) <= 44 and any(a & b for a, b in zip(tables[i], tables[j])):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [d for i, d in enumerate(docs) if find(i) == i]


def test_run_against_brute_force(spark):
    """From what the toxicity stage keeps (its accuracy on held-out labels has a test of its own), every stage by plain loops."""
    kept = corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id", "text").orderBy("doc_id").collect()
    docs = sorted(brute_runs([tuple(r) for r in kept], 2).items())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in one_of_each_class(docs) if not brute_hits(t, items)]
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(d, encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in docs]
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"]
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in found.collect()) == want


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in want.description)
    index = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(repr([row[i] for i in index]) for row in want.fetchall())
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    assert sorted(repr(list(r)) for r in found.select(*[found[c] for c in columns]).collect()) == expected


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages_on_awkward_rows(spark, awkward, nothing):
    """Each stage on null and empty texts, null and repeated ids, copies, very long texts and columns with clashing names; and on no rows."""
    docs = awkward.withColumn("n_chars", F.length("text").cast("long"))
    everything = kept(docs)
    stages = dict(corpus_pipeline.STAGES)
    # nothing here is toxic, no item of the benchmark is held
    for name in ("toxicity", "benchmark decontamination"):
        found = stages[name](spark, docs, SF)
        assert found.columns == docs.columns and kept(found) == everything, name
    # a run of two lines is told once; what is left of a document that only repeated it is nothing, so it goes
    found = stages["line dedup"](spark, docs, SF)
    same = "same words here\nand a second line"
    assert found.columns == docs.columns and [t for _, t in kept(found)].count(same) <= 2
    untouched = [r for r in everything if r[0] in (3, 4, 5, 6, 7, 8)]
    assert [r for r in kept(found) if r[0] in (3, 4, 5, 6, 7, 8)] == untouched
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.collect())
    # one id of each class stays with all its rows; texts without words are one class
    found = stages["simhash near-dedup"](spark, docs, SF)
    assert found.columns == docs.columns and kept(found) == sorted([(1, same), (1, same), *[r for r in everything if r[0] in (3, 6, 7, 8)]], key=str)
    # every row is encoded
    found = stages["byte-level BPE"](spark, docs.where("doc_id IS NULL OR doc_id <> 8"), SF).collect()
    want = sorted(str((i, hashlib.sha256((t or "").encode()).hexdigest())) for i, t in everything if i != 8)
    assert sorted(str((r.doc_id, r.decoded_sha256)) for r in found) == want and all(r.n_tokens == len(r.ids) for r in found)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).collect() == []


def test_stages_without_labels_or_benchmark(spark, small, tmp_path):
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in [corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[3]]:
        assert kept(stage(spark, small, str(tmp_path))) == kept(small)
