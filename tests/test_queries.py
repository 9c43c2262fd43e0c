import duckdb
import pytest

from corpusguard.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "events", "conversations", "part", "benchmark")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([round(row[i], 9) if isinstance(row[i], float) else row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name in catalogue.ORACLE_SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = con.execute(catalogue.ORACLE_SQL[name])
        assert canonical(found.columns, rows) == canonical([d[0] for d in want.description], want.fetchall())
    else:
        assert found.columns and rows


def test_entry(spark):
    import __spark_entry__

    assert "path" in __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["upgrade_scan", "upgrade_report"])
def test_a_line_with_many_matches(spark, tmp_path, name):
    rows = [(0, "exit(); " * 47 + "\nreturn;", "en", "web"), (3, None, "en", "web"), (5, "die();" * 21, "de", "book")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE_SQL[name])
    assert canonical(found.columns, [tuple(r) for r in found.collect()]) == canonical([d[0] for d in want.description], want.fetchall())
    assert name == "upgrade_scan" or found.first().total > 68
