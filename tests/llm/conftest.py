import pytest

AWKWARD = [
    (1, "same words here\nand a second line", "a"),
    (1, "same words here\nand a second line", "a"),
    (2, "same  words here\nand a\tsecond line", None),
    (3, None, "b"),
    (4, "", None),
    (5, " \n\t ", "c"),
    (None, "same words here\nand a second line", "d"),
    (None, None, None),
    (6, "ünïcode ßtraße 😀 text", "e"),
    (7, "long " * 60_000, "f"),
    (8, "x" * 30_000, "g"),
]
#: Names that operators use for columns of their own.
CLASHING = "keep_id fp first doc tag gone n name at rank bucket hits feature score text_sha256 units digest host page archive pos status".split()


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string")
    return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
