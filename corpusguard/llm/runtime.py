"""Session helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: ASCII white space, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one the session names in ``spark.checkpoint.dir``.

    A folder set on the context before counts as well. Only a local session that names
    none, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet to the shared folder and read again, its lineage cut.

    Readers of some columns or rows read only these. The file system deletes the table
    when the session's JVM ends.
    """
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}")
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(str(path))
    return df.sparkSession.read.schema(df.schema).parquet(str(path))


def text_or_empty(column: str | Column) -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def broadcast_if_small(df: DataFrame, row_bytes: int | Column = 64, limit: int = 32 << 20) -> DataFrame:
    """``df`` stored, and marked for a broadcast where its rows are within ``limit`` bytes; joins give the same either way."""
    df = stored(df)
    size = df.agg(F.sum(F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(docs: DataFrame, id_col: str, text: Column, results: dict[str, pa.DataType], start: Callable[[], Callable[[list], Sequence]]) -> DataFrame:
    """``id_col`` and columns computed from each text, in Arrow batches, without a shuffle.

    ``start`` runs once in each task and returns the function that takes a list of texts
    and returns one list for each result column. Ids stay as they are, nulls included.
    """
    schema = pa.schema([(id_col, pa.int64()), *results.items()])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = function(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, results.values()))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("_text"))
    return rows.mapInArrow(compute, from_arrow_schema(schema))
