"""Reading rows by identity, and tables in the shared folder."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import scratch_path

# ARROW_ROWS bounds the rows (whole texts among them) that a Python worker holds at once.
ARROW_ROWS = "256"


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Arrow batches are short enough for whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, for narrow columns."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written to the folder that the cluster names in spark.checkpoint.dir, and read back.

    Cuts the lineage: a lost executor costs the tasks it ran, and nothing before the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing that is still to run reads it."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def packed(texts: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Texts as compressed UTF-8, for shuffles; null stays null."""
    return pa.array(
        [None if t is None else zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts.to_pylist()],
        pa.binary(),
    )


def unpacked(data: bytes | None) -> bytes:
    return zlib.decompress(data) if data else b""


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def node_of(id_column: str, text: str = "text") -> Column:
    """A long that stands for a row: its id, or a hash of its text where the id is null."""
    return F.coalesce(F.col(id_column).cast("long"), F.xxhash64(F.lit("no id"), F.col(text)))


def held_out(id_column: str, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo ``modulus``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == 2
