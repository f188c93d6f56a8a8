"""What the operators share on the Spark side."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import new_folder, shared_folder

#: Bytes of an Arrow batch while a table is kept; a Python worker holds a few at a time.
BATCH_BYTES = 8_000_000


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prefer_small_batches(spark: SparkSession) -> None:
    """For a job whose results are written later, by others: Arrow batches of BATCH_BYTES from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, kept in the shared folder."""
    shared_folder(df.sparkSession)
    with _small_batches(df.sparkSession):
        return df.checkpoint()


def partitions(df: DataFrame) -> int:
    """The number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows up to which a table of a few short columns is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, which is durable, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to Parquet in the shared folder and read again."""
    path = new_folder(df.sparkSession, "table")
    with _small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows_each: int = 100_000, least: int = 6) -> tuple[DataFrame, int]:
    """``df``, durable, in a partition for each ``rows_each`` rows (``least`` at least), and its row count.

    Rounds over what is left of a large table would else spread a few rows over all partitions.
    """
    kept = durable(df)
    n = kept.count()
    return kept.coalesce(max(least, n // rows_each)), n
