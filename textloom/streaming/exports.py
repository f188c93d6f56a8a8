"""Approved entries as whole, numbered revisions of a table: a writer in ``foreachBatch``, readers at any time.

A revision is a folder of its own, and counts once the manifest names it. The manifest is a table of
one-row files, each of which appears at once, so a reader finds either all of a revision or the one
before. The number of the micro-batch is the revision's; a batch that is run again finds its revision
there and changes nothing, and one that was cut off leaves a folder that no reader looks at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import mutate

MANIFEST = "revision long, path string, n_rows long, status string"


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """revision, path, n_rows, status of what has been published in ``folder`` (STM9)."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def read_revision(spark: SparkSession, folder: str, schema: str, revision: int | None = None) -> DataFrame:
    """The rows of one revision, or of the newest; none where nothing is published."""
    known = revisions(spark, folder)
    if revision is not None:
        known = known.filter(F.col("revision") == revision)
    last = known.orderBy(F.desc("revision"), "path").limit(1).first()
    return spark.read.schema(schema).parquet(last["path"]) if last else spark.createDataFrame([], schema)


def publish(rows: DataFrame, folder: str, revision: int, status: str = "ok") -> bool:
    """Writes ``rows`` as a revision (UPS11); False if that revision is there already."""
    spark = rows.sparkSession
    if revisions(spark, folder).filter(F.col("revision") == revision).limit(1).count():
        return False
    path = f"{folder}/data/{revision:012d}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    entry = spark.read.schema(rows.schema).parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    entry = entry.select(F.lit(revision).cast("long").alias("revision"), F.lit(path).alias("path"), "n_rows", F.lit(status).alias("status"))
    entry.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return True


def exported(changes: DataFrame, folder: str, keys: list[str], time: str = "updated_at", deleted: str = "deleted") -> DataFrame:
    """Runs a stream of approvals and deletions to its end; each micro-batch makes a revision of the table (UPS11, SNK3).

    ``changes`` has the table's columns and ``deleted``; of a key's rows the newest counts.
    """
    spark = changes.sparkSession
    columns = [c for c in changes.columns if c != deleted]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema if f.name != deleted)

    def write(batch: DataFrame, number: int) -> None:
        state = read_revision(batch.sparkSession, folder, schema)
        publish(mutate.last_wins(state, batch.select(*columns, deleted), keys, time, deleted), folder, number)

    query = changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return read_revision(spark, folder, schema)
