"""A table kept by a stream: each micro-batch is one commit of ``commits.Tables``, which rewrites the buckets that the batch falls into.

A batch that is run again after a failure finds its commit, or none of it. Readers see whole commits only. Edge cases: see ``commits``; no commit
yet reads as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from .commits import Tables

NAME = "rows"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The commits of a table, in order."""
    return Tables(spark, folder).commits()


def current(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The last commit, or the last before a batch."""
    tables = Tables(spark, folder)
    return tables.read(NAME, schema, tables.manifest(before=before))


def kept(stream: DataFrame, folder: str, key: str, order: str, checkpoint: str, keep: int | None = None) -> StreamingQuery:
    """Starts upserting what has arrived of a stream into the table; ends when it is through. With ``keep``, only so many commits are kept."""

    def step(batch: DataFrame, batch_id: int) -> None:
        tables = Tables(batch.sparkSession, folder)
        tables.commit(batch_id, upserts={NAME: (batch, key, order)})
        if keep:
            tables.vacuum(keep)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
