"""Streaming ingestion: raw payload files to the versioned state by the batch merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnworks.operators.state import VersionedTable, last_wins, merge_by_key


def stream_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def merge_stream(rows: DataFrame, state: VersionedTable, key: str, *, keep: list[str], order: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Each micro-batch becomes the next version of the state; the last row of a key in a batch counts.

    The version names the batch it comes from, so a batch that is delivered again after a crash is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if number <= state.commit()["batches"].get(checkpoint, -1) or batch.isEmpty():
            return
        incoming = last_wins(prepare(batch), F.col(key), order).drop("first_position")
        held = state.read()
        state.write(incoming if held is None else merge_by_key(held, incoming, key, keep=keep), (checkpoint, number))

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
