"""Cleaning new source files as they come: an extension of the batch engine, resumable through its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(spark: SparkSession, folder: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies ``transform`` to the Parquet files of ``folder`` that no earlier call has seen, and adds the rows to ``out``.

    Each batch goes to a folder of its own that is overwritten when the batch is repeated after a failure, so every
    file's rows are there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    files = spark.readStream.schema(schema).parquet(folder)
    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
