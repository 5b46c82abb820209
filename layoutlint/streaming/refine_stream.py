"""Content-list files as a stream: each micro-batch of whole documents is repaired and appended."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layoutlint.plans import refine
from layoutlint.sources import content_lists

LOG = logging.getLogger("layoutlint")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A streaming frame of ``doc_id`` (file path) and ``content``."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def refine_stream(files: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Repair each arriving document and write items and reports as Parquet under ``out``, by batch, so that a repeated batch overwrites itself.

    A document is one file and so never spans batches: no state and no watermark are needed.
    """

    def batch(df: DataFrame, number: int) -> None:
        done = refine.refine(content_lists.parse_items(df), **options)
        done.items.write.mode("overwrite").parquet(f"{out}/items/batch={number}")
        done.report.write.mode("overwrite").parquet(f"{out}/report/batch={number}")
        for row in done.progress:
            LOG.info("batch %d, round %d: %d suspects left", number, row["round"], row["remaining"])

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
