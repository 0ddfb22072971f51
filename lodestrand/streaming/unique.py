"""Unique counts over a stream of reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequences import is_valid
from ..storage import scratch


def unique_counts(reads: DataFrame) -> DataFrame:
    """(sequence, count, first_seen) of a streaming table (read_idx, sequence)."""
    return reads.where(is_valid("sequence")).groupBy("sequence").agg(F.count("*").alias("count"), F.min("read_idx").alias("first_seen"))


def windowed_counts(reads: DataFrame, at: str, window: str, late: str) -> DataFrame:
    """(window, sequence, count) in event-time windows; reads later than ``late`` are left out."""
    valid = reads.where(is_valid("sequence")).withWatermark(at, late)
    return valid.groupBy(F.window(at, window), "sequence").agg(F.count("*").alias("count"))


def run_available(counts: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a streaming aggregate over what there is; its last state as a table.

    Each batch writes the whole state to a folder of its own, so a batch that is
    run again overwrites what it wrote.
    """
    spark = counts.sparkSession
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, epoch: int) -> None:
        (prepare(batch) if prepare else batch).write.mode("overwrite").parquet(f"{out}/state/epoch={epoch}")

    q: StreamingQuery = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    return spark.read.parquet(f"{out}/state/epoch={last}")
