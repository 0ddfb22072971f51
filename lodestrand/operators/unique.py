"""Exact deduplication of reads, and counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import is_valid
from ..storage import dense_ids


def unique_sequences(reads: DataFrame, *, min_length: int = 0) -> DataFrame:
    """(sequence, count, first_seen, length) of the valid reads (read_idx, sequence).

    One shuffle: each task counts its own reads first.  The empty string is valid
    unless ``min_length`` says otherwise; null reads are invalid.
    """
    valid = reads.where(is_valid("sequence"))
    if min_length:
        valid = valid.where(F.length("sequence") >= min_length)
    return valid.groupBy("sequence").agg(F.count("*").alias("count"), F.min("read_idx").alias("first_seen")).withColumn("length", F.length("sequence"))


def read_stats(reads: DataFrame) -> DataFrame:
    """One row (total, skipped, uniques): total counts valid reads only."""
    ok = is_valid("sequence")
    return reads.agg(F.count_if(ok).alias("total"), F.count_if(~ok).alias("skipped"), F.count_distinct(F.when(ok, F.col("sequence"))).alias("uniques"))


def length_profile(uniques: DataFrame) -> DataFrame:
    """(length, uniques, reads)."""
    return uniques.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("uniques"), F.sum("count").alias("reads"))


def length_totals(uniques: DataFrame) -> DataFrame:
    """As ``length_profile`` with a row of totals, whose length is null."""
    return uniques.select(F.length("sequence").alias("length"), "count").rollup("length").agg(F.count("*").alias("uniques"), F.sum("count").alias("reads"))


def length_offsets(uniques: DataFrame) -> DataFrame:
    """(length, uniques, offset): the number of shorter uniques.  One row a length."""
    before = F.sum("uniques").over(W.orderBy("length").rowsBetween(W.unboundedPreceding, -1))
    return length_profile(uniques).select("length", "uniques", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def with_ids(uniques: DataFrame) -> DataFrame:
    """Append seq_id: the place by count, most frequent first, then first appearance."""
    first = ["first_seen"] if "first_seen" in uniques.columns else []
    return dense_ids(uniques, F.desc("count"), *first, "sequence", name="seq_id")


def check_columns(df: DataFrame) -> DataFrame:
    """Exactly (sequence, count), in any order; anything else is an error."""
    if set(df.columns) != {"sequence", "count"}:
        raise ValueError(f"columns sequence and count are expected, not {df.columns}")
    return df.select("sequence", "count")
