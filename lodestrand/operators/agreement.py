"""Agreement of two ranked count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import dense_ids


def ranked(counts: DataFrame, tie: str = "rec") -> DataFrame:
    """(rank, sequence, count) from 1, greatest count first, ties by ``tie``, then by sequence."""
    return dense_ids(counts.select("sequence", "count", tie), F.desc("count"), tie, "sequence", name="rank", start=1).select("rank", "sequence", "count")


def _running(df: DataFrame, value: str, out: str) -> DataFrame:
    """Running sum in rank order: within blocks of ranks, plus the sums of the blocks before."""
    block = F.floor((F.col("rank") - 1) / 100_000)
    d = df.withColumn("_block", block)
    sums = d.groupBy("_block").agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sums.select("_block", before.alias("_before")), "_block")
    within = F.sum(value).over(W.partitionBy("_block").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn(out, within + F.col("_before")).drop("_block", "_before")


def count_cdf(rank: DataFrame) -> DataFrame:
    """(rank, cdf): share of all counts in the first ranks."""
    total = rank.agg(F.sum("count").alias("total"))
    return _running(rank, "count", "run").crossJoin(F.broadcast(total)).select("rank", (F.col("run") / F.col("total")).alias("cdf"))  # total is one row


def topn_overlap(rank_a: DataFrame, rank_b: DataFrame) -> DataFrame:
    """(rank, fraction_shared): share of the first ranks of both tables that they have in common.

    A shared sequence arrives at the later of its two ranks; arrivals are summed
    up, so no prefix is ever gathered.  Ranks end with the shorter table.
    """
    both = rank_a.select("sequence", F.col("rank").alias("ra")).join(rank_b.select("sequence", F.col("rank").alias("rb")), "sequence")
    arrivals = both.groupBy(F.greatest("ra", "rb").alias("rank")).agg(F.count("*").alias("come"))
    ranks = rank_a.select("rank").join(rank_b.select("rank"), "rank")
    d = ranks.join(arrivals, "rank", "left").select("rank", F.coalesce("come", F.lit(0)).alias("come"))
    return _running(d, "come", "run").select("rank", (F.col("run") / F.col("rank")).alias("fraction_shared"))


def compute_metrics(counts_a: DataFrame, counts_b: DataFrame, tie: str = "rec") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, cdf_a, cdf_b) of two count tables."""
    a, b = ranked(counts_a, tie), ranked(counts_b, tie)
    return topn_overlap(a, b), count_cdf(a), count_cdf(b)
