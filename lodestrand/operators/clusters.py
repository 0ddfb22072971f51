"""Clusters: components of similar reads with their counts and representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simjoin import similar_edges
from .unique import with_ids


def label(uniques: DataFrame, edges: DataFrame) -> DataFrame:
    """Append the component to uniques (seq_id, sequence, count)."""
    parts = connected_components(uniques.select(F.col("seq_id").alias("id")), edges)
    return uniques.join(parts.withColumnRenamed("id", "seq_id"), "seq_id")


def summarise(labelled: DataFrame) -> DataFrame:
    """(rep_id, sequence, cluster_size, total_count) of each component.

    The representative has the greatest count, of equal ones the smallest id.
    """
    rank = F.struct("count", -F.col("seq_id"))
    g = labelled.groupBy("component").agg(
        F.max_by(F.struct("seq_id", "sequence"), rank).alias("r"), F.count("*").alias("cluster_size"), F.sum("count").alias("total_count")
    )
    return g.select(F.col("r.seq_id").alias("rep_id"), F.col("r.sequence").alias("sequence"), "cluster_size", "total_count")


def cluster(uniques: DataFrame, d: int, *, mode: str = "complete") -> DataFrame:
    """Clusters of uniques (sequence, count[, first_seen]) linked within ``d`` edits."""
    u = uniques if "seq_id" in uniques.columns else with_ids(uniques)
    edges = similar_edges(u, d, mode=mode)
    return summarise(label(u, edges))


def ordered(clusters: DataFrame) -> DataFrame:
    """Largest total first, then smallest representative."""
    return clusters.orderBy(F.desc("total_count"), "rep_id")


def run_stats(uniques: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (uniques, reads, pairs, clusters)."""
    u = uniques.agg(F.count("*").alias("uniques"), F.coalesce(F.sum("count"), F.lit(0)).alias("reads"))
    return u.crossJoin(edges.agg(F.count("*").alias("pairs"))).crossJoin(clusters.agg(F.count("*").alias("clusters")))  # one row each
