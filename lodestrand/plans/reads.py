"""The reads that the registered queries work on, derived from the order lines.

One text serves Spark and the oracle, but for how they count to 300.  Reads of
one ``read_idx`` are equal, so the order of first appearance is total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import spread

READS_SQL = """
SELECT read_idx,
  CASE WHEN l_orderkey % 7  = 0 THEN concat('A', substr(s0, 2))
       WHEN l_orderkey % 11 = 0 THEN concat(substr(s0, 1, 11), 'T', substr(s0, 13))
       WHEN l_orderkey % 13 = 0 THEN reverse(translate(s0, 'ACGT', 'TGCA'))
       WHEN l_orderkey % 17 = 0 THEN concat(substr(s0, 1, 5), 'N', substr(s0, 7))
       WHEN l_orderkey % 19 = 0 THEN concat(substr(s0, 2), 'G')
       ELSE s0 END AS sequence
FROM (SELECT l_orderkey, (l_orderkey * 8 + l_linenumber) * 300 + l_partkey % 300 AS read_idx,
        substr(base, 1, 24 - cast(l_linenumber % 2 AS int)) AS s0
      FROM {lineitem} JOIN (SELECT k, translate(md5(cast(k AS string)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS base FROM ({keys}) ks) b
        ON l_partkey % 300 = k) z
"""


#: The 300 keys of the base strings, for Spark and for the oracle.
SPARK_KEYS, ORACLE_KEYS = "SELECT explode(sequence(0L, 299L)) AS k", "SELECT unnest(range(300)) AS k"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_idx, sequence)."""
    return reads_from(spark, spread(lineitem(spark, sf_dir)))


def reads_from(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The reads of order lines, a stream too."""
    return spark.sql(READS_SQL.format(lineitem="{t}", keys=SPARK_KEYS), t=lines)
