"""Greedy grouping of reads as they come, by Structured Streaming.

The state is two tables that only grow: what each micro-batch adds to the counts
and first places of strings, and the pairs of near strings of which it brings one
at least.  A string that came before is never compared again.  Groups follow from
the state as they do from a whole table, so they are the same however the reads
are cut into micro-batches and in whichever order those come.

A micro-batch writes folders named by its number and, last, a marker that its
readers trust; one that is repeated after a failure replaces what it had written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import greedy
from ..operators.unique import unique_sequences
from ..storage import materialize

UNIQUES, NEAR = "sequence string, count long, first_seen long", "s string, t string"


class OnlineGreedy:
    """Groups of the valid reads (read_idx, sequence) added so far; ``folder`` is shared and may hold the state of an earlier run."""

    def __init__(self, spark: SparkSession, folder: str, r: int = 1):
        greedy._check(r)
        self.spark, self.folder, self.r = spark, folder, r

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _done(self) -> list[int]:
        """Numbers of the micro-batches that were finished."""
        at = self._path("done/*")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return sorted(int(f.getPath().getName()) for f in found)

    def _state(self, table: str, schema: str, but: int | None = None) -> DataFrame:
        paths = [f"{self.folder}/{table}/{k}" for k in self._done() if k != but]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, reads: DataFrame, batch: int) -> None:
        """Take in a micro-batch; one that was finished before is left as it is."""
        if batch in self._done():
            return
        got = materialize(unique_sequences(reads).select("sequence", "count", "first_seen"), "arrived")
        old = self._state("uniques", UNIQUES, batch).select("sequence").distinct()
        new = materialize(got.select("sequence").join(old, "sequence", "left_anti"), "new-strings")
        greedy.new_pairs(new, old, self.r).write.mode("overwrite").parquet(f"{self.folder}/near/{batch}")
        got.write.mode("overwrite").parquet(f"{self.folder}/uniques/{batch}")
        mark = self._path(f"done/{batch}")
        mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(mark, True).close()

    def uniques(self) -> DataFrame:
        """(sequence, count, first_seen) of all reads so far."""
        return self._state("uniques", UNIQUES).groupBy("sequence").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))

    def groups(self) -> DataFrame:
        """As ``greedy_seen`` of all reads so far."""
        u = materialize(self.uniques(), "uniques")
        seen = lambda c: u.select(F.col("sequence").alias(c), F.col("first_seen").alias(f"{c}_seen"))
        near = self._state("near", NEAR).join(seen("s"), "s").join(seen("t"), "t")
        later = F.col("s_seen") > F.col("t_seen")
        either = lambda x, y: F.when(later, F.col(x)).otherwise(F.col(y))
        return greedy.seen_groups(u, near.select(either("s", "t").alias("s"), either("t", "s").alias("t")))

    def run(self, reads: DataFrame, checkpoint: str) -> None:
        """Take in all that a stream of reads has, micro-batch by micro-batch, from where an earlier run ended."""
        q = reads.writeStream.foreachBatch(lambda df, k: self.add(df, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
