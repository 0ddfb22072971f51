"""Writers of the formats that ``reads`` scans, and of reports.

Large results go to Parquet, partitioned where it helps, or to folders of text
whose numbered part files follow the order, written by all tasks.  For people
and other tools the same text can be a single file, which one task writes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dense_ids, publish, scratch


def text_parts(lines: DataFrame, path: str, *order) -> None:
    """Write column ``value`` as a folder of part files whose numbers follow the given order."""
    (lines.orderBy(*order) if order else lines).select("value").write.text(path)


def _write(lines: DataFrame, path: str, single: bool, *order) -> None:
    (single_text if single else text_parts)(lines, path, *order)


def single_text(lines: DataFrame, path: str, *order) -> None:
    """Write column ``value`` as one file at ``path``, in the given order."""
    spark = lines.sparkSession
    tmp = scratch(spark, "text")
    ordered = lines.orderBy(*order) if order else lines
    ordered.select("value").coalesce(1).write.text(tmp)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    parts = jvm.org.apache.hadoop.fs.Path(f"{tmp}/part-*")
    source_fs = parts.getFileSystem(conf)
    found = source_fs.globStatus(parts)
    if len(found):
        jvm.org.apache.hadoop.fs.FileUtil.copy(source_fs, found[0].getPath(), fs, target, True, True, conf)
    else:
        fs.create(target, True).close()
    source_fs.delete(jvm.org.apache.hadoop.fs.Path(tmp), True)


def write_unique_table(uniques: DataFrame, path: str, *, single: bool = True) -> None:
    """Tab-separated (sequence, count), most frequent first, under a line of totals."""
    first = [F.desc("count"), *(["first_seen"] if "first_seen" in uniques.columns else []), "sequence"]
    totals = uniques.agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("m"))
    top = totals.select(F.array(F.format_string("# unique_sequences=%d, total_reads=%d", "n", "m"), F.lit("sequence\tcount\r")).alias("v"))
    rows = dense_ids(uniques, *first, name="at", start=2).select("at", F.concat_ws("\t", "sequence", F.concat(F.col("count").cast("string"), F.lit("\r"))).alias("value"))
    _write(top.select(F.posexplode("v").alias("at", "value")).unionByName(rows), path, single, "at")


def write_by_length(uniques: DataFrame, path: str) -> DataFrame:
    """Parquet partitioned by length; returns the lengths' counts."""
    d = uniques.withColumn("length", F.length("sequence"))
    d.repartition("length").write.mode("overwrite").partitionBy("length").parquet(path)
    return d.groupBy("length").agg(F.count("*").alias("uniques"), F.sum("count").alias("reads"))


def write_length_tables(uniques: DataFrame, folder: str, *, single: bool = True) -> list[int]:
    """One text table length_<n>.csv a length, for tools that expect them: a file each, or with ``single=False`` a folder of parts.

    All lengths are written by one job, which reads the table once, and replace all
    there were.  Files are then renamed one by one; folders of parts are versioned, so
    ``discover_lengths`` finds all new ones or all old ones (``storage.publish``).
    """
    spark = uniques.sparkSession
    tmp = scratch(spark, "lengths")
    first = "first_seen" if "first_seen" in uniques.columns else "sequence"
    u = uniques.where("sequence is not null").select("sequence", "count", F.length("sequence").alias("length"), F.col(first).alias("first"))
    totals = u.groupBy("length").agg(F.count("*").alias("n"), F.sum("count").alias("m"))
    top = F.posexplode(F.array(F.format_string("# unique_sequences=%d, total_reads=%d", "n", "m"), F.lit("sequence\tcount\r"))).alias("k", "value")
    none = F.lit(None)
    heads = totals.select("length", none.cast("long").alias("count"), none.cast(u.schema["first"].dataType).alias("first"), none.cast("string").alias("sequence"), top)
    line = F.concat_ws("\t", "sequence", F.concat(F.col("count").cast("string"), F.lit("\r"))).alias("value")
    rows = heads.unionByName(u.select("length", "count", "first", "sequence", F.lit(2).alias("k"), line))
    order = ["length", "k", F.desc("count"), "first", "sequence"]
    dealt = rows.repartition("length") if single else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).select("value", "length").write.partitionBy("length").text(tmp)
    found = _written(spark, tmp, "length", lambda n: f"length_{n}.csv", single)
    publish(spark, folder, found, lambda n: re.fullmatch(r"length_\d+\.csv", n) is not None, versioned=not single)
    return sorted(int(n[len("length_") : -len(".csv")]) for n in found)


def _written(spark: SparkSession, tmp: str, column: str, name, single: bool) -> dict[str, str]:
    """The folders of a partitioned write, or the only file of each, by the names they shall have."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    found = hadoop.Path(tmp).getFileSystem(conf).globStatus(hadoop.Path(f"{tmp}/{column}=*/part-*" if single else f"{tmp}/{column}=*")) or []
    paths = [s.getPath() for s in found]
    return {name((p.getParent() if single else p).getName().removeprefix(f"{column}=")): p.toString() for p in paths}


def write_edges(edges: DataFrame, path: str, *, distance: int | None = None) -> None:
    """Parquet edges, by distance, so runs of unequal distance never mix."""
    e = edges.select("id_a", "id_b")
    (e.withColumn("distance", F.lit(distance)).write.mode("overwrite").partitionBy("distance") if distance is not None else e.write.mode("overwrite")).parquet(path)


def write_edge_table(edges: DataFrame, path: str, *, single: bool = True) -> None:
    """Tab-separated (index_a, index_b)."""
    e = edges.select(F.lit(1).alias("k"), "id_a", "id_b", F.concat_ws("\t", "id_a", F.concat(F.col("id_b").cast("string"), F.lit("\r"))).alias("value"))
    head = edges.sparkSession.createDataFrame([(0, 0, 0, "index_a\tindex_b\r")], "k int, id_a long, id_b long, value string")
    _write(head.unionByName(e), path, single, "k", "id_a", "id_b")


def write_edge_files(edges: DataFrame, folder: str, d: int, *, lengths: tuple[int, int] | None = None, versioned: bool = False) -> None:
    """Tab-separated edges (id_a, id_b, length_a, length_b), a folder of parts pairs_len<a>_len<b>_d<d>.csv for each pair of lengths.

    All pairs are written by one job, and replace those of distance ``d``, or of these ``lengths`` only.
    ``versioned``: ``read_edges`` finds all new ones or all old ones (``storage.publish``).
    """
    spark = edges.sparkSession
    tmp = scratch(spark, "edges")
    name = F.format_string("pairs_len%d_len%d_d%d.csv", F.least("length_a", "length_b"), F.greatest("length_a", "length_b"), F.lit(d))
    edges.select(F.col("id_a").alias("index_a"), F.col("id_b").alias("index_b"), name.alias("name")).write.partitionBy("name").option("header", True).option("sep", "\t").csv(tmp)
    own = rf"pairs_len\d+_len\d+_d{d}\.csv" if lengths is None else rf"pairs_len{min(lengths)}_len{max(lengths)}_d{d}\.csv"
    publish(spark, folder, _written(spark, tmp, "name", str, False), lambda n: re.fullmatch(own, n) is not None, versioned=versioned)


def write_clusters(clusters: DataFrame, path: str, *, single: bool = True) -> None:
    """Tab-separated (sequence, cluster_size, total_count), largest total first."""
    c = clusters.select(F.lit(1).alias("k"), "total_count", "rep_id", F.concat_ws("\t", "sequence", "cluster_size", F.concat(F.col("total_count").cast("string"), F.lit("\r"))).alias("value"))
    head = clusters.sparkSession.createDataFrame([(0, 0, 0, "sequence\tcluster_size\ttotal_count\r")], "k int, total_count long, rep_id long, value string")
    _write(head.unionByName(c), path, single, "k", F.desc("total_count"), "rep_id")


def write_fasta(rows: DataFrame, path: str, *order, single: bool = True) -> None:
    """Numbered records ``>i N:count len:length``."""
    d = dense_ids(rows, *order, name="i", start=1)
    _write(d.select("i", F.concat(F.format_string(">%d N:%d len:%d\n", "i", "count", F.length("sequence")), F.col("sequence")).alias("value")), path, single, "i")


def write_greedy_fasta(clusters: DataFrame, path: str, *, members: bool = False, single: bool = True) -> None:
    """Records of representatives by total: ``>header [Nmembers:k ]N:total``."""
    mid = F.concat(F.lit(" Nmembers:"), F.col("cluster_size").cast("string")) if members else F.lit("")
    value = F.concat(F.lit(">"), "header", mid, F.lit(" N:"), F.col("total_count").cast("string"), F.lit("\n"), F.col("sequence"))
    _write(clusters.select("total_count", "root_first_seen", value.alias("value")), path, single, F.desc("total_count"), "root_first_seen")


def report_lines(shared: DataFrame) -> DataFrame:
    """(rank, line) at ranks 1, 10, 100, ... below the last rank."""
    last = shared.agg(F.max("rank").alias("last"))
    steps = [10**k for k in range(16)]
    d = shared.where(F.col("rank").isin(steps)).crossJoin(F.broadcast(last)).where("rank < last")  # last is one row
    text = F.format_string("Top %s: %s%% shared", F.lpad(F.format_number("rank", 0), 7, " "), F.format_string("%4.2f", F.col("fraction_shared") * 100))
    return d.select("rank", text.alias("line"))


def plot_data(shared: DataFrame, cdf_old: DataFrame, cdf_new: DataFrame) -> DataFrame:
    """(series, rank, value): what the two panels of the agreement plot show."""
    return (
        shared.select(F.lit("shared").alias("series"), "rank", F.col("fraction_shared").alias("value"))
        .unionByName(cdf_old.select(F.lit("cdf_old").alias("series"), "rank", F.col("cdf").alias("value")))
        .unionByName(cdf_new.select(F.lit("cdf_new").alias("series"), "rank", F.col("cdf").alias("value")))
    )
