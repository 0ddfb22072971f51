"""Scans of read files: FASTQ, FASTA, ranked FASTA, and the tables the pipeline writes.

Text formats number their lines across a whole file.  Spark gives each line its
split and place in it.  A first pass counts the lines of each split; the second
one puts records together inside a split, in the order of its lines.  A record that
a split's end cuts gets its other line from the first pass, which keeps the first
line of each split.  So no line is shuffled.

A path may be a file, a folder or a pattern.  Several files are read one after
the other in the order of their paths, as sequencers write them lane by lane;
a record never goes over the end of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import header_count, is_valid, trimmed
from ..storage import current_files, materialize, ship


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of one or more files; ``at`` rises within a split, which starts at byte ``block``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), trimmed("value").alias("value")
    )


def _splits(lines: DataFrame, per: int) -> DataFrame:
    """(file, block, last, shift, next_line, stop, records, base): a row for each split.

    at + shift is a line's number in its file; next_line follows the split's last
    one; stop is the file's first record with a blank header, records how many it
    has, base how many the files before it count.
    """
    # which lines are headers isn't known before lines are counted, so blank ones are kept by their remainder
    blank = [F.min(F.when((F.col("at") % per == k) & (F.col("value") == ""), F.col("at"))) for k in range(per)]
    s = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("value", "at").alias("line"), F.array(*blank).alias("blank"))
    order = W.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumns({"shift": before - F.col("first"), "next_line": F.lead("line").over(order)})
    headers = F.pmod(-F.col("shift"), F.lit(per)).cast("int")
    s = s.withColumn("empty", F.floor((F.get("blank", headers) + F.col("shift")) / per))
    files = s.groupBy("file").agg(F.min("empty").alias("stop"), F.ceil(F.sum("n") / per).cast("long").alias("records"))
    base = F.coalesce(F.sum(F.coalesce("stop", "records")).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    return materialize(s.join(files.withColumn("base", base), "file").select("file", "block", "last", "shift", "next_line", "stop", "records", "base"), "splits")


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Headers with the line that follows them; a header at a batch's end waits for the next one."""
    held = None

    def joined(rows: pa.RecordBatch, more: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        field = rows["field"].to_numpy()
        at = np.flatnonzero(field == 0)
        waits = more and len(at) and at[-1] == len(field) - 1 and not rows["following"][len(field) - 1].is_valid
        rest, at = (rows.slice(len(field) - 1), at[:-1]) if waits else (None, at)
        follows = np.append(field, 0)[at + 1] == 1
        own = rows["value"].take(pa.array(np.where(follows, at + 1, 0), mask=~follows))
        sequence = pc.coalesce(own, rows["following"].take(pa.array(at)), pa.scalar("", rows.schema.field("value").type))
        return pa.RecordBatch.from_arrays([rows["read_idx"].take(pa.array(at)), rows["value"].take(pa.array(at)), sequence], ["read_idx", "header", "sequence"]), rest

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        done, held = joined(batch, True)
        yield done
    if held is not None:
        yield joined(held, False)[0]


def _records(spark: SparkSession, path: str, per: int, strict: bool) -> DataFrame:
    """(read_idx, header, sequence) of records of ``per`` lines, of each file up to its first blank header."""
    ship(spark)
    lines = _lines(spark, path)
    splits = _splits(lines, per)
    if strict and splits.where("records - 1 > stop").limit(1).count():
        raise ValueError("a blank header inside the file")
    # a row for each split, so a millionth of the input
    d = lines.join(F.broadcast(splits.drop("records")), ["file", "block"])
    line = F.col("at") + F.col("shift")
    d = d.select("at", "last", "next_line", "stop", "base", "value", F.floor(line / per).alias("rec"), (line % per).cast("int").alias("field"))
    d = d.where("field < 2").where("stop is null or rec < stop")
    d = d.select((F.col("rec") + F.col("base")).alias("read_idx"), "field", "value", F.when(F.col("at") == F.col("last"), F.col("next_line")).alias("following"))
    # a record that the file's end cuts off has an empty sequence
    return d.mapInArrow(_paired, "read_idx long, header string, sequence string")


def read_fastq(spark: SparkSession, path: str, *, keep_invalid: bool = False, strict: bool = False) -> DataFrame:
    """(read_idx, header, sequence, valid) of a FASTQ file.

    The scan ends at the first blank header; with ``strict`` text after one is an
    error.  Only A, C, G, T strings are kept unless ``keep_invalid``.
    """
    d = _records(spark, path, 4, strict).withColumn("valid", is_valid("sequence"))
    return d if keep_invalid else d.where("valid")


def read_fasta(spark: SparkSession, path: str, *, keep_invalid: bool = False, strict: bool = False) -> DataFrame:
    """(read_idx, header, sequence, valid) of a FASTA file of two-line records."""
    d = _records(spark, path, 2, strict).withColumn("valid", is_valid("sequence"))
    return d if keep_invalid else d.where("valid")


def read_fastq_named(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_fastq``, with the header's leading @ removed."""
    return read_fastq(spark, path).withColumn("header", F.regexp_replace("header", "^@", ""))


def read_ranked_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rec, sequence, count): of a repeated sequence the first place and the last count."""
    d = _records(spark, path, 2, False).select("read_idx", "sequence", header_count("header").alias("count"))
    return d.groupBy("sequence").agg(F.min("read_idx").alias("rec"), F.max_by("count", "read_idx").alias("count")).select("rec", "sequence", "count")


def unique_header(spark: SparkSession, path: str) -> tuple[int, int]:
    """(uniques, reads) from a unique table's first line."""
    first = spark.read.text(path).where("value like '#%'").limit(1).collect()
    m = re.match(r"# unique_sequences=(\d+), total_reads=(\d+)", first[0].value if first else "")
    if not m:
        raise ValueError(f"no counts in the first line of {path}")
    return int(m[1]), int(m[2])


def read_unique_table(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, count) of a tab-separated unique table; leading # lines are skipped.

    The header must name exactly these two columns, in any order.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.regexp_replace("value", "\r$", "").alias("value"))
    head = lines.where(F.col("value").contains("sequence")).limit(1).collect()
    names = head[0].value.split("\t") if head else []
    if sorted(names) != ["count", "sequence"]:
        raise ValueError(f"columns {names} instead of sequence and count in {path}")
    cell = F.split("value", "\t")
    at = {n: k for k, n in enumerate(names)}
    rows = lines.where(F.col("value") != head[0].value)
    return rows.select(trimmed(cell[at["sequence"]]).alias("sequence"), cell[at["count"]].cast("long").alias("count"))


def read_edges(spark: SparkSession, path: str, *, distance: int | None = None) -> DataFrame:
    """(id_a, id_b) of one edge file or of all in a folder; a malformed row is an error.

    With ``distance`` only the folder's files ``*_d<distance>.csv`` are read; without,
    files of different distances in one folder are an error.
    """
    paths = path
    if not path.endswith(".csv"):
        found = current_files(spark, path)
        if distance is not None:
            found = {n: p for n, p in found.items() if n.endswith(f"_d{distance}.csv")}
        elif len(given := {m[1] for n in found if (m := re.search(r"_d(\d+)\.csv$", n))}) > 1:
            raise ValueError(f"edges of distances {sorted(map(int, given))} in {path}; say which")
        paths = sorted(found.values()) or f"{path}/{'*' if distance is None else f'*_d{distance}'}.csv"
    d = spark.read.csv(paths, sep="\t", header=True, schema="id_a bigint, id_b bigint", mode="FAILFAST", enforceSchema=True)
    return d.where("id_a is not null and id_b is not null")


def discover_lengths(spark: SparkSession, folder: str) -> dict[int, str]:
    """Files length_<n>.csv of a folder by n; any other length_*.csv is an error."""
    out = {}
    for name, path in current_files(spark, folder).items():
        if not name.startswith("length_"):
            continue
        m = re.fullmatch(r"length_(\d+)\.csv", name)
        if not m:
            raise ValueError(f"unexpected file {name}")
        out[int(m[1])] = path
    return dict(sorted(out.items()))


def reads_of(df: DataFrame, sequence: Column | str, order: Column | str) -> DataFrame:
    """(read_idx, sequence) of any table: the way in for data that is no read file."""
    seq = F.col(sequence) if isinstance(sequence, str) else sequence
    idx = F.col(order) if isinstance(order, str) else order
    return df.select(idx.cast("long").alias("read_idx"), seq.alias("sequence"))
