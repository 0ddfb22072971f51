"""Command line: unique, split, pairs, all-pairs, cluster, greedy, agree.

Each command reads and writes files, so commands can be run one by one.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import agreement, clusters, components, greedy, simjoin, unique
from .sources import reads as scan
from .sources import sinks
from .storage import clear, publish, scratch


def _say(text: str, since: float) -> None:
    print(f"{text} in {time.time() - since:.2g} s")


def run_unique(spark: SparkSession, a: argparse.Namespace) -> None:
    t = time.time()
    r = scan.read_fastq(spark, a.fastq, keep_invalid=True, strict=a.strict)
    u = unique.unique_sequences(r, min_length=a.min_length).cache()
    s = unique.read_stats(r).first()
    sinks.write_unique_table(u, a.output, single=not a.parts)
    _say(f"{s.uniques:,} unique of {s.total:,} reads, {s.skipped:,} skipped", t)


def run_split(spark: SparkSession, a: argparse.Namespace) -> None:
    t = time.time()
    u = scan.read_unique_table(spark, a.input)
    for r in unique.length_profile(u).orderBy("length").collect():
        print(f"length {r.length}: {r.uniques:,} unique, {r.reads:,} reads")
    sinks.write_length_tables(u, a.output_dir, single=not a.parts)
    _say("split", t)


def _by_length(spark: SparkSession, folder: str, lengths: list[int] | None = None):
    found = scan.discover_lengths(spark, folder)
    for n in lengths or []:
        if n not in found:
            raise FileNotFoundError(f"{folder}/length_{n}.csv")
    out = None
    for n in lengths or found:
        one = scan.read_unique_table(spark, found[n])
        out = one if out is None else out.unionByName(one)
    return out


def _pairs(spark: SparkSession, a: argparse.Namespace, lengths: tuple[int, int] | None) -> None:
    t = time.time()
    if lengths is None and not scan.discover_lengths(spark, a.length_dir):
        print("no length pairs")
        return
    u = unique.with_ids(_by_length(spark, a.length_dir))  # ids are those of the whole table
    e = simjoin.similar_edges(u, a.distance, mode=a.mode, lengths=lengths, with_lengths=True).cache()
    if a.parts:
        sinks.write_edge_files(e, a.output_dir, a.distance, lengths=lengths, versioned=True)
    elif lengths:
        name, tmp = f"pairs_len{lengths[0]}_len{lengths[1]}_d{a.distance}.csv", scratch(spark, "pairs")
        sinks.write_edge_table(e, tmp)
        publish(spark, a.output_dir, {name: tmp}, lambda n: n == name, versioned=False)
    else:
        sinks.write_edge_files(e, a.output_dir, a.distance)
    _say(f"{e.count():,} pairs", t)


def run_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    lengths = tuple(sorted((a.length_a, a.length_b)))
    _by_length(spark, a.length_dir, sorted(set(lengths)))
    _pairs(spark, a, lengths)


def run_all_pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    _pairs(spark, a, None)


def run_cluster(spark: SparkSession, a: argparse.Namespace) -> None:
    t = time.time()
    u = unique.with_ids(scan.read_unique_table(spark, a.unique)).cache()
    e = scan.read_edges(spark, a.edges_dir, distance=a.distance)
    labelled = u.join(components.connected_components(u.select(F.col("seq_id").alias("id")), e).withColumnRenamed("id", "seq_id"), "seq_id")
    c = clusters.summarise(labelled).cache()
    sinks.write_clusters(c, a.output, single=not a.parts)
    if a.fasta:
        sinks.write_fasta(c.select("sequence", F.col("total_count").alias("count"), "rep_id"), a.fasta, F.desc("count"), "rep_id", single=not a.parts)
    s = clusters.run_stats(u, e, c).first()
    _say(f"{s.clusters:,} clusters of {s.uniques:,} unique sequences by {s.pairs:,} pairs", t)


def run_greedy(spark: SparkSession, a: argparse.Namespace) -> None:
    t = time.time()
    u = greedy.named_uniques(scan.read_fastq_named(spark, a.input)).cache()
    r = 2 if a.include_next_nearest else 1
    grouped = greedy.greedy_ball(u, r) if a.kind == "ball" else greedy.greedy_seen(u, r)
    c = greedy.summarise_greedy(grouped).cache()
    sinks.write_greedy_fasta(c, a.output, members=a.members, single=not a.parts)
    _say(f"{c.count():,} clusters", t)


def run_agree(spark: SparkSession, a: argparse.Namespace) -> None:
    old, new = scan.read_ranked_fasta(spark, a.old), scan.read_ranked_fasta(spark, a.new)
    shared, cdf_old, cdf_new = agreement.compute_metrics(old, new)
    for r in sinks.report_lines(shared).orderBy("rank").collect():
        print(r.line)
    if a.data:
        sinks.plot_data(shared, cdf_old, cdf_new).write.mode("overwrite").parquet(a.data)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestrand", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, func, *flags):
        c = sub.add_parser(name)
        for names, kw in flags:
            c.add_argument(*names, **kw)
        c.set_defaults(func=func)

    must = {"required": True}
    whole = {"required": True, "type": int}
    parts = (("--parts",), {"action": "store_true", "help": "write folders of part files instead of single ones"})
    mode = (("--mode",), {"choices": ("complete", "reference"), "default": "complete"})
    command("unique", run_unique, (("--fastq", "--input", "-i"), must), (("--output", "-o"), must), (("--strict",), {"action": "store_true"}), (("--min-length",), {"type": int, "default": 0}), parts)
    command("split", run_split, (("--input", "-i"), must), (("--output-dir", "-o"), must), parts)
    command("pairs", run_pairs, (("--length-dir",), must), (("--length-a",), whole), (("--length-b",), whole), (("--distance", "--max-edits", "-d"), whole), (("--output-dir", "-o"), must), mode, parts)
    command("all-pairs", run_all_pairs, (("--length-dir",), must), (("--distance", "--max-edits", "-d"), whole), (("--output-dir", "-o"), must), (("--workers", "-w"), {"type": int, "default": 1, "help": "kept for scripts; Spark decides"}), mode, parts)
    command("cluster", run_cluster, (("--unique",), must), (("--edges-dir",), must), (("--distance", "--max-edits", "-d"), {"type": int}), (("--output", "-o"), must), (("--fasta",), {}), parts)
    command("greedy", run_greedy, (("--input", "-i"), {"default": "merged_lenfilt.fq"}), (("--output", "-o"), must), (("--kind",), {"choices": ("ball", "seen"), "default": "seen"}), (("--include_next_nearest",), {"action": "store_true"}), (("--members",), {"action": "store_true"}), parts)
    command("agree", run_agree, (("old",), {}), (("new",), {}), (("--data",), {}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is not None:
        a.func(spark, a)
        return
    spark = SparkSession.builder.appName("lodestrand").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.func(spark, a)
    finally:
        clear(spark)
        spark.stop()
