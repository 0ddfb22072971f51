"""Registered queries over the reads, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as fn
from ..operators import agreement, clusters, components, greedy, seedindex, simjoin, unique
from ..sources import reads as scan
from ..sources import sinks
from ..storage import dense_ids, materialize, scratch
from ..streaming import unique as stream
from ..streaming.greedy import OnlineGreedy
from .reads import ORACLE_KEYS, READS_SQL, reads, reads_from

READS = READS_SQL.format(lineitem="lineitem", keys=ORACLE_KEYS)
UNIQUES = f"""r AS ({READS}),
u AS (SELECT sequence, count(*) AS n, min(read_idx) AS first_seen, CAST(length(sequence) AS INT) AS len
      FROM r WHERE length(translate(sequence, 'ACGT', '')) = 0 GROUP BY sequence),
o AS (SELECT *, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc, CAST(row_number() OVER (ORDER BY n DESC, first_seen, sequence) - 1 AS BIGINT) AS id FROM u)"""


def uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique.unique_sequences(reads(spark, sf_dir))


def _brute(d: int, where: str = "", rc: bool = True) -> str:
    """All pairs within d edits; lengths are compared first so the oracle ends soon."""
    dist = "least(levenshtein(a.sequence, b.sequence), levenshtein(a.sequence, b.rc))" if rc else "levenshtein(a.sequence, b.sequence)"
    return f"""p AS (SELECT a.sequence AS a, b.sequence AS b, a.id AS x, b.id AS y, CAST({dist} AS INT) AS distance
      FROM o a JOIN o b ON (a.len < b.len OR (a.len = b.len AND a.sequence < b.sequence)) AND b.len - a.len <= {d} {where}
      WHERE {dist} <= {d})"""


def _parts(d: int) -> str:
    k = d + 1
    return f"""parts AS (SELECT z.n, CAST(i.i AS INT) AS part, CAST(i.i * (z.n // {k}) + least(i.i, z.n % {k}) AS INT) AS st,
      CAST(z.n // {k} + CASE WHEN i.i < z.n % {k} THEN 1 ELSE 0 END AS INT) AS sz
      FROM (SELECT DISTINCT len - CAST(x.x AS INT) AS n FROM o, range(0, {k}) x(x) WHERE len >= x.x) z, range(0, {k}) i(i))"""


def _seeded(d: int) -> str:
    """The classic seeding: complemented seeds at the same offsets, shifts up to the difference."""
    return f"""{_parts(d)},
sa AS (SELECT o.sequence, len AS n, part, unnest([substr(sequence, st + 1, sz), reverse(translate(substr(sequence, st + 1, sz), 'ACGT', 'TGCA'))]) AS seed
       FROM o JOIN parts ON parts.n = o.len),
sb AS (SELECT o.sequence, parts.n, part, unnest([substr(sequence, st + CAST(sh.sh AS INT) + 1, sz), reverse(translate(substr(sequence, st + CAST(sh.sh AS INT) + 1, sz), 'ACGT', 'TGCA'))]) AS seed
       FROM o JOIN parts ON parts.n BETWEEN o.len - {d} AND o.len JOIN range(0, {d + 1}) sh(sh) ON sh.sh <= o.len - parts.n),
c AS (SELECT DISTINCT sa.sequence AS a, sb.sequence AS b FROM sa JOIN sb USING (n, part, seed)
      WHERE length(sa.sequence) < length(sb.sequence) OR (length(sa.sequence) = length(sb.sequence) AND sa.sequence < sb.sequence)),
p AS (SELECT a, b, x.id AS x, y.id AS y, CAST(least(levenshtein(a, b), levenshtein(a, y.rc)) AS INT) AS distance
      FROM c JOIN o x ON x.sequence = a JOIN o y ON y.sequence = b WHERE least(levenshtein(a, b), levenshtein(a, y.rc)) <= {d})"""


COMPONENTS = """e AS (SELECT x AS s, y AS t FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT id AS s, id AS t FROM o UNION SELECT reach.s, e.t FROM reach JOIN e ON e.s = reach.t),
comp AS (SELECT s AS id, min(t) AS component FROM reach GROUP BY s)"""
#: The same after the edges whose smaller id leaves a remainder by 3 of 0, of 1 at most, of 2 at most.
_REACHES = ",\n".join(f"""e{k} AS (SELECT x AS s, y AS t FROM p WHERE least(x, y) % 3 <= {k} UNION ALL SELECT y, x FROM p WHERE least(x, y) % 3 <= {k}),
reach{k} AS (SELECT id AS s, id AS t FROM o UNION SELECT reach{k}.s, e{k}.t FROM reach{k} JOIN e{k} ON e{k}.s = reach{k}.t),
c{k} AS (SELECT s AS id, min(t) AS component FROM reach{k} GROUP BY s)""" for k in range(3))
CLUSTERS = f"""{COMPONENTS},
ranked AS (SELECT o.*, component, row_number() OVER (PARTITION BY component ORDER BY n DESC, o.id) AS place FROM o JOIN comp USING (id))
SELECT max(CASE WHEN place = 1 THEN sequence END) AS sequence, count(*) AS cluster_size, CAST(sum(n) AS BIGINT) AS total_count
FROM ranked GROUP BY component"""


# -- deduplication ---------------------------------------------------------


def unique_reads(spark, sf_dir):
    return uniques(spark, sf_dir)


def unique_table(spark, sf_dir):
    """The uniques written as a text table and scanned again."""
    out = f"{scratch(spark, 'table')}/unique.csv"
    sinks.write_unique_table(uniques(spark, sf_dir), out, single=False)
    n, m = scan.unique_header(spark, out)
    return scan.read_unique_table(spark, out).withColumn("uniques", F.lit(n).cast("long")).withColumn("reads", F.lit(m).cast("long"))


def read_stats(spark, sf_dir):
    return unique.read_stats(reads(spark, sf_dir))


def length_profile(spark, sf_dir):
    return unique.length_profile(uniques(spark, sf_dir))


def length_totals(spark, sf_dir):
    """The row of totals has length -1."""
    return unique.length_totals(uniques(spark, sf_dir)).withColumn("length", F.coalesce("length", F.lit(-1)))


def length_partitions(spark, sf_dir):
    """The uniques written by length and found again by partition discovery."""
    out = scratch(spark, "by-length")
    sinks.write_by_length(uniques(spark, sf_dir), out)
    return spark.read.parquet(out).select("sequence", "count", F.col("length").cast("int").alias("length"))


def length_offsets(spark, sf_dir):
    return unique.length_offsets(uniques(spark, sf_dir))


def seq_ids(spark, sf_dir):
    return unique.with_ids(uniques(spark, sf_dir)).select("seq_id", "sequence", "count")


def invalid_reads(spark, sf_dir):
    return reads(spark, sf_dir).where(~fn.is_valid("sequence"))


def doc_dedup(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy("text").agg(F.count("*").alias("count"), F.min("doc_id").alias("first_doc"))


def stream_uniques(spark, sf_dir):
    """Unique counts by Structured Streaming over the same reads."""
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    return stream.run_available(stream.unique_counts(reads_from(spark, lines)))


# -- files -----------------------------------------------------------------


def fastq_scan(spark, sf_dir):
    """The reads written as FASTQ and scanned again, with ordinals and headers."""
    out = f"{scratch(spark, 'fastq')}/reads.fq"
    r = reads(spark, sf_dir)
    record = F.concat(F.lit("@read"), F.col("read_idx").cast("string"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("sequence")))
    sinks.text_parts(r.select("read_idx", "sequence", record.alias("value")), out, "read_idx", "sequence")
    return scan.read_fastq_named(spark, out).select("read_idx", "header", "sequence")


def fasta_scan(spark, sf_dir):
    """The uniques written as FASTA and scanned again as a ranking."""
    out = f"{scratch(spark, 'fasta')}/unique.fasta"
    sinks.write_fasta(uniques(spark, sf_dir), out, F.desc("count"), "first_seen", "sequence", single=False)
    return scan.read_ranked_fasta(spark, out).withColumnRenamed("rec", "place")


def edge_table(spark, sf_dir):
    """Edges within one edit written as a text table and scanned again."""
    out = f"{scratch(spark, 'edges')}/pairs_d1.csv"
    u = unique.with_ids(uniques(spark, sf_dir))
    sinks.write_edge_table(simjoin.similar_edges(u, 1), out, single=False)
    return scan.read_edges(spark, out)


def edge_folder(spark, sf_dir):
    """Edges of two distances written as tables by pairs of lengths to one folder, and those of one distance scanned again."""
    out = scratch(spark, "edge-folder")
    u = unique.with_ids(uniques(spark, sf_dir))
    for d in (1, 2):
        sinks.write_edge_files(simjoin.similar_edges(u, d, with_lengths=True), out, d, versioned=True)
    return scan.read_edges(spark, out, distance=1)


def length_tables(spark, sf_dir):
    """The uniques written as one table a length, and found again by the names of the files."""
    out = scratch(spark, "lengths")
    sinks.write_length_tables(uniques(spark, sf_dir), out, single=False)
    found = [scan.read_unique_table(spark, path).withColumn("length", F.lit(n)) for n, path in scan.discover_lengths(spark, out).items()]
    return reduce(DataFrame.unionByName, found)


def cluster_table(spark, sf_dir):
    """Clusters within one edit written as a text table and scanned again."""
    out = f"{scratch(spark, 'clusters')}/clusters.csv"
    sinks.write_clusters(clusters.cluster(uniques(spark, sf_dir), 1), out, single=False)
    rows = spark.read.csv(out, sep="\t", schema="sequence string, cluster_size string, total_count string").where("sequence <> 'sequence'")
    return rows.select("sequence", F.col("cluster_size").cast("long").alias("cluster_size"), F.col("total_count").cast("long").alias("total_count"))


def _greedy_fasta(members: bool):
    def run(spark, sf_dir):
        """Greedy groups written as FASTA and scanned again as a ranking by total."""
        out = f"{scratch(spark, 'greedy')}/greedy.fasta"
        named = reads(spark, sf_dir).where(fn.is_valid("sequence")).withColumn("header", F.concat(F.lit("read"), F.col("read_idx").cast("string")))
        groups = greedy.summarise_greedy(greedy.greedy_seen(greedy.named_uniques(named)))
        sinks.write_greedy_fasta(groups, out, members=members, single=False)
        return scan.read_ranked_fasta(spark, out).withColumnRenamed("rec", "place")

    return run


def header_counts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    h = o.select("o_orderkey", F.concat(F.lit("run 1:N:0:ACGT Nmembers:"), (F.col("o_custkey") % 7).cast("string"), F.lit(" N:"), (F.col("o_orderkey") % 1000).cast("string")).alias("header"))
    return h.select("o_orderkey", "header", fn.header_count("header").alias("count"))


# -- functions -------------------------------------------------------------


def revcomp(spark, sf_dir):
    return uniques(spark, sf_dir).select("sequence", fn.revcomp("sequence").alias("rc"))


def seed_parts(spark, sf_dir):
    """Parts of the lengths that the uniques have, for one to five parts."""
    lengths = uniques(spark, sf_dir).select(F.col("length").alias("n")).distinct()
    each = lengths.select("n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("k"))
    by = reduce(lambda out, k: F.when(F.col("k") == k, fn.parts(F.col("n"), k)).otherwise(out), range(1, 5), fn.parts(F.col("n"), 5))
    return each.select("n", "k", F.explode(by).alias("p")).select("n", "k", "p.part", "p.st", "p.sz")


def sql_functions(spark, sf_dir):
    """The registered SQL functions, used from SQL text."""
    fn.register(spark)
    return spark.sql(
        "SELECT sequence, revcomp(sequence) AS rc, is_valid_read(sequence) AS valid, size(read_parts(length(sequence), 3)) AS parts FROM {r}",
        r=reads(spark, sf_dir).select("sequence").distinct(),
    )


def hamming_neighbors(spark, sf_dir):
    n = uniques(spark, sf_dir).select("sequence", F.explode(fn.hamming_neighbors(F.col("sequence"))).alias("x"))
    return n.select("sequence", "x.ordinal", "x.neighbor")


def seed_index(spark, sf_dir):
    return simjoin.seed_index(uniques(spark, sf_dir), 2)


# -- similarity joins --------------------------------------------------------


def _pairs(d: int, **how):
    def run(spark, sf_dir):
        return simjoin.similar_pairs(uniques(spark, sf_dir), d, **how)

    return run


def length_pairs(spark, sf_dir):
    return simjoin.length_pairs(unique.length_profile(uniques(spark, sf_dir)), 1)


def edges_d1(spark, sf_dir):
    u = unique.with_ids(uniques(spark, sf_dir))
    return simjoin.similar_edges(u, 1)


def indexed_edges(spark, sf_dir):
    """Edges that a stored seed index finds: nine tenths of the uniques are stored first, then a tenth is added."""
    u = unique.with_ids(uniques(spark, sf_dir))
    return seedindex.edges_in_batches(u, 2, (F.col("seq_id") % 10 == 9).cast("int"), 2)


def raw_edges_d1(spark, sf_dir):
    return simjoin.raw_edges(unique.with_ids(uniques(spark, sf_dir)), 1)


def part_name_pairs(spark, sf_dir):
    """Similar names: the same join over any strings, on one strand."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("sequence")).distinct()
    return simjoin.similar_pairs(names, 3, strands=False)


# -- components and clusters -------------------------------------------------


def components_d1(spark, sf_dir):
    u = unique.with_ids(uniques(spark, sf_dir))
    edges = simjoin.similar_edges(u, 1)
    return components.connected_components(u.select(F.col("seq_id").alias("id")), edges)


def disjoint_sets(spark, sf_dir):
    """The same components by a batch of unions over numbers."""
    u = unique.with_ids(uniques(spark, sf_dir))
    sets = components.DisjointSets(spark, u.count())
    sets.update(simjoin.similar_edges(u, 1))
    return sets.components()


def _batches(spark, sf_dir):
    """Disjoint sets after the edges of ids that leave the remainders 0, 1 and 2 by 3, one batch after another; with what each merged."""
    u = unique.with_ids(uniques(spark, sf_dir))
    edges = materialize(simjoin.similar_edges(u, 1), "edges")
    sets = components.DisjointSets(spark, u.count())
    for k in range(3):
        yield k, sets.update(edges.where(F.col("id_a") % 3 == k).select("id_a", "id_b")), sets


def disjoint_sets_batches(spark, sf_dir):
    """The set of each number after each of three batches."""
    out = None
    for k, _, sets in _batches(spark, sf_dir):
        now = sets.components().withColumnRenamed("component", f"after_{k}")
        out = now if out is None else out.join(now, "id")
    return out


def disjoint_sets_merges(spark, sf_dir):
    """Of each batch how many edges it had, how many joined two sets, and the set of number 7 then."""
    out = None
    for k, flags, sets in _batches(spark, sf_dir):
        one = flags.agg(F.count("*").alias("edges"), F.count_if("merged").alias("merged")).select(F.lit(k).alias("batch"), "edges", "merged", F.lit(sets.find(7)).cast("long").alias("set_of_7"))
        out = one if out is None else out.unionByName(one)
    return out


def ranked_clusters(spark, sf_dir):
    """Clusters with their place in the order of results."""
    c = clusters.cluster(uniques(spark, sf_dir), 1)
    return dense_ids(c, F.desc("total_count"), "rep_id", name="place").select("place", "sequence", "cluster_size", "total_count")


def _clusters(d: int, mode: str = "complete"):
    def run(spark, sf_dir):
        return clusters.cluster(uniques(spark, sf_dir), d, mode=mode).select("sequence", "cluster_size", "total_count")

    return run


def run_stats_d1(spark, sf_dir):
    u = unique.with_ids(uniques(spark, sf_dir))
    edges = simjoin.similar_edges(u, 1)
    return clusters.run_stats(u, edges, clusters.summarise(clusters.label(u, edges)))


def _greedy(kind: str, r: int):
    def run(spark, sf_dir):
        u = uniques(spark, sf_dir)
        grouped = greedy.greedy_seen(u, r) if kind == "seen" else greedy.greedy_ball(u, r)
        return greedy.summarise_greedy(grouped)

    return run


def greedy_stream(spark, sf_dir):
    """Greedy groups of reads that come as a stream of five micro-batches or more."""
    out = scratch(spark, "arrivals")
    # each task of the scan writes five files, so no task gets a fifth of all reads
    dealt = reads(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("read_idx", "sequence"), F.lit(5)).cast("int"))
    dealt.write.partitionBy("part").parquet(f"{out}/reads")
    files = len(spark.read.parquet(f"{out}/reads").inputFiles())
    arriving = spark.readStream.schema("read_idx long, sequence string, part int").option("maxFilesPerTrigger", max(1, files // 5)).parquet(f"{out}/reads").drop("part")
    online = OnlineGreedy(spark, f"{out}/state")
    online.run(arriving, f"{out}/checkpoint")
    return greedy.summarise_greedy(online.groups())


# -- agreement ---------------------------------------------------------------


def _two_rankings(spark, sf_dir):
    """Uniques by count, and the same with both strands of a sequence counted as one."""
    u = uniques(spark, sf_dir)
    strands = u.groupBy(F.least("sequence", fn.revcomp("sequence")).alias("sequence")).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    return agreement.ranked(u, "first_seen"), agreement.ranked(strands, "first_seen")


def ranked(spark, sf_dir):
    return _two_rankings(spark, sf_dir)[0]


def count_cdf(spark, sf_dir):
    return agreement.count_cdf(_two_rankings(spark, sf_dir)[0])


def topn_overlap(spark, sf_dir):
    return agreement.topn_overlap(*_two_rankings(spark, sf_dir))


def metrics(spark, sf_dir):
    """The three tables of an agreement, as series."""
    u = uniques(spark, sf_dir)
    strands = u.groupBy(F.least("sequence", fn.revcomp("sequence")).alias("sequence")).agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"))
    return sinks.plot_data(*agreement.compute_metrics(u, strands, "first_seen"))


def agreement_report(spark, sf_dir):
    return sinks.report_lines(agreement.topn_overlap(*_two_rankings(spark, sf_dir)))


def plot_data(spark, sf_dir):
    old, new = _two_rankings(spark, sf_dir)
    return sinks.plot_data(agreement.topn_overlap(old, new), agreement.count_cdf(old), agreement.count_cdf(new))


QUERIES = {
    "unique_reads": unique_reads, "unique_table": unique_table, "read_stats": read_stats, "length_profile": length_profile, "length_totals": length_totals,
    "length_partitions": length_partitions, "length_offsets": length_offsets, "seq_ids": seq_ids, "invalid_reads": invalid_reads, "doc_dedup": doc_dedup,
    "stream_uniques": stream_uniques, "fastq_scan": fastq_scan, "fasta_scan": fasta_scan, "edge_table": edge_table, "header_counts": header_counts,
    "revcomp": revcomp, "seed_parts": seed_parts, "sql_functions": sql_functions, "hamming_neighbors": hamming_neighbors, "seed_index": seed_index,
    "pairs_d0": _pairs(0), "pairs_d1": _pairs(1), "pairs_d2": _pairs(2), "pairs_d3": _pairs(3), "pairs_d1_reference": _pairs(1, mode="reference"), "pairs_d2_reference": _pairs(2, mode="reference"),
    "pairs_forward_d2": _pairs(2, strands=False), "pairs_by_length": _pairs(2, lengths=(23, 24)), "length_pairs": length_pairs, "edges_d1": edges_d1, "raw_edges_d1": raw_edges_d1,
    "part_name_pairs": part_name_pairs, "components_d1": components_d1, "clusters_d1": _clusters(1), "clusters_d2": _clusters(2), "clusters_d2_reference": _clusters(2, "reference"),
    "run_stats_d1": run_stats_d1, "greedy_seen": _greedy("seen", 1), "greedy_seen_2": _greedy("seen", 2), "greedy_ball": _greedy("ball", 1), "greedy_ball_2": _greedy("ball", 2),
    "ranked": ranked, "count_cdf": count_cdf, "topn_overlap": topn_overlap, "agreement_report": agreement_report,
    "length_tables": length_tables, "cluster_table": cluster_table, "greedy_fasta": _greedy_fasta(False), "greedy_fasta_members": _greedy_fasta(True), "disjoint_sets": disjoint_sets, "plot_data": plot_data,
    "disjoint_sets_batches": disjoint_sets_batches, "disjoint_sets_merges": disjoint_sets_merges, "ranked_clusters": ranked_clusters, "edge_folder": edge_folder, "metrics": metrics, "greedy_stream": greedy_stream,
    "indexed_edges": indexed_edges,
}

_TWO = f"""{UNIQUES},
v AS (SELECT sequence, 0 AS side, n, first_seen FROM u
      UNION ALL SELECT least(sequence, rc), 1, CAST(sum(n) AS BIGINT), min(first_seen) FROM o GROUP BY least(sequence, rc)),
k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, first_seen, sequence) AS rank FROM v)"""
_SHARED = f"""WITH {_TWO},
come AS (SELECT greatest(a.rank, b.rank) AS rank FROM k a JOIN k b ON a.sequence = b.sequence AND a.side = 0 AND b.side = 1),
ranks AS (SELECT rank FROM k GROUP BY rank HAVING count(*) = 2),
s AS (SELECT rank, (SELECT count(*) FROM come WHERE come.rank <= ranks.rank) / rank AS fraction_shared FROM ranks)"""
_PAIRS = "SELECT a, b, distance FROM p"
_NEIGHBOR_KEY = """h AS (SELECT s.sequence AS s, s.first_seen AS s_seen, t.sequence AS t, t.first_seen AS t_seen,
        list_filter(range(1, s.len + 1), lambda i: s.sequence[i] <> t.sequence[i]) AS places
      FROM o s JOIN o t ON s.len = t.len AND s.first_seen > t.first_seen AND hamming(s.sequence, t.sequence) <= {r}),
g AS (SELECT s, t, len(places) AS m, places, list_transform(places, lambda i: instr('ATCG', t[i])) AS letters FROM h),
parent AS (SELECT s, t FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY m, places, letters) AS place FROM g) WHERE place = 1)"""


_GROUPS = """climb AS (SELECT sequence AS s, sequence AS top FROM o UNION SELECT climb.s, parent.t FROM climb JOIN parent ON parent.s = climb.top),
root AS (SELECT s, top FROM climb WHERE top NOT IN (SELECT s FROM parent)),
j AS (SELECT o.*, q.first_seen AS root_first_seen FROM root JOIN o ON o.sequence = s JOIN o q ON q.sequence = top),
w AS (SELECT *, row_number() OVER (PARTITION BY root_first_seen ORDER BY n DESC, first_seen) AS place FROM j)
SELECT max(CASE WHEN place = 1 THEN sequence END) AS sequence, count(*) AS cluster_size, CAST(sum(n) AS BIGINT) AS total_count, root_first_seen FROM w GROUP BY root_first_seen"""
_LETTERS = "(VALUES ('A', 1), ('T', 2), ('C', 3), ('G', 4))"
#: Strings of a ball in their order: one mismatch, then two.
_CLAIMS = {
    1: f"SELECT sequence AS s, first_seen AS seen, concat(substr(sequence, 1, CAST(i.i AS INT) - 1), c.c, substr(sequence, CAST(i.i AS INT) + 1)) AS x, [1, i.i, 0, c.k, 0] AS place FROM e JOIN range(1, 40) i(i) ON i.i <= len JOIN {_LETTERS} c(c, k) ON sequence[i.i] <> c.c",
    2: f"SELECT sequence, first_seen, concat(substr(sequence, 1, CAST(i.i AS INT) - 1), c.c, substr(sequence, CAST(i.i AS INT) + 1, CAST(j.j - i.i AS INT) - 1), d.c, substr(sequence, CAST(j.j AS INT) + 1)), [2, i.i, j.j, c.k, d.k] FROM e JOIN range(1, 40) i(i) ON i.i <= len JOIN range(1, 40) j(j) ON j.j <= len AND j.j > i.i JOIN {_LETTERS} c(c, k) ON sequence[i.i] <> c.c JOIN {_LETTERS} d(c, k) ON sequence[j.j] <> d.c",
}


def _ball(r: int) -> str:
    """Expanders one by one in a list; then who first claimed which string of all balls."""
    return f"""ordered AS (SELECT sequence, len, row_number() OVER (ORDER BY first_seen) AS k FROM o),
st AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS ex
       UNION ALL
       SELECT st.k + 1, CASE WHEN len(list_filter(ex, lambda e: CASE WHEN length(e) = q.len THEN hamming(e, q.sequence) <= {r} ELSE false END)) = 0 THEN list_append(ex, q.sequence) ELSE ex END
       FROM st JOIN ordered q ON q.k = st.k + 1),
x AS (SELECT unnest(ex) AS sequence FROM st WHERE k = (SELECT max(k) FROM ordered)),
e AS (SELECT o.* FROM o JOIN x USING (sequence)),
own AS (SELECT s.sequence AS s, arg_min(e.sequence, e.first_seen) AS t FROM o s JOIN e ON e.len = s.len AND e.first_seen < s.first_seen AND hamming(e.sequence, s.sequence) <= {r}
        WHERE s.sequence NOT IN (SELECT sequence FROM x) GROUP BY s.sequence),
claim AS ({" UNION ALL ".join(_CLAIMS[k] for k in range(1, r + 1))}),
owner AS (SELECT x, arg_min(s, seen) AS t FROM claim GROUP BY x HAVING count(*) > 1),
late AS (SELECT s, arg_min(t, place) AS t FROM claim JOIN owner USING (x) WHERE t <> s GROUP BY s),
parent AS (SELECT * FROM own UNION ALL SELECT * FROM late)"""


ORACLE = {
    "unique_reads": f"WITH {UNIQUES} SELECT sequence, n AS count, first_seen, len AS length FROM u",
    "unique_table": f"WITH {UNIQUES} SELECT sequence, n AS count, (SELECT count(*) FROM u) AS uniques, CAST((SELECT sum(n) FROM u) AS BIGINT) AS reads FROM u",
    "read_stats": f"WITH {UNIQUES} SELECT (SELECT CAST(sum(n) AS BIGINT) FROM u) AS total, (SELECT count(*) FROM r WHERE length(translate(sequence, 'ACGT', '')) > 0) AS skipped, (SELECT count(*) FROM u) AS uniques",
    "length_profile": f"WITH {UNIQUES} SELECT len AS length, count(*) AS uniques, CAST(sum(n) AS BIGINT) AS reads FROM u GROUP BY len",
    "length_totals": f"WITH {UNIQUES} SELECT coalesce(len, -1) AS length, count(*) AS uniques, CAST(sum(n) AS BIGINT) AS reads FROM u GROUP BY ROLLUP (len)",
    "length_partitions": f"WITH {UNIQUES} SELECT sequence, n AS count, len AS length FROM u",
    "length_tables": f"WITH {UNIQUES} SELECT sequence, n AS count, len AS length FROM u",
    "length_offsets": f"WITH {UNIQUES}, c AS (SELECT len AS length, count(*) AS uniques FROM u GROUP BY len) SELECT length, uniques, CAST(sum(uniques) OVER (ORDER BY length) - uniques AS BIGINT) AS offset FROM c",
    "seq_ids": f"WITH {UNIQUES} SELECT id AS seq_id, sequence, n AS count FROM o",
    "invalid_reads": f"WITH r AS ({READS}) SELECT read_idx, sequence FROM r WHERE length(translate(sequence, 'ACGT', '')) > 0",
    "doc_dedup": "SELECT text, count(*) AS count, min(doc_id) AS first_doc FROM documents GROUP BY text",
    "stream_uniques": f"WITH {UNIQUES} SELECT sequence, n AS count, first_seen FROM u",
    "fastq_scan": f"WITH r AS ({READS}), f AS (SELECT row_number() OVER (ORDER BY read_idx, sequence) - 1 AS place, * FROM r) SELECT place AS read_idx, concat('read', read_idx) AS header, sequence FROM f WHERE length(translate(sequence, 'ACGT', '')) = 0",
    "fasta_scan": f"WITH {UNIQUES} SELECT id AS place, sequence, n AS count FROM o",
    "edge_table": f"WITH {UNIQUES}, {_brute(1)} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM p",
    "header_counts": "SELECT o_orderkey, concat('run 1:N:0:ACGT Nmembers:', o_custkey % 7, ' N:', o_orderkey % 1000) AS header, o_orderkey % 1000 AS count FROM orders",
    "revcomp": f"WITH {UNIQUES} SELECT sequence, rc FROM o",
    "seed_parts": f"WITH {UNIQUES} SELECT n.len AS n, CAST(k.k AS INT) AS k, CAST(i.i AS INT) AS part, CAST(i.i * (n.len // k.k) + least(i.i, n.len % k.k) AS INT) AS st, CAST(n.len // k.k + CASE WHEN i.i < n.len % k.k THEN 1 ELSE 0 END AS INT) AS sz FROM (SELECT DISTINCT len FROM u) n, range(1, 6) k(k), range(0, 5) i(i) WHERE i.i < k.k",
    "sql_functions": f"WITH r AS ({READS}) SELECT DISTINCT sequence, reverse(translate(sequence, 'ACGT', 'TGCA')) AS rc, length(translate(sequence, 'ACGT', '')) = 0 AS valid, 3 AS parts FROM r",
    "hamming_neighbors": f"WITH {UNIQUES} SELECT sequence, CAST(row_number() OVER (PARTITION BY sequence ORDER BY i.i, c.k) - 1 AS INT) AS ordinal, concat(substr(sequence, 1, CAST(i.i AS INT) - 1), c.c, substr(sequence, CAST(i.i AS INT) + 1)) AS neighbor FROM u JOIN range(1, 40) i(i) ON i.i <= len JOIN (VALUES ('A', 1), ('T', 2), ('C', 3), ('G', 4)) c(c, k) ON substr(sequence, CAST(i.i AS INT), 1) <> c.c",
    "seed_index": f"WITH {UNIQUES}, {_parts(2)}, s AS (SELECT len AS length, part, unnest([substr(sequence, st + 1, sz), reverse(translate(substr(sequence, st + 1, sz), 'ACGT', 'TGCA'))]) AS seed FROM o JOIN parts ON parts.n = o.len) SELECT length, part, seed, count(*) AS entries FROM s GROUP BY ALL",
    **{f"pairs_d{d}": f"WITH {UNIQUES}, {_brute(d)} {_PAIRS}" for d in range(4)},
    **{f"pairs_d{d}_reference": f"WITH {UNIQUES}, {_seeded(d)} {_PAIRS}" for d in (1, 2)},
    "pairs_forward_d2": f"WITH {UNIQUES}, {_brute(2, rc=False)} {_PAIRS}",
    "pairs_by_length": f"WITH {UNIQUES}, {_brute(2, 'AND a.len = 23 AND b.len = 24')} {_PAIRS}",
    "length_pairs": f"WITH {UNIQUES}, n AS (SELECT DISTINCT len FROM u) SELECT a.len AS length_a, b.len AS length_b FROM n a JOIN n b ON a.len <= b.len AND b.len - a.len <= 1",
    "edges_d1": f"WITH {UNIQUES}, {_brute(1)} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, distance FROM p",
    "indexed_edges": f"WITH {UNIQUES}, {_brute(2)} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b, distance FROM p",
    "raw_edges_d1": f"""WITH {UNIQUES}, {_seeded(1)},
loops AS (SELECT DISTINCT o.id FROM (SELECT *, count(*) OVER (PARTITION BY n, part, seed) AS m FROM sa) q JOIN o USING (sequence) WHERE m > 1)
SELECT x AS id_a, y AS id_b FROM p UNION ALL SELECT y, x FROM p WHERE length(a) = length(b) UNION ALL SELECT id, id FROM loops""",
    "part_name_pairs": "WITH n AS (SELECT DISTINCT p_name AS s FROM part) SELECT a.s AS a, b.s AS b, CAST(levenshtein(a.s, b.s) AS INT) AS distance FROM n a JOIN n b ON length(a.s) < length(b.s) OR (length(a.s) = length(b.s) AND a.s < b.s) WHERE levenshtein(a.s, b.s) <= 3",
    "components_d1": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {COMPONENTS} SELECT id, component FROM comp",
    "clusters_d1": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {CLUSTERS}",
    "clusters_d2": f"WITH RECURSIVE {UNIQUES}, {_brute(2)}, {CLUSTERS}",
    "clusters_d2_reference": f"WITH RECURSIVE {UNIQUES}, {_seeded(2)}, {CLUSTERS}",
    "cluster_table": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {CLUSTERS}",
    "disjoint_sets": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {COMPONENTS} SELECT id, component FROM comp",
    **{name: f"SELECT row_number() OVER (ORDER BY total_count DESC, root_first_seen) - 1 AS place, sequence, total_count AS count FROM (WITH RECURSIVE {UNIQUES}, {_NEIGHBOR_KEY.format(r=1)},\n{_GROUPS})" for name in ("greedy_fasta", "greedy_fasta_members")},
    "run_stats_d1": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {COMPONENTS} SELECT (SELECT count(*) FROM u) AS uniques, CAST((SELECT sum(n) FROM u) AS BIGINT) AS reads, (SELECT count(*) FROM p) AS pairs, (SELECT count(DISTINCT component) FROM comp) AS clusters",
    **{name: f"WITH RECURSIVE {UNIQUES}, {_NEIGHBOR_KEY.format(r=1)},\n{_GROUPS}" for name in ("greedy_seen", "greedy_stream")},
    "ranked_clusters": f"SELECT row_number() OVER (ORDER BY total_count DESC, rep) - 1 AS place, sequence, cluster_size, total_count FROM (WITH RECURSIVE {UNIQUES}, {_brute(1)}, {CLUSTERS}) c JOIN (SELECT sequence, rep FROM (WITH {UNIQUES} SELECT sequence, id AS rep FROM o)) USING (sequence)",
    "edge_folder": f"WITH {UNIQUES}, {_brute(1)} SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM p",
    "disjoint_sets_batches": f"WITH RECURSIVE {UNIQUES}, {_brute(1)}, {_REACHES} SELECT c0.id, c0.component AS after_0, c1.component AS after_1, c2.component AS after_2 FROM c0 JOIN c1 USING (id) JOIN c2 USING (id)",
    "disjoint_sets_merges": f"""WITH RECURSIVE {UNIQUES}, {_brute(1)}, {_REACHES},
n AS (SELECT -1 AS k, count(*) AS sets, 7 AS set_of_7 FROM o {" ".join(f"UNION ALL SELECT {k}, count(DISTINCT component), max(CASE WHEN id = 7 THEN component END) FROM c{k}" for k in range(3))})
SELECT n.k AS batch, (SELECT count(*) FROM p WHERE least(x, y) % 3 = n.k) AS edges, b.sets - n.sets AS merged, CAST(n.set_of_7 AS BIGINT) AS set_of_7 FROM n JOIN n b ON b.k = n.k - 1""",
    "greedy_seen_2": f"WITH RECURSIVE {UNIQUES}, {_NEIGHBOR_KEY.format(r=2)},\n{_GROUPS}",
    "greedy_ball": f"WITH RECURSIVE {UNIQUES}, {_ball(1)},\n{_GROUPS}",
    "greedy_ball_2": f"WITH RECURSIVE {UNIQUES}, {_ball(2)},\n{_GROUPS}",
    "ranked": f"WITH {_TWO} SELECT rank, sequence, n AS count FROM k WHERE side = 0",
    "count_cdf": f"WITH {_TWO} SELECT rank, sum(n) OVER (ORDER BY rank) / sum(n) OVER () AS cdf FROM k WHERE side = 0",
    "topn_overlap": f"{_SHARED} SELECT rank, fraction_shared FROM s",
    **dict.fromkeys(("plot_data", "metrics"), f"{_SHARED} SELECT 'shared' AS series, rank, fraction_shared AS value FROM s UNION ALL SELECT CASE side WHEN 0 THEN 'cdf_old' ELSE 'cdf_new' END, rank, sum(n) OVER (PARTITION BY side ORDER BY rank) / sum(n) OVER (PARTITION BY side) FROM k"),
    "agreement_report": f"{_SHARED} SELECT rank, 'Top ' || lpad(format('{{:,}}', rank), 7, ' ') || ': ' || printf('%4.2f', 100 * fraction_shared) || '% shared' AS line FROM s WHERE rank IN (1, 10, 100, 1000, 10000, 100000) AND rank < (SELECT max(rank) FROM s)",
}
