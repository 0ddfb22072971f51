"""A small read set with known results, edge cases of the formats, and properties."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import sequences as fn
from lodestrand.operators import agreement, clusters, components, greedy, simjoin, unique
from lodestrand.sources import reads as scan
from lodestrand.sources import sinks

MICRO = (
    "ACGTTGCAAGTC ACGTTGCAAGTC ACGTTGCAAGTC ACGTTGCAAGTA ACGTTGCAAGTA ACGTNGCAAGTC ACGTTGCAGTC CGTTGCAAGTCA GACTTGCAACGT "
    "TTTTGGGGCCCC TTTTGGGGCCCC TTTTGGGGCCAA acgttgcaagtc TTTTGGGGGCCCC GGAACCTTGGAA TTCCAAGGTTCC ACGTTGCAAGTC"
).split()
IDS = "ACGTTGCAAGTC ACGTTGCAAGTA TTTTGGGGCCCC ACGTTGCAGTC CGTTGCAAGTCA GACTTGCAACGT TTTTGGGGCCAA TTTTGGGGGCCCC GGAACCTTGGAA TTCCAAGGTTCC".split()


def fastq(path, reads):
    path.write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    return str(path)


@pytest.fixture(scope="module")
def micro(spark, tmp_path_factory):
    r = scan.read_fastq(spark, fastq(tmp_path_factory.mktemp("fq") / "m.fq", MICRO), keep_invalid=True)
    u = unique.with_ids(unique.unique_sequences(r)).cache()
    return r, u


def edges(u, d, mode):
    return {(r.id_a, r.id_b) for r in simjoin.edges_by_id(simjoin.similar_pairs(u, d, mode=mode), u).collect()}


def test_unique_table_and_stats(micro):
    r, u = micro
    s = unique.read_stats(r).first()
    assert (s.total, s.skipped, s.uniques) == (15, 2, 10)
    rows = u.orderBy("seq_id").collect()
    assert [x.sequence for x in rows] == IDS and [x["count"] for x in rows] == [4, 2, 2, 1, 1, 1, 1, 1, 1, 1]
    assert {(x.length, x.uniques, x.reads) for x in unique.length_profile(u).collect()} == {(11, 1, 1), (12, 8, 13), (13, 1, 1)}


@pytest.mark.parametrize(
    ("d", "mode", "want"),
    [
        (1, "reference", "0-1 0-3 2-7"),
        (1, "complete", "0-1 0-3 0-5 1-5 2-7 3-5 8-9"),
        (2, "reference", "0-1 0-3 0-5 1-3 1-5 2-6 2-7 3-5 8-9"),
        (2, "complete", "0-1 0-3 0-5 1-3 1-5 2-6 2-7 3-5 8-9 0-4 1-4 4-5"),
    ],
)
def test_edges(micro, d, mode, want):
    assert edges(micro[1], d, mode) == {tuple(map(int, e.split("-"))) for e in want.split()}


@pytest.mark.parametrize(
    ("d", "mode", "want"),
    [
        (1, "reference", [(0, 3, 7), (2, 2, 3), (4, 1, 1), (5, 1, 1), (6, 1, 1), (8, 1, 1), (9, 1, 1)]),
        (1, "complete", [(0, 4, 8), (2, 2, 3), (8, 2, 2), (4, 1, 1), (6, 1, 1)]),
        (2, "reference", [(0, 4, 8), (2, 3, 4), (8, 2, 2), (4, 1, 1)]),
        (2, "complete", [(0, 5, 9), (2, 3, 4), (8, 2, 2)]),
    ],
)
def test_clusters_in_output_order(micro, d, mode, want):
    c = clusters.ordered(clusters.cluster(micro[1], d, mode=mode)).collect()
    assert [(r.rep_id, r.cluster_size, r.total_count) for r in c] == want
    assert [r.sequence for r in c] == [IDS[w[0]] for w in want]


@pytest.mark.parametrize(("d", "loops"), [(1, {0, 1, 2, 6}), (2, {0, 1, 2, 3, 5, 6, 8, 9})])
def test_raw_layout(micro, d, loops):
    got = {(r.id_a, r.id_b) for r in simjoin.raw_edges(micro[1], d).collect()}
    assert {a for a, b in got if a == b} == loops
    plain = edges(micro[1], d, "reference")
    assert {(min(p), max(p)) for p in got if p[0] != p[1]} == plain
    for a, b in plain:
        assert ((a, b) in got and (b, a) in got) == (len(IDS[a]) == len(IDS[b]))


BALL = [(0, 2, 6), (2, 2, 3), (3, 1, 1), (4, 1, 1), (5, 1, 1), (7, 1, 1), (8, 1, 1), (9, 1, 1)]
SEEN1 = [(0, 2, 6), (2, 1, 2), (3, 1, 1), (4, 1, 1), (5, 1, 1), (6, 1, 1), (7, 1, 1), (8, 1, 1), (9, 1, 1)]


@pytest.mark.parametrize(("kind", "r", "want"), [("ball", 1, BALL), ("ball", 2, BALL), ("seen", 1, SEEN1), ("seen", 2, BALL)])
def test_greedy(micro, kind, r, want):
    g = (greedy.greedy_ball if kind == "ball" else greedy.greedy_seen)(micro[1], r)
    got = {(IDS.index(x.sequence), x.cluster_size, x.total_count) for x in greedy.summarise_greedy(g).collect()}
    assert got == set(want)


def neighbours(s, r):
    """Strings within r mismatches in generation order, one by one."""
    for i, c in enumerate(s):
        for n in "ATCG":
            if n != c:
                yield s[:i] + n + s[i + 1 :]
    if r == 2:
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for a in "ATCG":
                    for b in "ATCG":
                        if a != s[i] and b != s[j]:
                            yield s[:i] + a + s[i + 1 : j] + b + s[j + 1 :]


def sequential(reads, r, ball):
    """Groups by reading one by one: each string's group number."""
    group, n = {}, 0
    for s in reads:
        if s in group:
            mine = group[s]
        else:
            mine = next((group[x] for x in neighbours(s, r) if x in group), None)
            if mine is None:
                mine, n = n, n + 1
            new = s not in group
            group[s] = mine
            if ball and new:
                for x in neighbours(s, r):
                    group.setdefault(x, mine)
    return {s: group[s] for s in reads}


@pytest.mark.parametrize("r", [1, 2])
@pytest.mark.parametrize("kind", ["ball", "seen"])
@pytest.mark.parametrize("how", ["one task", "rounds", "long ones"])
def test_greedy_equals_reading_one_by_one(spark, kind, r, how, monkeypatch):
    """However few pairs one task decides; and with strings too long to be packed, beside those that are."""
    monkeypatch.setattr(greedy, "LOCAL", {"one task": 10_000, "rounds": 0, "long ones": 5}[how])
    rng = random.Random(r * 7 + len(kind))
    reads = ["".join(rng.choice("ACG") for _ in range(rng.choice([4, 5, 6]))) for _ in range(120)]
    df = unique.unique_sequences(spark.createDataFrame(list(enumerate(reads)), "read_idx long, sequence string"))
    if how == "long ones":
        reads = [s + rng.choice(["", "", "A" * 30]) for s in reads] + ["", "T"]
        df = spark.createDataFrame(list(enumerate(reads)), "first_seen long, sequence string").groupBy("sequence").agg(F.min("first_seen").alias("first_seen"), F.count("*").alias("count"))
    g = (greedy.greedy_ball if kind == "ball" else greedy.greedy_seen)(df, r).select("sequence", "root").collect()
    want = sequential(reads, r, kind == "ball")
    by_root, by_group = {}, {}
    for x in g:
        by_root.setdefault(x.root, set()).add(x.sequence)
    for s, k in want.items():
        by_group.setdefault(k, set()).add(s)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_group.values()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, x, b, i)
    return row[-1]


def _step(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_complete_is_brute_force_and_reference_is_within(spark, d):
    rng = random.Random(d)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 12))) for _ in range(25)]
    comp = str.maketrans("ACGT", "TGCA")
    for s in list(base):
        t = list(s)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(0, len(t) + 1)
            t[k : k + rng.randrange(0, 2)] = [rng.choice("ACGT")] * rng.randrange(0, 2)
        base.append("".join(t)[:: rng.choice([1, -1])])
        base.append(s.translate(comp)[::-1])
    base = sorted(set(base))
    df = spark.createDataFrame([(s,) for s in base], "sequence string")
    want = {}
    for a in base:
        for b in base:
            if (len(a), a) < (len(b), b):
                k = min(distance(a, b), distance(a, b.translate(comp)[::-1]))
                if k <= d:
                    want[a, b] = k
    got = {(r.a, r.b): r.distance for r in simjoin.similar_pairs(df, d).collect()}
    assert got == want
    ref = {(r.a, r.b): r.distance for r in simjoin.similar_pairs(df, d, mode="reference").collect()}
    assert ref.items() <= want.items()


def test_hot_seeds_are_salted_without_loss(spark, monkeypatch):
    rng = random.Random(3)
    seqs = sorted({"AAAAAAAA" + "".join(rng.choice("ACGT") for _ in range(6)) for _ in range(150)})
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    want = {(r.a, r.b) for r in simjoin.similar_pairs(df, 1).collect()}
    monkeypatch.setattr(simjoin, "HOT_SEED", 7)
    assert {(r.a, r.b) for r in simjoin.similar_pairs(df, 1).collect()} == want and want


def test_a_seed_that_is_frequent_on_the_long_side_only(spark, monkeypatch):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    short = ["A" * 8 + letters(8) for _ in range(3)]
    long_ = list({"A" * 8 + letters(9) for _ in range(400)}) + [s[:9] + "C" + s[9:] for s in short]
    u = spark.createDataFrame([(s,) for s in dict.fromkeys(short + long_)], "sequence string")
    want = {tuple(r) for r in simjoin.similar_pairs(u, 1).collect()}
    monkeypatch.setattr(simjoin, "HOT_SEED", 20)
    monkeypatch.setattr(simjoin, "SAMPLE", 2)
    got = simjoin.similar_pairs(u, 1).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) >= 3


def test_parts_tile_the_length(spark):
    for n, k, want in ((12, 2, [(0, 6), (6, 12)]), (25, 3, [(0, 9), (9, 17), (17, 25)]), (11, 3, [(0, 4), (4, 8), (8, 11)]), (2, 3, [(0, 1), (1, 2), (2, 2)])):
        p = spark.range(1).select(fn.parts(F.lit(n), k).alias("p")).first().p
        assert [(x.st, x.st + x.sz) for x in p] == want


def test_revcomp_is_an_involution(spark):
    df = spark.createDataFrame([("",), ("ACGTN",), ("TTTT",)], "s string")
    for r in df.select("s", fn.revcomp(fn.revcomp("s")).alias("t")).collect():
        assert r.s == r.t


def test_hamming_neighbours_in_order(spark):
    for s in ("", "A", "ACG"):
        for r in (1, 2):
            got = spark.range(1).select(fn.hamming_neighbors(F.lit(s), r).alias("n")).first().n
            assert [x.neighbor for x in got] == list(neighbours(s, r))


# -- formats -----------------------------------------------------------------


def test_blank_header_ends_the_scan(spark, tmp_path):
    p = tmp_path / "a.fq"
    p.write_text("@a\nACGT\n+\nIIII\n\n@b\nACGT\n+\nIIII\n")
    assert scan.read_fastq(spark, str(p)).count() == 1
    with pytest.raises(Exception, match="blank header"):
        scan.read_fastq(spark, str(p), strict=True).collect()


def test_many_files_are_read_one_after_the_other(spark, tmp_path):
    lanes = [[("a", "ACGT"), ("b", "GGG")], [("c", "TTTT")], [], [("d", "CC"), ("", "XX"), ("e", "AA")], [("f", "G")]]
    for k, lane in enumerate(lanes):
        (tmp_path / f"L00{k}.fq").write_text("".join(f"@{h}\n{s}\n+\n{s}\n" if h else "\nXX\n+\nXX\n" for h, s in lane))
    for path in (str(tmp_path), f"{tmp_path}/L*.fq"):
        got = sorted((r.read_idx, r.header, r.sequence) for r in scan.read_fastq_named(spark, path).collect())
        assert got == [(0, "a", "ACGT"), (1, "b", "GGG"), (2, "c", "TTTT"), (3, "d", "CC"), (4, "f", "G")]


def test_cut_off_record_is_an_empty_read(spark, tmp_path):
    p = tmp_path / "a.fq"
    p.write_text("@a\nACGT\n+\nIIII\n@b\n")
    assert [r.sequence for r in scan.read_fastq(spark, str(p)).orderBy("read_idx").collect()] == ["ACGT", ""]


def test_splits_of_a_file_keep_line_order(spark, tmp_path):
    p = tmp_path / "big.fq"
    reads = ["ACGT"[i % 4] * (1 + i % 9) for i in range(3000)]
    fastq(p, reads)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = scan.read_fastq(spark, str(p)).orderBy("read_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.sequence for r in got] == reads and [r.header for r in got[:2]] == ["@r0", "@r1"]


def test_unique_table_round_trip_and_errors(spark, tmp_path, micro):
    out = str(tmp_path / "u.csv")
    sinks.write_unique_table(micro[1], out)
    raw = open(out, newline="").read()
    assert raw.startswith("# unique_sequences=10, total_reads=15\nsequence\tcount\r\nACGTTGCAAGTC\t4\r\n")
    assert scan.unique_header(spark, out) == (10, 15)
    assert {(r.sequence, r["count"]) for r in scan.read_unique_table(spark, out).collect()} == {(r.sequence, r["count"]) for r in micro[1].collect()}
    p = tmp_path / "v.csv"
    p.write_text("# x\n# y\ncount\tsequence\n3\t\n2\tAC\n")
    assert {(r.sequence, r["count"]) for r in scan.read_unique_table(spark, str(p)).collect()} == {("", 3), ("AC", 2)}
    with pytest.raises(ValueError):
        scan.unique_header(spark, str(p))
    p.write_text("sequence\tn\nA\t1\n")
    with pytest.raises(ValueError):
        scan.read_unique_table(spark, str(p))
    with pytest.raises(ValueError):
        unique.check_columns(spark.createDataFrame([(1,)], "sequence int"))


def test_ranked_fasta(spark, tmp_path):
    p = tmp_path / "r.fasta"
    p.write_text(">a 1:N:0:X N:5\nAC\n>b Nmembers:3 N:2\nGG\n>c N:9\nAC\n")
    assert {(r.rec, r.sequence, r["count"]) for r in scan.read_ranked_fasta(spark, str(p)).collect()} == {(0, "AC", 9), (1, "GG", 2)}
    for bad in (">a\nAC\n", ">a N:1.5\nAC\n"):
        p.write_text(bad)
        with pytest.raises(Exception):
            scan.read_ranked_fasta(spark, str(p)).collect()


def test_length_files(spark, tmp_path, micro):
    sinks.write_length_tables(micro[1], str(tmp_path))
    assert list(scan.discover_lengths(spark, str(tmp_path))) == [11, 12, 13]
    (tmp_path / "length_x.csv").write_text("")
    with pytest.raises(ValueError):
        scan.discover_lengths(spark, str(tmp_path))


def test_cli_end_to_end(spark, tmp_path, micro, capsys):
    from lodestrand.cli import main

    fq = fastq(tmp_path / "m.fq", MICRO)
    main(["unique", "-i", fq, "-o", f"{tmp_path}/unique.csv"], spark)
    main(["split", "-i", f"{tmp_path}/unique.csv", "-o", f"{tmp_path}/len"], spark)
    main(["all-pairs", "--length-dir", f"{tmp_path}/len", "-d", "2", "-o", f"{tmp_path}/edges", "--mode", "reference"], spark)
    names = sorted(p.name for p in (tmp_path / "edges").iterdir() if p.name.startswith("pairs"))
    assert names == ["pairs_len11_len12_d2.csv", "pairs_len12_len12_d2.csv", "pairs_len12_len13_d2.csv"]
    main(["all-pairs", "--length-dir", f"{tmp_path}/len", "-d", "1", "-o", f"{tmp_path}/edges"], spark)
    with pytest.raises(ValueError):  # two distances in one folder
        main(["cluster", "--unique", f"{tmp_path}/unique.csv", "--edges-dir", f"{tmp_path}/edges", "-o", f"{tmp_path}/no.csv"], spark)
    main(["cluster", "--unique", f"{tmp_path}/unique.csv", "--edges-dir", f"{tmp_path}/edges", "-d", "2", "--parts", "-o", f"{tmp_path}/cluster_parts"], spark)
    parts = [p.read_text() for p in sorted((tmp_path / "cluster_parts").glob("part-*"))]
    main(["cluster", "--unique", f"{tmp_path}/unique.csv", "--edges-dir", f"{tmp_path}/edges", "-d", "2", "-o", f"{tmp_path}/clusters.csv", "--fasta", f"{tmp_path}/clusters.fasta"], spark)
    lines = open(f"{tmp_path}/clusters.csv").read().split("\n")
    assert "".join(parts) == "\n".join(lines)
    assert lines[0] == "sequence\tcluster_size\ttotal_count" and lines[1] == f"{IDS[0]}\t4\t8"
    main(["pairs", "--length-dir", f"{tmp_path}/len", "--length-a", "12", "--length-b", "13", "-d", "1", "-o", f"{tmp_path}/one"], spark)
    assert open(f"{tmp_path}/one/pairs_len12_len13_d1.csv").read().count("\n") == 2
    with pytest.raises(FileNotFoundError):
        main(["pairs", "--length-dir", f"{tmp_path}/len", "--length-a", "12", "--length-b", "30", "-d", "1", "-o", f"{tmp_path}/one"], spark)
    main(["greedy", "-i", fq, "-o", f"{tmp_path}/g.fasta", "--kind", "ball", "--members"], spark)
    assert open(f"{tmp_path}/g.fasta").read().startswith(f">r0 Nmembers:2 N:6\n{IDS[0]}\n")
    main(["agree", f"{tmp_path}/clusters.fasta", f"{tmp_path}/g.fasta", "--data", f"{tmp_path}/plot"], spark)
    assert "Top       1: 100.00% shared" in capsys.readouterr().out


# -- components and agreement --------------------------------------------------


def test_components_of_long_paths_and_stars(spark):
    n = 300
    e = [(i, i + 1) for i in range(n - 1)] + [(1000, i) for i in range(1001, 1200)] + [(5000, 5000)]
    got = {r.id: r.component for r in components.stars(spark.createDataFrame(e, "id_a long, id_b long")).collect()}
    assert all(got[i] == 0 for i in range(n)) and all(got[i] == 1000 for i in range(1000, 1200)) and 5000 not in got


def test_links_of_a_hub_stay_where_they_are(spark):
    n = 60_000
    star = spark.range(1, n + 1).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).repartition(8)
    to = components._least_hash(star, 0)
    assert to.count() == n + 1 and to.where("links > 1").count() == 1
    moved = components._moved(star, "v", to, 2 * n // components.HUBS)
    assert moved.count() == n and max(r["count"] for r in moved.groupBy(F.spark_partition_id()).count().collect()) <= n // 8 + 1
    done = components.stars(star.select(F.col("u").alias("id_a"), F.col("v").alias("id_b")), local=10)
    assert done.count() == n + 1 and done.where("component <> 0").count() == 0


@pytest.mark.parametrize("local", [0, 7, 10_000])
def test_components_of_random_graphs(spark, local):
    """Trees, cycles, hubs, chains in both directions and repeated links, however many of them one task settles."""
    rng = random.Random(local)
    e = [(i, i + 1) for i in range(0, 150)] + [(i + 1, i) for i in range(200, 300)] + [(400, i) for i in range(401, 600)] + [(700 + rng.randrange(200), 700 + rng.randrange(200)) for _ in range(150)] + [(1, 0)] * 40 + [(-5, 9)]
    forest = components.Forest()
    for x, y in e:
        if x != y:
            forest.join(x, y)
    got = components.stars(spark.createDataFrame(e, "id_a long, id_b long"), local=local).collect()
    assert {r.id: r.component for r in got} == {x: forest.find(x) for x in list(forest)} and len(got) == len(forest)
    named = components.stars(spark.createDataFrame([(f"n{x}", f"n{y}") for x, y in e], "id_a string, id_b string"), local=local)
    assert named.select("component").distinct().count() == len({forest.find(x) for x in list(forest)})


@pytest.mark.parametrize("local", [0, 5, 10_000])
def test_unions_one_by_one(spark, local):
    rng = random.Random(local)
    e = list(dict.fromkeys((rng.randrange(60), rng.randrange(60, 120)) for _ in range(140)))
    rng.shuffle(e)
    forest = components.Forest()
    want = {k for k, (x, y) in enumerate(e) if forest.join(x, y)}
    moved, joined = components.union_in_order(spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate(e)], "u long, v long, at long"), local=local)
    assert sorted(r["at"] for r in joined.collect()) == sorted(want)
    assert {r.id: r.to for r in moved.collect()} == {x: forest.find(x) for x in list(forest) if forest.find(x) != x}


def test_components_of_nothing_and_bad_edges(spark):
    v = spark.range(3)
    none = spark.createDataFrame([], "id_a long, id_b long")
    assert {(r.id, r.component) for r in components.connected_components(v, none).collect()} == {(0, 0), (1, 1), (2, 2)}
    with pytest.raises(IndexError):
        components.connected_components(v, spark.createDataFrame([(0, 7)], "id_a long, id_b long")).collect()


def test_disjoint_sets(spark):
    s = components.DisjointSets(spark, 5)
    assert s.union(3, 4) and not s.union(4, 3)
    s.update(spark.createDataFrame([(0, 0)], "id_a long, id_b long"), 1, 2)
    assert s.find(4) == 3 and s.find(2) == 1 and s.find(0) == 0
    with pytest.raises(IndexError):
        s.find(9)
    for bad in (9, -1, None):
        with pytest.raises(IndexError):
            s.update(spark.createDataFrame([(0, bad)], "id_a long, id_b long"))


def test_batches_write_the_sets_they_touch_and_say_what_merged(spark, monkeypatch):
    monkeypatch.setattr(components.DisjointSets, "MANY", 2)
    rng = random.Random(1)
    n, forest, s = 400, components.Forest(), components.DisjointSets(spark, 400)
    for k in range(4):
        e = [(rng.randrange(n), rng.randrange(n), i) for i in range(60)]
        e += [(x, y, 60 + i) for i, (x, y, _) in enumerate(e[:5])]
        got = s.update(spark.createDataFrame(e, "id_a long, id_b long, place long"), order=["place"])
        assert got.columns == ["id_a", "id_b", "merged"]
        want = sorted((x, y, forest.join(x, y)) for x, y, _ in sorted(e, key=lambda r: r[2]))
        assert sorted(map(tuple, got.collect())) == want
        if len(s._tables) > 1:
            assert s._tables[-1].count() == sum(w[2] for w in want)  # a row for each set that another one took in
        assert {r.id: r.component for r in s.components().collect()} == {x: forest.find(x) for x in range(n)}
        assert s.find_all([3, 7, 399]) == {x: forest.find(x) for x in (3, 7, 399)}
    assert len(s._tables) <= 3


def test_agreement_of_prefixes(spark):
    a = [("A", 9), ("B", 7), ("C", 5), ("D", 1)]
    b = [("B", 8), ("A", 8), ("D", 3)]
    table = lambda rows: spark.createDataFrame([(s, n, i) for i, (s, n) in enumerate(rows)], "sequence string, count long, rec long")
    shared, cdf_a, _ = agreement.compute_metrics(table(a), table(b))
    assert [r.fraction_shared for r in shared.orderBy("rank").collect()] == [0.0, 1.0, 2 / 3]
    assert [round(r.cdf, 6) for r in cdf_a.orderBy("rank").collect()] == [round(x / 22, 6) for x in (9, 16, 21, 22)]


def test_negative_distance(spark):
    with pytest.raises(ValueError):
        simjoin.similar_pairs(spark.createDataFrame([("A",)], "sequence string"), -1)


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], "read_idx long, sequence string")
    u = unique.unique_sequences(empty)
    assert u.count() == 0 and clusters.cluster(u, 1).count() == 0
    with_null = spark.createDataFrame([(1, None), (2, "AC"), (3, "")], "read_idx long, sequence string")
    assert {r.sequence for r in unique.unique_sequences(with_null).collect()} == {"AC", ""}
    assert {r.sequence for r in unique.unique_sequences(with_null, min_length=1).collect()} == {"AC"}


def test_gram_sets_never_part_near_strings(spark):
    """Strings made by up to d edits pass the filter, of any letters and lengths; most unrelated ones do not."""
    rng = random.Random(5)
    rows = []
    for _ in range(3000):
        letters, d = rng.choice(["ACGT", "AC", "ACGTN", "xyzé "]), rng.randint(0, 3)
        a = b = "".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 7, 25, 40])))
        for _ in range(d):
            i, kind = rng.randint(0, len(b)), rng.randint(0, 2)
            b = b[:i] + (rng.choice(letters) if kind else "") + b[i + (kind != 1) :]
        rows.append((a, b, d, "".join(rng.choices("ACGT", k=25)), "".join(rng.choices("ACGT", k=25))))
    df = spark.createDataFrame(rows, "a string, b string, d int, x string, y string")
    c = F.col
    near = [simjoin.may_be_near(simjoin.grams(c("a")), simjoin.grams(c("b")), d) for d in range(4)]
    back = [simjoin.may_be_near(simjoin.grams(c("a"), back=True), simjoin.grams(simjoin.revcomp(c("b"))), d) for d in range(4)]
    of = lambda each: F.element_at(F.array(*each), c("d") + 1)
    lost = df.where(~of(near) | ~of(back))
    assert lost.count() == 0
    assert df.where(simjoin.may_be_near(simjoin.grams(c("x")), simjoin.grams(c("y")), 2)).count() < len(rows) / 50


def _edited(rng, s, d, letters="ACGT"):
    for _ in range(d):
        i, kind = rng.randint(0, len(s)), rng.randint(0, 2)
        s = s[:i] + (rng.choice(letters) if kind else "") + s[i + (kind != 1) :]
    return s


@pytest.mark.parametrize("d", [0, 1, 2, 3, 4])
def test_strings_about_the_length_of_a_code_and_with_other_letters(spark, d):
    """Pairs of coded strings, of others, and of one of each; ids are kept, and each pair comes once."""
    rng = random.Random(d)
    comp = str.maketrans("ACGT", "TGCA")
    seqs = ["N" * 25, "", "A" * 31, "A" * 32, "AC" * 14]
    for n in (9, 25, 28, 29, 30, 31, 32, 33, 70):
        for letters in ("ACGT", "AC", "ACGTN"):
            s = "".join(rng.choices(letters, k=n))
            seqs += [s, s.translate(comp)[::-1]] + [_edited(rng, s, rng.randint(0, d + 1), letters) for _ in range(3)]
            seqs += [_edited(rng, s.translate(comp)[::-1], rng.randint(0, d), letters)]
    seqs = list(dict.fromkeys(seqs))
    want = {}
    for x, a in enumerate(seqs):
        for y, b in enumerate(seqs):
            if x < y and abs(len(a) - len(b)) <= d and (k := min(distance(a, b), distance(a, b.translate(comp)[::-1]))) <= d:
                want[x, y] = k
    u = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, sequence string")
    got = simjoin.similar_edges(u, d).collect()
    assert {(r.id_a, r.id_b): r.distance for r in got} == want and len(got) == len(want)


def test_places_beyond_a_long_are_made_distinct(spark, monkeypatch):
    rng = random.Random(2)
    seqs = list(dict.fromkeys(_edited(rng, "ACGGTTACAGGATCCATTAG", k % 4) for k in range(60)))
    u = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, sequence string")
    want = sorted(map(tuple, simjoin.similar_edges(u, 3).collect()))
    monkeypatch.setattr(simjoin.Join, "told", False)
    assert sorted(map(tuple, simjoin.similar_edges(u, 3).collect())) == want and len(want) > 100


def test_codes(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(2000):
        d = rng.randint(0, 3)
        a = "".join(rng.choices("ACGT", k=rng.choice([0, 1, 5, 20, 27])))
        b = _edited(rng, a, d)
        rows.append((min(a, b, key=len), max(a, b, key=len), d, "".join(rng.choices("ACGT", k=25)), "".join(rng.choices("ACGT", k=25))))
    df = spark.createDataFrame(rows, "a string, b string, d int, x string, y string")
    c = F.col
    assert df.where(simjoin.letters(simjoin.code(c("b")), F.length("b")) != c("b")).count() == 0
    assert df.where((simjoin.code(c("x")) < simjoin.code(c("y"))) != (c("x") < c("y"))).count() == 0

    def misses(a, b, d):
        """``unmatched`` as the join calls it, for each difference of lengths."""
        out = F.lit(None)
        for delta in range(d + 1):
            pad = (d - delta) // 2
            low = F.call_function("shiftleft", F.lit(1).cast("long"), 2 * F.length(a)) - 1
            n = simjoin.unmatched(simjoin.code(a), F.shiftleft(simjoin.code(b), 2 * pad), low.bitwiseAND(F.lit(0x5555555555555555)), F.lit(-1 if delta + 2 * pad < d else 0).cast("long"), d)
            out = F.when(F.length(b) - F.length(a) == delta, n).otherwise(out)
        return out

    for d in range(4):
        assert df.where((c("d") == d) & (misses(c("a"), c("b"), d) > d)).count() == 0
    assert df.where(misses(c("x"), c("y"), 2) <= 2).count() < len(rows) / 50


def test_nothing_is_shuffled_after_the_distance_is_known(spark, capsys):
    u = spark.createDataFrame([(k, s) for k, s in enumerate(["ACGTACGT", "ACGTACGA", "ACGTACG"])], "seq_id long, sequence string")
    simjoin.similar_edges(u, 1).explain()
    plan = capsys.readouterr().out
    assert "Exchange" in plan and plan.index("levenshtein") < plan.index("Join") < plan.index("Exchange") and "Cartesian" not in plan


def test_records_are_put_together_inside_splits(spark, tmp_path, capsys):
    """However lines are cut into splits and batches; no line is shuffled."""
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    old = {k: spark.conf.get(k) for k in names}
    rng = random.Random(3)
    reads = ["".join(rng.choices("ACGT", k=rng.choice([0, 3, 30, 120]))) for _ in range(60)]
    fastq(tmp_path / "a.fq", reads[:25])
    (tmp_path / "b.fq").write_bytes(b"".join(f"@r{i}\r\n{s}\r\n+\r\n@II\r\n".encode() for i, s in enumerate(reads[25:])) + b"@cut")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = scan.read_fastq(spark, str(tmp_path / "*.fq"))
        rows = got.collect()
        got.explain()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted((r.read_idx, r.sequence) for r in rows) == list(enumerate([*reads, ""]))
    assert [r.header for r in sorted(rows, key=lambda r: r.read_idx)] == [f"@r{i}" for i in range(25)] + [f"@r{i}" for i in range(35)] + ["@cut"]
    plan = capsys.readouterr().out
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


def test_length_tables_of_parts_and_of_single_files(spark, tmp_path, micro):
    """One job for all lengths; files and folders have the same lines in the same order, and replace older ones."""
    u = micro[1]
    for single in (True, False, False):
        found = sinks.write_length_tables(u, str(tmp_path / str(single)), single=single)
        assert found == sorted({len(r.sequence) for r in u.collect()})
        for n, path in scan.discover_lengths(spark, str(tmp_path / str(single))).items():
            own = sorted(((-r["count"], r.first_seen, r.sequence) for r in u.collect() if len(r.sequence) == n))
            files = [path] if single else sorted(str(p) for p in Path(path).glob("part-*"))
            lines = "".join(open(f, newline="").read() for f in files).split("\n")[:-1]
            assert lines == [f"# unique_sequences={len(own)}, total_reads={-sum(o[0] for o in own)}", "sequence\tcount\r"] + [f"{s}\t{-c}\r" for c, _, s in own]
            assert scan.unique_header(spark, path) == (len(own), -sum(o[0] for o in own))
