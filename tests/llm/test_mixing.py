import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import mixing, queries


def water_fill(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by sharing the rest again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


def test_targets_equal_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 100, "c": 1000, None: 7, "é": 3, "Z": 50}, {"a": 5}, {"a": 0, "b": 9}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(water_fill(sizes))


def test_query_against_the_contract(spark, sf_dir, oracle):
    rows = oracle.execute("SELECT doc_id, source, text FROM documents").fetchall()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    total = defaultdict(int)
    for i in size:
        total[source[i]] += size[i]
    want = water_fill(total)
    got = queries.op4_mixing(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(size)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s)
    again = queries.op4_mixing(spark, sf_dir).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def spread(words, rest):
    """Each document's expectation by the definition: those of one or more are certain, the others share again."""
    p, certain = {}, set()
    while True:
        open_ = [i for i in words if i not in certain]
        factor = (rest - sum(words[i] for i in certain)) / (sum(words[i] ** 1.5 for i in open_) or 1)
        p = {i: 1.0 if i in certain else factor * words[i] ** 0.5 for i in words}
        over = [i for i in open_ if p[i] >= 1]
        if not over:
            return p
        certain.update(over)


def draws(df):
    return df.withColumn("bits", mixing.draw(7, F.col("doc_id")))


def test_documents_follow_the_pareto_order(spark):
    docs = [(i, "a" if i < 600 else "b", 1 + i % 13 + 5000 * (i % 100 == 7)) for i in range(700)]
    df = draws(spark.createDataFrame(docs, "doc_id long, source string, size long"))
    got = mixing.allocate(df, share=0.5).withColumn("u", mixing.unit(F.col("bits"))).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        sure = int(mine[0].target / mine[0].source_size + 1e-12)
        p = spread({r.doc_id: r["size"] for r in mine}, mine[0].target - sure * mine[0].source_size)
        assert {r.doc_id: r.expected for r in mine} == pytest.approx({i: sure + x for i, x in p.items()})
        assert all(r.copies == sure + 1 for r in mine if p[r.doc_id] == 1)
        rank = {r.doc_id: (r.u / (1 - r.u)) / (p[r.doc_id] / (1 - p[r.doc_id])) for r in mine if p[r.doc_id] < 1}
        drawn = [rank[r.doc_id] for r in mine if r.doc_id in rank and r.copies > sure]
        others = [rank[r.doc_id] for r in mine if r.doc_id in rank and r.copies == sure]
        assert not drawn or not others or max(drawn) < min(others)
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= max(r["size"] for r in mine if p[r.doc_id] < 1) / 2 + 1e-6
    assert any(len({round(r.expected, 6) for r in got if r.source == s}) > 5 for s in "ab")  # unequal


def test_documents_are_included_as_often_as_expected(spark):
    """The same 60 documents in 500 sources, each with draws of its own."""
    words = {i: 1 + (i * i) % 97 + 900 * (i == 11) for i in range(60)}
    df = draws(spark.range(500 * 60).select(F.col("id").alias("doc_id"), F.format_string("s%03d", F.floor(F.col("id") / 60)).alias("source"), (F.col("id") % 60).alias("k")))
    size = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    df = df.withColumn("size", size[F.col("k").cast("int")].cast("long"))
    got = mixing.allocate(df, weights=(1,), share=0.45).groupBy("k").agg(F.avg("copies").alias("mean"), F.first("expected").alias("expected")).collect()
    p = spread(words, 0.45 * sum(words.values()))
    assert {r.k: r.expected for r in got} == pytest.approx(p) and p[11] == 1 and min(p.values()) < 0.1 < 0.3 < sorted(p.values())[-2]
    for r in got:  # four standard errors, and the little that a fixed size takes from the stated probabilities
        assert abs(r["mean"] - r.expected) <= 4 * (max(r.expected * (1 - r.expected), 0.01) / 500) ** 0.5 + 0.02, (r, words[r.k])


def test_many_buckets_give_the_same_sample(spark, monkeypatch):
    docs = [(i, "ab"[i % 5 == 0], 1 + i % 17) for i in range(3000)]
    df = draws(spark.createDataFrame(docs, "doc_id long, source string, size long"))
    want = {(r.doc_id, r.copies) for r in mixing.allocate(df).collect()}
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    assert {(r.doc_id, r.copies) for r in mixing.allocate(df).collect()} == want


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, 0), (2, "", "a", 1), (3, "x " * 100_000, "a", 2), (4, "x y", "b", 3), (4, "x y", "b", 3), (4, "z", "b", 4), (None, "q r s", "b", 5)],
        "doc_id long, text string, source string, copies int",
    )
    got = mixing.mix(df).collect()
    assert len(got) == 7 and all(r.taken <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r.doc_id in (1, 2)} == {0}
    s = mixing.sample(df)
    assert s.columns == df.columns
    by = defaultdict(int)
    for r in got:
        by[r.doc_id] += r.copies if r["size"] else 1
    out = defaultdict(int)
    for r in s.collect():
        out[r.doc_id] += 1
    assert {k: v for k, v in by.items() if v} == dict(out)
    texts = defaultdict(set)
    for r in s.collect():
        texts[r.doc_id].add(r.text)
    assert texts[4] <= {"x y", "z"} and all(r.copies == {"x y": 3, "z": 4}[r.text] for r in s.collect() if r.doc_id == 4)
    clash = df.withColumn("_mix_id", F.lit(1)).withColumn("_MIX_rows", F.create_map(F.lit("a"), F.lit(1))).withColumn("bits", F.lit("x"))
    assert mixing.sample(clash).columns == clash.columns and mixing.sample(clash).count() == s.count()
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.sample(df.limit(0)).count() == 0
