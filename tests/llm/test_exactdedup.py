import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import exactdedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    out = []
    for t, ids in groups.items():
        top = max(ids, key=lambda x: (x is not None, x or 0))
        kept = False
        for i in ids:
            now, kept = i == top and not kept, kept or i == top
            out.append((i, top, len(ids), now, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    got = exactdedup.deduplicate(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()], key=str)


def hostile():
    long_ = "Ab é😀" * 900
    texts = ["", None, "a", "A", "é", "É", "ab" * 8, "AB" * 8, "ab" * 8 + "c", long_, long_.upper(), long_[:-1], "x" * 16, "x" * 32, "x" * 48, "x" * 64 + "y", "y" + "x" * 64, "퟿\x00", "ß", "SS"]
    rows = [(k % 13 if k % 5 else None, t) for k, t in enumerate(texts * 4)]
    return rows + rows[:7] + [(-5, "alone"), (2**62, "a")]


@pytest.mark.parametrize("block", [16, exactdedup.BLOCK])
def test_brute_force(spark, block):
    assert run(spark, hostile(), block=block) == brute(hostile())


def test_blocks_that_share_a_route_are_named_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "route", lambda b: [F.octet_length(b), F.lit(0)])
    assert run(spark, hostile(), block=16) == brute(hostile())


def test_blocks_are_the_text(spark):
    d = spark.createDataFrame([("",), ("é" * 9,), ("a" * 8,)], "t string").select("t", exactdedup.cut(F.col("t").cast("binary"), 4).alias("b"))
    for r in d.collect():
        assert b"".join(r.b) == r.t.encode() and len(r.b) == max(1, -(-len(r.t.encode()) // 4)) and all(len(x) == 4 for x in r.b[:-1])


def test_empty_table_and_one_group(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "t")] * 500) == brute([(1, "t")] * 500)


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    d = spark.createDataFrame([(1, "a", "k", 7.0, [1], "z"), (2, "A", None, None, None, None)], "doc_id long, text string, Kept string, rid double, `a.b` array<int>, blocks string")
    got = exactdedup.deduplicate(d)
    assert got.columns == ["doc_id", "text", "rid", "a.b", "blocks", "keep_id", "group_size", "kept", "text_sha256"]
    assert {(r.doc_id, r.text, r.rid, r.blocks, r.keep_id, r.kept) for r in got.collect()} == {(1, "a", 7.0, "z", 2, False), (2, "A", None, None, 2, True)}


def test_native(spark, sf_dir, capsys):
    from lodestrand.llm import queries

    queries.queries()["op12_exact_dedup"](spark, sf_dir).explain()
    assert "Python" not in capsys.readouterr().out
