import hashlib
import random

import numpy as np

from lodestrand.llm import minhash, queries


def runs(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_query_against_the_definition(spark, sf_dir, oracle):
    d = oracle.execute("SELECT doc_id, text FROM documents ORDER BY doc_id DESC").fetchall()
    got = {r.doc_id: r for r in queries.op3_minhash(spark, sf_dir).collect()}
    assert len(got) == len(d)
    off = []
    for k, (i, t) in enumerate(d):
        t, nxt = t or "", d[(k + 1) % len(d)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for like, other in ((r.near_edited, e), (r.near_next, nxt)):
            a, b = runs(t), runs(other)
            off.append(like - (len(a & b) / len(a | b) if a | b else 1))
        assert r.fingerprint == minhash.text_fingerprint(t).hex() and r.edited_fingerprint == minhash.text_fingerprint(e).hex()
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.2


def test_likeness_is_unbiased():
    rng = np.random.default_rng(1)
    for size in (20, 200, 5000):
        for share in (0.1, 0.5, 0.8):
            off = []
            for _ in range(30):
                common, a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (int(size * share), size - int(size * share), size - int(size * share)))
                x, y = np.r_[common, a], np.r_[common, b]
                off.append(minhash.likeness(minhash.fingerprint_of(x), minhash.fingerprint_of(y)) - len(common) / (len(common) + len(a) + len(b)))
            assert abs(np.mean(off)) < 0.04, (size, share, np.mean(off))


def test_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RANGE_DOCS", 7)
    rng = random.Random(3)
    ids = rng.sample(range(-500, 500), 200)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.a, r.b) for r in minhash.with_next(df, lambda a, b: (a, b), "a string, b string").collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: (f"t{i}", f"t{order[(k + 1) % len(order)]}") for k, i in enumerate(order)}


def test_rows(spark):
    long_text = "word " * 100_000
    df = spark.createDataFrame([(3, None, 1), (2, "", 1), (1, long_text, 1), (1, long_text, 1), (None, "abc", 1)], "doc_id long, text string, a int")
    got = [(r.doc_id, r.a, r.b) for r in minhash.with_next(df, lambda a, b: (len(a), len(b)), "a long, b long").collect()]
    n = len(long_text)
    assert sorted(got, key=str) == sorted([(3, 0, 0), (2, 0, n), (1, n, n), (1, n, 0), (None, 3, 0)], key=str)
    assert minhash.with_next(df.limit(0), lambda a, b: (a,), "a string").count() == 0
    only_null = minhash.with_next(df.where("doc_id is null"), lambda a, b: (a, b), "a string, b string").collect()
    assert [(r.a, r.b) for r in only_null] == [("abc", "")]
    one = minhash.with_next(df.where("doc_id = 2"), lambda a, b: (a, b), "a string, b string").collect()
    assert [(r.a, r.b) for r in one] == [("", "")]
    prints = [r.minhash for r in minhash.fingerprint(df).collect()]
    assert prints.count(b"") == 2 and minhash.likeness(b"", b"") == 1 and minhash.likeness(b"", bytes(prints[-1])) == 0
