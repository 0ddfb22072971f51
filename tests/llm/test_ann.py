import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import ann, queries


def exact(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return ids[order], d[order]


def recall(rows, ids, x, queries_):
    hit = total = 0
    for q in queries_:
        want, d = exact(ids, x, q)
        got = sorted((r for r in rows if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(want) + 1))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        at = {i: k for k, i in enumerate(ids)}
        assert all(r.score == pytest.approx(np.sqrt(((x[at[r.vec_id]] - x[q]) ** 2).sum()), abs=1e-12) for r in got)
        hit += len(set(want) & {r.vec_id for r in got})
        total += len(want)
    return hit / total


def test_query_against_brute_force(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in d]), np.array([r.embedding for r in d], float)
    rows = queries.op5_ann(spark, sf_dir).collect()
    assert {r.query_id for r in rows} == set(ids[ids % 100 == 0])
    assert recall(rows, ids, x, np.flatnonzero(ids % 100 == 0)) >= 0.9


def test_clusters_long_lists_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (250, 12)) for c in rng.normal(0, 4, (6, 12))] + [np.full((500, 12), 1.5)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, F.col("vec_id") % 50 == 0, groups=4).collect()
    order = np.argsort(ids)
    assert recall(rows, ids[order], x[order], np.flatnonzero(ids[order] % 50 == 0)) >= 0.95


def test_tables_are_the_codes_distances():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    ix = ann.fit(x, 300, groups=4, codes=16)
    near = ix.lists(x, 1)[:, 0]
    r = x - ix.centroids[near]
    code = ix.encode(r)
    t = ix.tables(r[:5])
    for q in range(5):
        for e in range(20):
            back = np.concatenate([ix.codebooks[g][code[e, g]] for g in range(4)])
            assert t[q][np.arange(4), code[e]].sum() == pytest.approx(((r[q] - back) ** 2).sum())


def test_ties_go_to_smaller_ids():
    assert ann.best(np.array([1.0, 0.0, 1.0, 1.0]), np.arange(4), 3).tolist() == [1, 0, 2]
    assert ann.matrix(pa.array([[1.0, 2.0], [3.0, 4.0]]), 2).tolist() == [[1, 2], [3, 4]]


def test_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (100, [1.0, 1.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 100), (0, 2, 100), (0, 3, 1), (100, 1, 0), (100, 2, 1)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_outliers_alone_in_their_lists_get_all_ranks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (300, 8)), np.full((1, 8), 90.0)])
    index = ann.Index(np.stack([np.zeros(8), np.full(8, 60.0), np.full(8, 90.0)]), rng.normal(0, 1, (4, 16, 2)), [1])
    monkeypatch.setattr(ann, "fit", lambda *a, **how: index)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(ann.search(df, F.col("vec_id") == 300).collect(), np.arange(301), x, [300]) > 0


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1e-4, (600, 16)) for c in rng.normal(0, 3, (5, 16))] + [rng.normal(0, 3, (2000, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, (F.col("vec_id") < 3000) & (F.col("vec_id") % 60 == 0), groups=4, codes=16).collect()
    assert recall(rows, np.arange(len(x)), x, range(0, 3000, 60)) >= 0.95


def test_all_ties_of_the_last_are_ranked():
    assert ann.nearest(np.array([1.0, 0.0, 1.0, 1.0, 2.0]), 2).tolist() == [0, 1, 2, 3]


def test_small_remote_groups_get_all_ranks(spark):
    """Groups of one to five vectors far from tight clusters: their lists hold fewer than ten."""
    rng = np.random.default_rng(7)
    x = [rng.normal(c, 0.05, (400, 12)) for c in rng.normal(0, 1, (8, 12))]
    small = [rng.normal(c, 0.05, (1 + k % 5, 12)) for k, c in enumerate(rng.normal(0, 40, (25, 12)))]
    x = np.concatenate(x + small)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, F.col("vec_id") >= 3200, groups=4).collect()
    assert len(rows) == 10 * (len(x) - 3200) and recall(rows, np.arange(len(x)), x, range(3200, len(x))) >= 0.9


def test_each_density_has_its_recall(spark):
    """Tight clusters with most of the rows, vectors spread between them, near copies and remote groups: no kind is lost in the whole."""
    rng = np.random.default_rng(9)
    kinds = {
        "clustered": np.concatenate([rng.normal(c, 0.05, (250, 16)) for c in rng.normal(0, 1, (20, 16))]),
        "spread": rng.normal(0, 1, (700, 16)),
        "copies": np.concatenate([rng.normal(c, 1e-5, (60, 16)) for c in rng.normal(0, 1, (5, 16))]),
        "remote": np.concatenate([rng.normal(c, 0.3, (4, 16)) for c in rng.normal(0, 30, (20, 16))]),
    }
    x, kind = np.concatenate(list(kinds.values())), np.repeat(list(kinds), [len(v) for v in kinds.values()])
    at = rng.permutation(len(x))
    x, kind = x[at], kind[at]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(df, F.col("vec_id") % 20 == 0, groups=8, codes=64).collect()
    for name in kinds:
        assert recall(rows, np.arange(len(x)), x, [q for q in range(0, len(x), 20) if kind[q] == name]) >= 0.9, name
