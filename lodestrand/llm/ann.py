"""Approximate nearest neighbours: inverted lists, product quantisation, exact reranking.

A bounded sample fits coarse centroids and, for the residuals, a codebook in each
group of dimensions.  Every vector is indexed: it is put in the list of its
nearest centroid with the code of its residual.  A query probes the lists whose
centroids are nearest, less a share of their radius, and more until they hold as
many candidates as are wanted.  How many depends on how sparse the space is around
the query: the sample is cut into strata by the distance at which the lists promise
neighbours, and each stratum gets the number that finds its own queries' neighbours.
In each block of a list the query's asymmetric distance
tables rank all entries by their codes; the best, as many as the sample needs and
all that tie with the last, are ranked again by the exact distance of the original vectors, which lie in the block, and blocks are merged.
Long lists are dealt over blocks of bounded size, to all of which a query goes,
and the queries of a list that many ask for over parts of bounded size.

Rows: null vectors, zero vectors, those with null or non-finite components and
those whose length is not the most frequent one take no part, nor do null ids.
Equal vectors are ranked by id.  A table without vectors gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize, ship
from .common import slices

#: Rows that the model is fitted on, at most; most lists; rows of a block; queries of a block.
FIT_ROWS, MOST_LISTS, BLOCK_ROWS, BLOCK_QUERIES = 20_000, 4_096, 20_000, 5_000
#: Rows of a distance table that is held at once.
CHUNK = 2_048


@dataclass
class Index:
    centroids: np.ndarray  # lists x dims
    codebooks: np.ndarray  # groups x codes x dims of a group
    probes: Sequence[int] = (1,)  # lists to probe, by stratum
    depth: Sequence[int] = (1,)  # entries of a block to be ranked by exact distances, by stratum
    radii: np.ndarray | None = None  # of the lists, root mean squares
    lean: float = 0.0  # share of its radius by which a list is nearer than its centroid
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of the strata

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None, :] - 2 * x @ self.centroids.T))

    def lists(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists of each row, nearest first."""
        d = self.distances(x)
        if self.lean:
            d -= self.lean * self.radii
        if k >= d.shape[1]:
            return np.argsort(d, axis=1, kind="stable")
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)

    def promised(self, x: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        """How far, in the mean, members of the lists are that hold k entries soonest."""
        out = []
        for i in range(0, len(x), 256):
            far = self.distances(x[i : i + 256]) ** 2 + self.radii**2
            order = np.argsort(far, axis=1)
            enough = (held[order].cumsum(1) < k).sum(1).clip(max=far.shape[1] - 1)
            out.append(np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0])
        return np.sqrt(np.concatenate(out or [np.zeros(0)]))

    def strata(self, x: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        if not len(self.edges):
            return np.zeros(len(x), int)
        return np.searchsorted(self.edges, self.promised(x, held, k), side="right")

    def probed(self, x: np.ndarray, strata: np.ndarray, held: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
        """The nearest lists of each row: as many as its stratum probes, and as many more as hold ``need`` entries in all."""
        out: list = [None] * len(x)
        for i in range(0, len(x), 256):
            for r, ls in enumerate(self.lists(x[i : i + 256], len(held)), i):
                out[r] = ls[: max(self.probes[strata[r]], int(np.searchsorted(held[ls].cumsum(), need[r])) + 1)]
        return out

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        g, c, w = self.codebooks.shape
        out = np.empty((len(residuals), g), np.uint8)
        for k in range(g):
            r = residuals[:, k * w : (k + 1) * w]
            out[:, k] = ((self.codebooks[k] ** 2).sum(1)[None, :] - 2 * r @ self.codebooks[k].T).argmin(1)
        return out

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each residual's groups to all codes: rows x groups x codes."""
        g, c, w = self.codebooks.shape
        r = residuals.reshape(len(residuals), g, 1, w)
        return ((r - self.codebooks[None]) ** 2).sum(-1)


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of ``c`` to each of ``x``, a chunk of the distances at a time."""
    norm = (c**2).sum(1)[None, :]
    return np.concatenate([(norm - 2 * x[i : i + CHUNK] @ c.T).argmin(1) for i in range(0, len(x), CHUNK)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = closest(x, c)
        order = np.argsort(near, kind="stable")
        full, first = np.unique(near[order], return_index=True)
        c[full] = np.add.reduceat(x[order], first, axis=0) / np.bincount(near, minlength=k)[full, None]
        empty = np.setdiff1d(np.arange(k), full)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


#: Shares of the sample at which strata end, and queries of each that are looked at.
STRATA, STRATUM_QUERIES = (0.25, 0.5, 0.75, 0.9, 0.96, 0.99), 100


def fit(sample: np.ndarray, rows: int, *, groups: int = 16, codes: int = 256, recall: float = 0.97, seed: int = 5, k: int = 10) -> Index:
    """An index over about ``rows`` vectors from a sample of them.

    As many lists are probed as find the share ``recall`` of the sample's own
    exact neighbours, in each stratum; those of the whole table are nearer and easier.
    """
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    dims = x.shape[1]
    while dims % groups:
        groups -= 1
    lists = int(min(MOST_LISTS, max(1, round(rows**0.5)), max(1, len(x) // 8)))
    centroids = kmeans(x, lists, 8, rng)
    near = closest(x, centroids)
    res, w = x - centroids[near], dims // groups
    books = np.stack([kmeans(res[:, g * w : (g + 1) * w], min(codes, len(x)), 6, rng) for g in range(groups)])
    held = np.bincount(near, minlength=lists)
    radii = np.sqrt(np.bincount(near, (res**2).sum(1), lists) / np.maximum(held, 1))
    index = Index(centroids, books, (lists,), (1,), radii)
    if len(x) < 2:
        return index
    far = index.promised(x, held, k)
    index.edges = np.unique(np.quantile(far, STRATA))
    strata = np.searchsorted(index.edges, far, side="right")
    some, best_ = [], []
    for i in range(len(index.edges) + 1):
        own = np.flatnonzero(strata == i)
        own = rng.choice(own, min(len(own), STRATUM_QUERIES), replace=False) if len(own) else own
        d = (x**2).sum(1)[None, :] - 2 * x[own] @ x.T
        d[np.arange(len(own)), own] = np.inf
        some.append(own)
        best_.append(np.argsort(d, axis=1)[:, : min(k, len(x) - 1)])

    def needed(lean: float) -> list[int]:
        """Lists that each stratum must probe, of those with entries, if lists are nearer by this share of their radius."""
        index.lean, out = lean, []
        for own, b in zip(some, best_):
            place = np.argsort(index.lists(x[own], lists), axis=1)  # of each list in the query's order
            found = np.sort(np.take_along_axis(place, near[b], 1).ravel())
            out.append(int(found[min(len(found) - 1, int(recall * len(found)))]) + 1 if len(found) else 1)
        return out

    share = np.bincount(strata, minlength=len(some)) / len(x)
    index.probes, index.lean = min(((needed(lean), lean) for lean in (0.0, 0.5, 1.0)), key=lambda t: (np.dot(share, t[0]), t[1]))
    index.depth = [depth(index, x, near, own, b, recall, max(1.0, rows / len(x))) if len(own) else 1 for own, b in zip(some, best_)]
    return index


def depth(index: Index, x: np.ndarray, near: np.ndarray, some: np.ndarray, best_: np.ndarray, recall: float, scale: float) -> int:
    """How many entries of a list to rank exactly, so that its share ``recall`` of neighbours is among them."""
    code = index.encode(x - index.centroids[near]).astype(np.intp)
    at, ahead = np.arange(code.shape[1]), []
    for i in np.unique(near[best_]):
        rows = np.flatnonzero(near == i)
        for r in np.flatnonzero((near[best_] == i).any(1)):
            t = index.tables((x[some[r]] - index.centroids[i])[None])[0]
            approx = t[at, code[rows]].sum(1)
            wanted = np.isin(rows, best_[r])
            ahead += np.searchsorted(np.sort(approx), approx[wanted]).tolist()
    ahead.sort()
    return int(np.ceil(scale * (ahead[min(len(ahead) - 1, int(recall * len(ahead)))] + 1)))


def usable(v: Column) -> Column:
    """Whether a vector takes part, its length apart."""
    x = lambda f: F.forall(v, f)
    finite = x(lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0), F.lit(False))


def vectors(df: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension (0: none)."""
    d = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null").where(usable(F.col("v")))
    top = d.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (d.where(F.size("v") == top.n), top.n) if top else (d, 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best(approx: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties to smaller ids; ``ids`` ascend."""
    if len(approx) <= k:
        return np.arange(len(approx))
    limit = np.partition(approx, k - 1)[k - 1]
    less = np.flatnonzero(approx < limit)
    return np.concatenate([less, np.flatnonzero(approx == limit)[: k - len(less)]])


def nearest(approx: np.ndarray, k: int) -> np.ndarray:
    """Positions of all that are not above the k-th smallest."""
    return np.arange(len(approx)) if len(approx) <= k else np.flatnonzero(approx <= np.partition(approx, k - 1)[k - 1])


def search(df: DataFrame, queries: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, rerank: int = 100, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query row.

    ``queries`` is a condition on ``df``; the query's own row is no candidate.
    Repeated ids are each candidates; a query with a repeated id is searched once,
    by its smallest vector.
    """
    spark = df.sparkSession
    ship(spark)
    q, dims = vectors(df.where(queries), vec_id, vector)
    all_, dims = vectors(df, vec_id, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    q = q.where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    n = all_.count()
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(17), "id", "v"), 33) / F.lit(float(1 << 31))
    sample = np.array([r.v for r in all_.where(slot < min(1.0, FIT_ROWS / n)).select("v").limit(2 * FIT_ROWS).collect()])
    if not len(sample):
        sample = np.array([r.v for r in all_.select("v").limit(100).collect()])
    index = fit(sample, n, k=k, **how)
    shared = spark.sparkContext.broadcast(index)  # bounded by FIT_ROWS and MOST_LISTS

    def assign(batches):
        ix = shared.value
        for b in (x for batch in batches for x in slices(batch)):
            x = matrix(b.column(1), dims)
            near = closest(x, ix.centroids)
            code = ix.encode(x - ix.centroids[near])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "v", "list", "code"])

    entries = materialize(all_.mapInArrow(assign, "id long, v array<double>, list int, code binary"), "ann-index")
    sizes = {r.list: r["count"] for r in entries.groupBy("list").count().collect()}  # MOST_LISTS rows at most
    blocks = {i: -(-s // BLOCK_ROWS) for i, s in sizes.items()}

    alive = np.array(sorted(sizes))
    held = np.array([sizes[i] for i in alive.tolist()])

    def probe(batches):
        ix = shared.value
        full = replace(ix, centroids=ix.centroids[alive], radii=None if ix.radii is None else ix.radii[alive])  # empty lists are no probes
        for b in (x for batch in batches for x in slices(batch)):
            x = matrix(b.column(1), dims)
            strata = full.strata(x, held, k)
            near = full.probed(x, strata, held, k + b.column(2).to_numpy())
            at = [(r, int(alive[i]), s) for r in range(len(near)) for i in near[r] for s in range(blocks[int(alive[i])])]
            c = b.take(pa.array([r for r, _, _ in at], pa.int64()))
            yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([i for _, i, _ in at], pa.int32()), pa.array([s for _, _, s in at], pa.int32()), pa.array([strata[r] for r, _, _ in at], pa.int32())], names=["q", "qv", "list", "block", "stratum"])

    def parts_of(parts: dict[int, int]) -> Column:
        many = [F.lit(x) for i, n_ in parts.items() if n_ > 1 for x in (i, n_)]
        return F.coalesce(F.element_at(F.create_map(*many), F.col("list")), F.lit(1)) if many else F.lit(1)

    probes = materialize(q.select("id", "v", "own").mapInArrow(probe, "q long, qv array<double>, list int, block int, stratum int"), "ann-probes")
    # both sides of a list are dealt: its vectors over blocks, to all of which a query goes, and its queries over parts, to all of which a vector goes
    asked = {r.list: r["count"] for r in probes.where("block = 0").groupBy("list").count().collect()}
    parts = parts_of({i: -(-n_ // BLOCK_QUERIES) for i, n_ in asked.items()})
    probes = probes.withColumn("part", F.pmod(F.xxhash64("q"), parts).cast("int"))
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("id"), parts_of(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def scan(e: pa.Table, p: pa.Table) -> pa.Table:
        ix = shared.value
        out = {"query_id": [], "vec_id": [], "score": []}
        if e.num_rows and p.num_rows:
            e = e.sort_by("id")
            ids, x = e.column("id").to_numpy(), matrix(e.column("v").combine_chunks(), dims)
            code = np.frombuffer(b"".join(e.column("code").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.intp)
            center = ix.centroids[e.column("list")[0].as_py()]
            qs, qv = p.column("q").to_numpy(), matrix(p.column("qv").combine_chunks(), dims)
            depths = np.array(ix.depth)[p.column("stratum").to_numpy()]
            for i in range(0, len(qs), 64):
                tables = ix.tables(qv[i : i + 64] - center)
                for query, v, t, deep in zip(qs[i : i + 64], qv[i : i + 64], tables, depths[i : i + 64]):
                    approx = t[0][code[:, 0]]
                    for g in range(1, code.shape[1]):
                        approx = approx + t[g][code[:, g]]
                    approx[ids == query] = np.inf
                    top = nearest(approx, max(rerank, int(deep)))
                    top = top[ids[top] != query]
                    exact = np.sqrt(((x[top] - v) ** 2).sum(1))
                    top_k = np.lexsort((ids[top], exact))[:k]
                    out["query_id"] += [int(query)] * len(top_k)
                    out["vec_id"] += ids[top][top_k].tolist()
                    out["score"] += exact[top_k].tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = dealt.groupBy("list", "block", "part").cogroup(probes.groupBy("list", "block", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
