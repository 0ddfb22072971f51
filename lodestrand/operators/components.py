"""Connected components by randomised contraction, and the disjoint sets built on it.

A round maps each node to the neighbour, or itself, whose hash of that round is
least, and replaces the ends of every link by what they were mapped to: links
inside a group vanish, and with them every component that is done.  A constant
share of the nodes goes in each round, whatever the shape of the graph; in dense
clusters nearly all do.  Once few links are left, one task settles them.  The
maps of the rounds are then composed, the last first.

Rounds group by min() and join only.  They are written to the shared folder, so
plans do not grow and a lost executor costs one round at most.  A node with very
many links is pre-aggregated, and its links meet its row where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import bucketed, discard, materialize, ship

#: Links that one task settles; of more, a node with so many, and with more than its share of all, is a hub.
LOCAL, HUB, HUBS = 50_000, 200, 500


def _counted(rows: DataFrame, name: str, what: Column) -> tuple[DataFrame, int]:
    """Rows, written, and a figure of them that is taken on the way."""
    seen = Observation()
    done = materialize(rows.observe(seen, what.alias("n")), name)
    return done, seen.get["n"] or 0


def _moved(links: DataFrame, end: str, to: DataFrame, hub: int | None) -> DataFrame:
    """Links whose ``end`` is replaced by what the map (id, to, links) says of it.

    Nodes with more than ``hub`` links are few, as they have a share of all; their
    rows are broadcast, so the links of a hub stay in the tasks that read them.
    """
    rest = [c for c in links.columns if c != end]
    met = lambda d, m: d.join(m, d[end] == m["id"]).select(*rest, F.col("to").alias(end))
    row = to.select("id", "to")
    if hub is None:
        return met(links, row)
    hubs = F.broadcast(row.where(to["links"] > hub))
    others = links.join(hubs.select(F.col("id").alias(end)), end, "left_anti")
    return met(links, hubs).unionByName(met(others, row.where(to["links"] <= hub)))


def _contracted(links: DataFrame, to: DataFrame, hub: int | None) -> DataFrame:
    """Links (u, v, ...) between what their ends were mapped to, u > v; those within a group are gone."""
    both = _moved(_moved(links, "u", to, hub), "v", to, hub).where("u <> v")
    rest = [c for c in links.columns if c not in ("u", "v")]
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), *rest)


def _both_ways(links: DataFrame) -> DataFrame:
    rest = [c for c in links.columns if c not in ("u", "v")]
    return links.select("u", "v", *rest).union(links.select("v", "u", *rest))


def _least_hash(links: DataFrame, turn: int) -> DataFrame:
    """(id, to, links): each node with the neighbour, or itself, of least hash in this turn."""
    of = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("x"))
    near = _both_ways(links).groupBy("u").agg(F.min(of("v")).alias("least"), F.count("*").alias("links"))
    return near.select(F.col("u").alias("id"), F.least("least", of("u"))["x"].alias("to"), "links")


class Forest(dict):
    """Union by smaller root, with paths halved."""

    def find(self, x):
        up = self.setdefault(x, x)
        while up != x:
            self[x] = over = self[up]
            x, up = over, self[over]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self[max(a, b)] = min(a, b)
        return True


def _settled(links: DataFrame) -> DataFrame:
    """(id, to): the smallest node that each node reaches, by one task; for few links only."""
    ship(links.sparkSession)
    kind = links.schema["u"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, to = Forest(), None
        for batch in batches:
            to = batch.schema.field("u").type
            for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                forest.join(a, b)
        if forest:
            nodes = list(forest)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, to), pa.array([forest.find(x) for x in nodes], to)], ["id", "to"])

    return links.select("u", "v").coalesce(1).mapInArrow(run, f"id {kind.simpleString()}, to {kind.simpleString()}")


def _composed(maps: list[DataFrame]) -> DataFrame:
    """(id, to): where the maps (id, to) of the rounds lead the nodes of the first."""
    out = maps[-1].select("id", "to")
    for m in reversed(maps[:-1]):
        up = out.select(F.col("id").alias("to"), F.col("to").alias("up"))
        out = m.select("id", "to").join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"))
    return out


def stars(edges: DataFrame, a: str = "id_a", b: str = "id_b", *, most_rounds: int = 60, local: int | None = None) -> DataFrame:
    """(id, component): for each node of ``edges``, loops apart, the smallest node it reaches.

    ``local`` is the number of links that one task may settle.
    """
    local = LOCAL if local is None else local
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    cur, rows = _counted(cur, "links", F.count("*"))
    maps: list[DataFrame] = []
    while rows > local:
        if len(maps) == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        to, most = _counted(_least_hash(cur, len(maps)), "map", F.max("links"))
        maps.append(to)
        hub = max(HUB, 2 * rows // HUBS)
        before = cur
        cur, rows = _counted(_contracted(cur, to, hub if most > hub else None).distinct(), "links", F.count("*"))
        discard(before)
    last = materialize(_settled(cur), "map")
    if not maps:
        return last.withColumnRenamed("to", "component")  # roots are the smallest already
    found = materialize(_composed([*maps, last]), "labels")
    # which node of its component a root is depends on the hashes; the smallest gives the name
    names = materialize(found.groupBy("to").agg(F.min("id").alias("component")), "names")
    return found.join(names, "to").select("id", "component")


def connected_components(vertices: DataFrame, edges: DataFrame, *, strict: bool = True) -> DataFrame:
    """(id, component) of every vertex (id); one without edges is its own component.

    An edge to a missing vertex is an error, or with ``strict=False`` is ignored.
    """
    v = vertices.select("id")
    e = edges.select("id_a", "id_b")
    if not strict:
        e = e.join(v.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(v.withColumnRenamed("id", "id_b"), "id_b", "left_semi").select("id_a", "id_b")
    found = stars(e)
    if strict:
        lost = found.join(v, "id", "left_anti").limit(1).collect()
        if lost:
            raise IndexError(f"edge to id {lost[0].id}, which is no vertex")
    return v.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# -- unions in order ---------------------------------------------------------


def _merged(links: DataFrame) -> DataFrame:
    """(id, to, at) of links (u, v, at), by one task, in order of ``at``: roots, and of the links that joined two sets, which have no id, their ``at``."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((at, a, b) for batch in batches for at, a, b in zip(batch["at"].to_pylist(), batch["u"].to_pylist(), batch["v"].to_pylist()))
        forest = Forest()
        joined = [at for at, a, b in rows if forest.join(a, b)]
        nodes, none = list(forest), [None] * len(joined)
        columns = [nodes + none, [forest.find(x) for x in nodes] + none, [None] * len(nodes) + joined]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "to", "at"])

    return links.select("u", "v", "at").coalesce(1).mapInArrow(run, "id long, to long, at long")


def _first_links(links: DataFrame, turn: int) -> DataFrame:
    """(id, to, links, at): nodes that fell on tails in this turn and whose first link leads to heads follow it; other nodes stay."""
    heads = lambda c: F.xxhash64(F.lit(turn), c) % 2 == 0
    near = _both_ways(links).groupBy("u").agg(F.min(F.struct("at", F.col("v").alias("x"))).alias("first"), F.count("*").alias("links"))
    goes = ~heads("u") & heads("first.x")
    return near.select(F.col("u").alias("id"), F.when(goes, F.col("first.x")).otherwise(F.col("u")).alias("to"), "links", F.when(goes, F.col("first.at")).alias("at"))


def union_in_order(links: DataFrame, *, most_rounds: int = 200, local: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, to) of the nodes that have a smaller one, and (at) of the links that join two sets when taken one by one in order of ``at``.

    ``links`` has (u, v, at), u <> v and ``at`` without repetitions.  Those links are
    the minimum spanning forest: the first link of any node belongs to it, so nodes
    are contracted along their first links until few links are left.
    """
    local = LOCAL if local is None else local
    cur, rows = _counted(links.select("u", "v", "at"), "links", F.count("*"))
    maps: list[DataFrame] = []
    while rows > local:
        if len(maps) == most_rounds:
            raise RuntimeError(f"unions did not settle in {most_rounds} rounds")
        to, most = _counted(_first_links(cur, len(maps)), "map", F.max("links"))
        maps.append(to)
        hub = max(HUB, 2 * rows // HUBS)
        # of parallel links only the first can join anything
        cur, rows = _counted(_contracted(cur, to, hub if most > hub else None).groupBy("u", "v").agg(F.min("at").alias("at")), "links", F.count("*"))
    last = materialize(_merged(cur), "map")
    roots, joined = last.where("id is not null").select("id", "to"), last.where("at is not null").select("at")
    for m in maps:
        joined = joined.unionByName(m.where("at is not null").select("at"))
    if maps:
        found = materialize(_composed([*maps, roots]), "labels")
        names = materialize(found.groupBy("to").agg(F.min("id").alias("name")), "names")
        roots = found.join(names, "to").select("id", F.col("name").alias("to"))
    return roots.where("id <> to"), joined


class DisjointSets:
    """Sets of the numbers below ``n``, named by their smallest one; unions are batches of edges.

    Only numbers that are not their set's name are stored, with what they were
    merged into, in tables bucketed by number: one for each batch, whose rows are
    the sets that the batch merged.  A number's set is found by looking it up in
    one table after another; when they are many they are folded into one.
    """

    #: Tables above which they are folded, and buckets of a table.
    MANY, BUCKETS = 6, 16

    def __init__(self, spark, n: int):
        if n < 0:
            raise ValueError("n must not be negative")
        self.spark, self.n = spark, n
        self._tables: list[DataFrame] = []

    def _resolved(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the numbers of ``column`` replaced by their sets' names."""
        rest = [c for c in df.columns if c != column]
        for t in self._tables:
            df = df.join(t.select(F.col("id").alias(column), F.col("to").alias("_to")), column, "left").select(*rest, F.coalesce("_to", column).alias(column))
        return df

    def _add(self, moved: DataFrame) -> None:
        self._tables.append(bucketed(moved.select("id", "to"), "sets", ["id"], self.BUCKETS))
        if len(self._tables) > self.MANY:
            folded, later = None, list(self._tables)
            while later:
                first, *later = later
                self._tables = later
                part = self._resolved(first, "to").select("id", "to")
                folded = part if folded is None else folded.unionByName(part)
            self._tables = [bucketed(folded, "sets", ["id"], self.BUCKETS)]

    def update(self, edges: DataFrame, offset_a: int = 0, offset_b: int = 0, *, order: list[str] | None = None) -> DataFrame:
        """Join the sets of each edge (id_a, id_b), each end moved by its offset; (id_a, id_b, merged) of the moved edges.

        ``merged`` says whether the edge joined two sets, when edges are taken one by
        one in order of the columns ``order``, by default of their ends, and equal ones anyhow.
        """
        e = edges.select((F.col("id_a") + offset_a).alias("id_a"), (F.col("id_b") + offset_b).alias("id_b"), *[F.col(c).alias(f"_{k}") for k, c in enumerate(order or [])])
        by = [f"_{k}" for k in range(len(order or []))] or ["id_a", "id_b"]
        wrong = Observation()
        outside = lambda c: ~F.coalesce((F.col(c) >= 0) & (F.col(c) < self.n), F.lit(False))
        e = e.orderBy(*by).select("id_a", "id_b", F.monotonically_increasing_id().alias("at"))
        e = materialize(e.observe(wrong, F.max(F.when(outside("id_a") | outside("id_b"), F.struct("id_a", "id_b"))).alias("bad")), "unions")
        if bad := wrong.get["bad"]:
            raise IndexError(f"edge {bad['id_a']}, {bad['id_b']} is out of range")
        links = self._resolved(self._resolved(e.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), "at"), "u"), "v").where("u <> v")
        moved, joined = union_in_order(links)
        self._add(moved)
        return e.join(joined.withColumn("merged", F.lit(True)), "at", "left").select("id_a", "id_b", F.coalesce("merged", F.lit(False)).alias("merged"))

    def union(self, a: int, b: int) -> bool:
        """Join the sets of two numbers; whether they were apart."""
        at = self.find_all([a, b])
        if at[a] == at[b]:
            return False
        low, high = sorted((at[a], at[b]))
        self._add(self.spark.createDataFrame([(high, low)], "id long, to long"))
        return True

    def find(self, x: int) -> int:
        return self.find_all([x])[x]

    def find_all(self, xs: list[int]) -> dict[int, int]:
        """The set's name for each of some numbers, in one job."""
        for x in xs:
            if not 0 <= x < self.n:
                raise IndexError(x)
        asked = self.spark.createDataFrame([(x, x) for x in set(xs)], "id long, component long")
        return {r.id: r.component for r in self._resolved(asked, "component").collect()}

    def components(self) -> DataFrame:
        """(id, component) of every number."""
        return self._resolved(self.spark.range(self.n).select("id", F.col("id").alias("component")), "component").select("id", "component")
