"""Order-dependent Hamming grouping, without a sequential loop.

Reads arrive in the order of ``first_seen``.  *Seen* grouping: a read joins the
group of its first neighbour, in generation order, that came before it.  *Ball*
grouping: a read that no earlier expander's ball holds claims its own ball; a
claimed read joins its earliest claimer; an expander joins the owner of the first
string of its ball that was claimed before.  Both are parent pointers over the
uniques, and the group is the root that pointer jumping finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import ALPHABET, NEIGHBOUR_ORDER, generation_key, hamming_neighbors, is_valid, mismatches, parts, piece
from ..storage import discard, materialize, ship
from . import simjoin
from .components import LOCAL
from .simjoin import CODED, code, salted_join


def _coded(s: Column | str) -> Column:
    """The packed code of a string, null for one that has none."""
    return F.when(is_valid(s) & (F.length(s) <= CODED), code(F.col(s) if isinstance(s, str) else s))


def hamming_pairs(uniques: DataFrame, r: int) -> DataFrame:
    """(s, s_seen, t, t_seen): strings of one length within ``r`` mismatches, s after t.

    Joined on the r + 1 parts of which one is untouched; frequent parts are salted.
    Mismatches of packed strings are counted by XOR.  Of the parts that a pair
    shares the first one keeps it, so pairs need not be made distinct.
    """
    seen = Observation()
    u = uniques.select("sequence", "first_seen", F.length("sequence").alias("n"), _coded("sequence").alias("code"))
    u = materialize(u.observe(seen, F.count("*").alias("n")), "strings")
    rows = _seeds(u, r)
    return _met(rows, rows, r, seen.get["n"] > simjoin.HOT_SEED).where("s_seen > t_seen").select("s", "s_seen", "t", "t_seen")


def new_pairs(new: DataFrame, old: DataFrame, r: int) -> DataFrame:
    """(s, t): strings (sequence) within ``r`` mismatches of which one is new, s, and the other old, or both are new and s is the greater."""
    told = lambda d: d.select("sequence", F.lit(None).cast("long").alias("first_seen"), F.length("sequence").alias("n"), _coded("sequence").alias("code"))
    u, rest = _seeds(told(new), r), _seeds(told(old), r)
    return _met(u, rest, r, True).select("s", "t").unionByName(_met(u, u, r, True).where("s > t").select("s", "t"))


def _seeds(u: DataFrame, r: int) -> DataFrame:
    rows = u.select("*", F.explode(parts(F.col("n"), r + 1)).alias("p"))
    return rows.select("sequence", "first_seen", "code", "n", F.col("p.part").alias("part"), piece(F.col("sequence"), F.col("p.st"), F.col("p.sz")).alias("seed"))


def _met(s: DataFrame, t: DataFrame, r: int, salted: bool) -> DataFrame:
    """(s, s_seen, t, t_seen, ...) of seeds that meet and whose strings are within ``r`` mismatches, each pair once; equal strings too."""
    s = s.withColumnsRenamed({"sequence": "s", "first_seen": "s_seen", "code": "s_code"})
    t = t.withColumnsRenamed({"sequence": "t", "first_seen": "t_seen", "code": "t_code"})
    key = ["n", "part", "seed"]
    pairs = salted_join(s, t, key, "s", "t") if salted else s.join(t, key)
    differs = F.col("s_code").bitwiseXOR(F.col("t_code"))
    packed = F.bit_count(differs.bitwiseOR(F.shiftright(differs, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    pairs = pairs.where(F.coalesce(packed, F.size(mismatches(F.col("s"), F.col("t")))) <= r)
    earlier = F.lit(False)
    for k in range(r):
        at = parts(F.col("n"), r + 1)[k]
        earlier |= (F.col("part") > k) & (piece(F.col("s"), at["st"], at["sz"]) == piece(F.col("t"), at["st"], at["sz"]))
    return pairs.where(~earlier)


def _tops(parents: DataFrame) -> DataFrame:
    """(sequence, root) of (sequence, parent), by one task; for few rows only."""
    ship(parents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = {a: b for batch in batches for a, b in zip(batch["sequence"].to_pylist(), batch["parent"].to_pylist())}
        tops: dict = {}
        for x in up:
            way = []
            while x in up and x not in tops:
                way.append(x)
                x = up[x]
            tops.update(dict.fromkeys(way, tops.get(x, x)))
        yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.string()), pa.array(list(tops.values()), pa.string())], ["sequence", "root"])

    return parents.select("sequence", "parent").coalesce(1).mapInArrow(run, "sequence string, root string")


def roots(uniques: DataFrame, parents: DataFrame, *, local: int | None = None) -> DataFrame:
    """(sequence, root) from parents (sequence, parent); one without a parent is a root.

    Few parents are followed by one task, more by pointer jumping.
    """
    seen = Observation()
    parents = materialize(parents.select("sequence", "parent").observe(seen, F.count("*").alias("n")), "parents")
    if seen.get["n"] <= (LOCAL if local is None else local):
        found = materialize(_tops(parents), "roots")
        return uniques.select("sequence").join(found, "sequence", "left").select("sequence", F.coalesce("root", "sequence").alias("root"))
    cur = uniques.select("sequence").join(parents, "sequence", "left").select("sequence", F.coalesce("parent", "sequence").alias("root"))
    cur = materialize(cur, "roots")
    while True:
        up = cur.select(F.col("sequence").alias("root"), F.col("root").alias("up"))
        nxt = cur.join(up, "root").select("sequence", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
        moved = Observation()  # counted while the step is written
        old, cur = cur, materialize(nxt.observe(moved, F.count_if("moved").alias("n")).select("sequence", "root"), "roots")
        discard(old)
        if not moved.get["n"]:
            return cur


def _grouped(uniques: DataFrame, rooted: DataFrame) -> DataFrame:
    seen = uniques.select(F.col("sequence").alias("root"), F.col("first_seen").alias("root_first_seen"))
    return uniques.join(rooted, "sequence").join(seen, "root")


def greedy_seen(uniques: DataFrame, r: int = 1) -> DataFrame:
    """uniques (sequence, count, first_seen) with (root, root_first_seen): only observed strings are looked up."""
    _check(r)
    uniques = materialize(uniques, "uniques")  # read several times
    return seen_groups(uniques, hamming_pairs(uniques, r))


def seen_groups(uniques: DataFrame, near: DataFrame) -> DataFrame:
    """``greedy_seen`` of uniques whose near pairs (s, t), s after t, are known."""
    parents = near.groupBy(F.col("s").alias("sequence")).agg(F.min_by("t", generation_key(F.col("s"), F.col("t"))).alias("parent"))
    return _grouped(uniques, roots(uniques, parents))


def _held(near: DataFrame) -> DataFrame:
    """(sequence) of reads that an earlier expander holds, taken one by one in a single task; for few pairs only."""
    ship(near.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("s_seen", "s", "t")))]
        held: set = set()
        for _, s, t in sorted(rows):
            if t not in held:
                held.add(s)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.string())], ["sequence"])

    return near.select("s_seen", "s", "t").coalesce(1).mapInArrow(run, "sequence string")


def expanders(uniques: DataFrame, near: DataFrame, *, local: int | None = None) -> DataFrame:
    """(sequence): reads that no earlier expander holds in its ball.

    Rounds over the pairs between undecided reads: one without an earlier neighbour
    expands and holds its later ones, and pairs of held reads go.  When few pairs
    are left one task decides the rest, read by read.
    """
    local = LOCAL if local is None else local
    held, first = None, True
    while True:
        left = Observation()
        near = materialize(near.observe(left, F.count("*").alias("n")), "open")
        some = left.get["n"]
        if some > local:
            # an earlier neighbour that has none itself expands
            heads = near.select("t").join(near.select(F.col("s").alias("t")), "t", "left_anti").distinct()
            now = near.join(heads, "t", "left_semi").select(F.col("s").alias("sequence")).distinct()
        else:
            now = _held(near)
        now = materialize(now, "held")
        held = now if held is None else held.unionByName(now)
        if some <= local:
            return uniques.select("sequence").join(held, "sequence", "left_anti")
        gone = lambda c: now.select(F.col("sequence").alias(c))
        near = near.join(gone("s"), "s", "left_anti").join(gone("t"), "t", "left_anti").select("s", "s_seen", "t", "t_seen")


def _balls(late: DataFrame, r: int) -> DataFrame:
    """(id, first_seen, n, k, x, text): each string of the balls of reads (id, first_seen, n, sequence, code), in its ball's order k.

    Packed strings are x, where a letter is changed by XOR with 1, 2 or 3; others are text.
    """
    def changed(d: DataFrame, at: str, after: Column, put: str) -> DataFrame:
        """A row for each place from ``after`` on and each other letter there; its rank among the letters in ``put``."""
        d = d.select("*", F.explode(F.sequence(after, F.col("n") - 1)).alias(at)).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("v"))
        low = 2 * (F.col("n") - 1 - F.col(at))
        letter = F.call_function("shiftright", F.col("x"), low).bitwiseAND(F.lit(3)).bitwiseXOR(F.col("v").cast("long"))
        rank = F.lit(0)
        for place, c in enumerate(NEIGHBOUR_ORDER):
            rank = F.when(letter == ALPHABET.index(c), place).otherwise(rank)
        x = F.col("x").bitwiseXOR(F.call_function("shiftleft", F.col("v").cast("long"), low))
        return d.select("*", rank.alias(put), x.alias("y")).drop("x", "v").withColumnRenamed("y", "x")

    whole = ["id", "first_seen", "n"]
    c = late.where("code is not null").select(*whole, F.col("code").alias("x"))
    some = changed(c.where("n > 0"), "p", F.lit(0), "a")
    order = lambda m, *of: reduce(lambda k, x: k * 64 + x, of, F.lit(m).cast("long"))
    zero = F.lit(0)
    out = [c.select(*whole, F.lit(-1).cast("long").alias("k"), "x"), some.select(*whole, order(1, F.col("p"), zero, F.col("a"), zero).alias("k"), "x")]
    if r == 2:
        twice = changed(some.where("p < n - 1"), "q", F.col("p") + 1, "b")
        out.append(twice.select(*whole, order(2, *map(F.col, "pqab")).alias("k"), "x"))
    packed = reduce(DataFrame.unionByName, out).withColumn("text", F.lit(None).cast("string"))

    own = F.struct(F.col("sequence").alias("y"), F.lit(-1).alias("k"))
    near = F.transform(hamming_neighbors(F.col("sequence"), r), lambda h: F.struct(h["neighbor"].alias("y"), h["ordinal"].alias("k")))
    o = late.where("code is null").select(*whole, F.explode(F.concat(F.array(own), near)).alias("e")).select(*whole, F.col("e.k").cast("long").alias("k"), "e.y")
    o = o.withColumn("x", _coded("y"))
    return packed.unionByName(o.select(*whole, "k", "x", F.when(F.col("x").isNull(), F.col("y")).alias("text")))


def greedy_ball(uniques: DataFrame, r: int = 1) -> DataFrame:
    """uniques (sequence, count, first_seen) with (root, root_first_seen): whole balls are claimed, seen or not."""
    _check(r)
    uniques = materialize(uniques, "uniques")  # read several times
    near = materialize(hamming_pairs(uniques, r), "near")
    exp = materialize(expanders(uniques, near), "expanders")
    first = F.struct("t_seen", "t")
    claimed = near.join(exp.withColumnRenamed("sequence", "t"), "t", "left_semi")
    owned = claimed.groupBy(F.col("s").alias("sequence")).agg(F.min(first)["t"].alias("parent"))
    owned = owned.join(exp, "sequence", "left_anti")
    # expanders whose balls meet: of the strings that an expander claims, the first that an earlier one had claimed.  Each string has as many
    # claimers as its ball has strings at most, so nothing is compared with anything but through a shared string
    late = uniques.join(exp, "sequence", "left_semi").select("sequence", "first_seen", F.length("sequence").alias("n"), _coded("sequence").alias("code"))
    late = materialize(late.withColumn("id", F.monotonically_increasing_id()), "late")
    earliest = F.min(F.struct("first_seen", "id")).over(W.partitionBy("n", "x", "text"))
    met = _balls(late, r).withColumn("owner", earliest["id"]).where("owner <> id")
    met = met.groupBy("id").agg(F.min_by("owner", "k").alias("owner"))
    name = lambda i, c: late.select(F.col("id").alias(i), F.col("sequence").alias(c))
    joined = met.join(name("id", "sequence"), "id").join(name("owner", "parent"), "owner").select("sequence", "parent")
    return _grouped(uniques, roots(uniques, owned.unionByName(joined)))


def summarise_greedy(grouped: DataFrame) -> DataFrame:
    """(sequence, cluster_size, total_count, root_first_seen[, header]) of each group.

    The representative has the greatest count, of equal ones the first to join.
    """
    keep = ["sequence", *(["header"] if "header" in grouped.columns else [])]
    g = grouped.groupBy("root", "root_first_seen").agg(
        F.max_by(F.struct(*keep), F.struct("count", -F.col("first_seen"))).alias("r"), F.count("*").alias("cluster_size"), F.sum("count").alias("total_count")
    )
    return g.select(*[F.col(f"r.{k}").alias(k) for k in keep], "cluster_size", "total_count", "root_first_seen")


def named_uniques(reads: DataFrame) -> DataFrame:
    """(sequence, count, first_seen, header) of reads (read_idx, header, sequence): the header of the first read."""
    return reads.groupBy("sequence").agg(F.count("*").alias("count"), F.min("read_idx").alias("first_seen"), F.min_by("header", "read_idx").alias("header"))


def _check(r: int) -> None:
    if r not in (1, 2):
        raise ValueError("one or two mismatches are supported")


def ball_of(s: Column, r: int) -> Column:
    """Strings within ``r`` mismatches, without their order."""
    return F.transform(hamming_neighbors(s, r), lambda x: x["neighbor"])
