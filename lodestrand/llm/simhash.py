"""SimHash fingerprints and near-duplicate classes by ball hashing.

Two 64-bit fingerprints differ in at most ``2 r`` bits exactly if some value lies
within ``r`` bits of both.  So each distinct fingerprint emits its whole ball of
radius ``r`` and those that meet in a value are linked; copies are collapsed
first.  What is shuffled is not the ball's thousands of values one by one but
its cells: the value space is cut by a prefix that grows with the logarithm of
the number of fingerprints, a fingerprint goes once to each cell its ball
touches, and the cell makes the values that fall into it.  Every value has one
cell, so two fingerprints meet there exactly if they emit a common value, as if
they were shuffled on the values themselves.  Values are deduplicated by sorting,
and colliding fingerprints are verified.

Rows: a null or empty text has fingerprint zero and is linked like any other.
A null id never is the smallest of a class unless the class has no other.
Repeated rows stay, in one class.  Other columns pass through.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from ..storage import materialize
from .common import free_name, map_batches, row_hash

#: Ball values that a cell makes at once; fuller cells are dealt over more tasks.
CELL_VALUES = 4_000_000
#: A cell of more tasks than this sends each fingerprint only to the tasks that its values belong to, not to all.
CELL_TASKS = 32
#: Fingerprints aimed at for each cell's own prefix.
CELL_OWN = 1_500
HASHES_AT_ONCE = 1 << 16
#: Rows of wide cells that a task deals out at once.
REACH_ROWS = 1_000


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``width`` words, repeats included; of all words, if fewer."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    h = xxhash.xxh64_intdigest
    starts = [0, *ends]
    # starts[i] is where word i begins; ends[i] where word i ends
    return [h(joined[a + (a > 0) : b], seed) for a, b in zip(starts, ends[width - 1 :])]


def majority(hashes: list[int]) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    if not hashes:
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[i : i + HASHES_AT_ONCE], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(df: DataFrame, text: str = "text", *, width: int = 4, out: str = "fp") -> DataFrame:
    """Append the SimHash of each whole text, as a signed long.

    Words are runs without ASCII white space, with A-Z in lower case.
    """

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            got = np.array([majority(shingle_hashes((t or "").encode().lower().split(), width)) for t in texts], np.uint64)
            return {out: pa.array(got.view(np.int64))}

        return run

    return map_batches(df, make, f"`{out}` long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def flips(bits: int, most: int) -> list[int]:
    """All masks over ``bits`` bits with at most ``most`` of them set."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links i-j reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            return label
        label = new


def _mixed(low: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """A hash of each value: rows are fingerprints, columns masks."""
    v = low[:, None] ^ masks[None, :]
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v


def _task_of(mixed: np.ndarray, shards: np.ndarray | int) -> np.ndarray:
    """The task of a hashed value among ``shards``; bits that ``meet`` keeps decide it."""
    return (mixed >> np.uint64(40)) % (np.uint64(shards) if isinstance(shards, int) else shards)


def tasks_reached(fps: np.ndarray, cell: np.ndarray, shards: np.ndarray, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard), each once: the tasks of its cell that the values of each fingerprint belong to."""
    low_bits = 64 - bits
    low = fps & np.uint64((1 << low_bits) - 1)
    used = np.bitwise_count((fps >> np.uint64(low_bits)) ^ cell) if bits else np.zeros(len(fps), np.uint8)
    rows, tasks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for spent in range(half + 1):
        mine = np.flatnonzero(used == spent)
        masks = np.array(flips(low_bits, half - spent), np.uint64)
        step = max(1, 500_000 // len(masks))
        for k in range(0, len(mine), step):
            at = mine[k : k + step]
            shard = np.sort(_task_of(_mixed(low[at], masks), shards[at][:, None]), axis=1)
            first = np.ones(shard.shape, bool)
            first[:, 1:] = shard[:, 1:] != shard[:, :-1]
            rows.append(np.repeat(at, first.sum(axis=1)))
            tasks.append(shard[first].astype(np.int64))
    return np.concatenate(rows), np.concatenate(tasks)


def meet(fps: np.ndarray, cell: int, shard: int, shards: int, bits: int, half: int) -> np.ndarray:
    """Links among fingerprints whose balls meet in a value of this cell and shard.

    ``fps`` are unsigned and distinct.  Returns rows (fingerprint, smallest index
    reached) as index pairs.
    """
    n, low_bits = len(fps), 64 - bits
    if n < 2:
        return np.zeros((0, 2), np.int64)
    low = fps & np.uint64((1 << low_bits) - 1)
    used = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(cell)) if bits else np.zeros(n, np.uint8)
    index_bits = max(1, (n - 1).bit_length())
    keep = np.uint64(~((1 << index_bits) - 1) & (1 << 64) - 1)
    parts = []
    for spent in range(half + 1):
        mine = np.flatnonzero(used == spent)
        if not len(mine):
            continue
        masks = np.array(flips(low_bits, half - spent), np.uint64)
        step = max(1, 2_000_000 // len(masks))
        for k in range(0, len(mine), step):
            at = mine[k : k + step]
            packed = ((_mixed(low[at], masks) & keep) | at.astype(np.uint64)[:, None]).ravel()
            if shards > 1:
                packed = packed[_task_of(packed, shards) == shard]
            parts.append(packed)
    p = np.concatenate(parts)
    p.sort()
    same = (p[1:] & keep) == (p[:-1] & keep)
    if not same.any():
        return np.zeros((0, 2), np.int64)
    index = (p & ~keep).astype(np.int64)
    at = np.flatnonzero(same)
    i, j = index[at], index[at + 1]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 2 * half
    if not near.all():  # values that only share their hash: compare all of such a run
        value = p & keep
        more = []
        for v in np.unique(value[at[~near]]):
            run = np.unique(index[np.searchsorted(value, v, "left") : np.searchsorted(value, v, "right")])
            for x in run:
                ys = run[np.bitwise_count(fps[run] ^ fps[x]) <= 2 * half]
                more.append(np.stack([np.full(len(ys), x), ys], axis=1))
        extra = np.concatenate(more)
        i, j = np.concatenate([i[near], extra[:, 0]]), np.concatenate([j[near], extra[:, 1]])
    pairs = np.unique((np.minimum(i, j) << 32) | np.maximum(i, j))
    label = _forest(n, pairs >> 32, pairs & 0xFFFFFFFF)
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], axis=1)


def ball_links(fps: DataFrame, fp: str = "fp", *, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``radius`` bits.

    Within a cell the links are reduced to a spanning forest, so a large group of
    near copies gives rows in proportion to its size, not to its square.  A full
    cell is dealt over tasks by the hash of the values.  Up to CELL_TASKS of them
    each get all its fingerprints; of more, a fingerprint goes to those its values
    belong to, thus to no more tasks than it has values, and a task holds about
    CELL_VALUES values however full the cell is.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even")
    fps = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    n = fps.count()
    bits = max(0, min(24, (n // CELL_OWN).bit_length()))
    low_bits = 64 - bits
    masks = flips(bits, half)
    prefix = F.shiftrightunsigned("fp", low_bits) if bits else F.lit(0).cast("long")
    emitted = fps.select("fp", F.explode(F.array(*[prefix.bitwiseXOR(F.lit(m).cast("long")) for m in masks])).alias("cell"))
    made = [len(flips(low_bits, half - d)) for d in range(half + 1)]
    spent = F.bit_count(prefix.bitwiseXOR(F.col("cell")))
    weight = F.element_at(F.array(*[F.lit(x) for x in made]), spent.cast("int") + 1)
    full = materialize(
        emitted.groupBy("cell").agg(F.sum(weight.cast("long")).alias("w"))
        .where(F.col("w") > CELL_VALUES)
        .select("cell", F.ceil(F.col("w") / CELL_VALUES).cast("long").alias("shards")),
        "simhash-full",
    )
    wide = F.col("shards") > CELL_TASKS
    one = F.lit(1).cast("long")
    listed = emitted.join(full, "cell", "left").select("fp", "cell", F.coalesce("shards", one).alias("shards"))
    dealt = listed.where(~wide).select("fp", "cell", "shards", F.explode(F.sequence(one - 1, F.col("shards") - 1)).alias("shard"))

    def reach(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, REACH_ROWS):
                b = batch.slice(i, REACH_ROWS)
                x, cell, shards = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in b.columns)
                at, shard = tasks_reached(x, cell, shards, bits, half)
                yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(at)) for k in range(3)] + [pa.array(shard)], names=["fp", "cell", "shards", "shard"])

    if not full.where(wide).isEmpty():
        dealt = dealt.unionByName(emitted.join(full.where(wide), "cell").select("fp", "cell", "shards").mapInArrow(reach, "fp long, cell long, shards long, shard long"))

    def links(t: pa.Table) -> pa.Table:
        x = t.column("fp").to_numpy().view(np.uint64)
        got = meet(x, t.column("cell")[0].as_py(), t.column("shard")[0].as_py(), t.column("shards")[0].as_py(), bits, half)
        s = x.view(np.int64)
        return pa.table({"a": s[got[:, 0]], "b": s[got[:, 1]]})

    return dealt.groupBy("cell", "shard").applyInArrow(links, "a long, b long").distinct()


def components(prints: DataFrame, fp: str = "fp", *, radius: int = 4) -> DataFrame:
    """(fp, component) of each distinct fingerprint that links with another: the class is named by one of its fingerprints."""
    return stars(ball_links(prints, fp, radius=radius), "a", "b").withColumnsRenamed({"id": "node"}).select(F.col("node").alias("fp"), "component")


def _leaders(prints: DataFrame, leader: Column, radius: int) -> DataFrame:
    """(fp, leader): the least ``leader`` of each fingerprint's class."""
    reps = prints.groupBy("fp").agg(F.min(leader).alias("least"))
    parts = components(prints, radius=radius).withColumnRenamed("fp", "node")
    joined = reps.join(parts, reps.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "simhash-reps")
    whole = joined.groupBy("component").agg(F.min("least").alias("leader"))
    return joined.join(whole, "component").select("fp", "leader")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row: its class is the smallest id it reaches.

    Fingerprints link at ``radius`` or fewer differing bits, and classes are
    closed under links.
    """
    prints = materialize(fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", width=width).select("doc_id", "fp"), "simhash-fp")
    names = _leaders(prints, F.col("doc_id"), radius).withColumnRenamed("leader", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each class: that with the smallest id, of equal ids that whose columns hash lowest.

    Rows without an id come last, and are copies like any other.  Different texts
    that share an id are each looked at for themselves.  The columns are those of
    ``df``.  What goes is listed, so texts stay where they are if the list is short.
    """
    h, f = free_name(df.columns, "_hash"), free_name(df.columns, "_fp")
    rows = df.withColumn(h, row_hash(df))
    prints = fingerprint(rows.select(F.col(doc_id).alias("doc_id"), F.col(h).alias("h"), F.col(text).alias("_text")), "_text", width=width).select("doc_id", "h", "fp")
    prints = materialize(prints, "simhash-fp")
    best = _leaders(prints, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"), radius)
    stays = F.col("doc_id").eqNullSafe(F.col("leader.doc_id")) & (F.col("h") == F.col("leader.h"))
    # rows equal in all columns have one name; if it is to stay, one of them is added again
    repeated = materialize(prints.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("n")).where("n > 1").join(best, "fp").where(stays).select("doc_id", "h"), "simhash-repeated")
    some = not repeated.isEmpty()
    gone = prints.join(best, "fp").where(~stays).select("doc_id", "h").distinct()
    gone = materialize(gone.unionByName(repeated) if some else gone, "simhash-gone").withColumnsRenamed({"doc_id": f + "i", "h": f + "h"})
    same = lambda g: F.col(doc_id).eqNullSafe(g[f + "i"]) & (F.col(h) == g[f + "h"])
    kept = rows.join(gone, same(gone), "left_anti")
    if some:
        again = repeated.withColumnsRenamed({"doc_id": f + "i", "h": f + "h"})
        kept = kept.unionByName(rows.join(again, same(again), "left_semi").dropDuplicates([doc_id, h]))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
