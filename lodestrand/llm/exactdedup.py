"""Exact deduplication by deterministic block naming.  DataFrame functions only.

Each normalised text is cut into blocks of a fixed number of bytes.  The distinct
blocks are sorted and numbered: a block's number is its name.  Then adjacent names
are paired and each distinct pair gets a name, and so on, until one name is left
of each document.  Texts are equal if and only if they end at the same level with
the same name; nothing rests on a hash.

Texts are shuffled once, to be sorted as distinct blocks, after each task has
dropped its own repetitions.  Blocks find their names by a route of two 64-bit
hashes.  That no two distinct blocks share a route is checked on all of them; if
some do, the block itself is the route.  What follows moves integers only.  Names
are written before they are joined with what they name, so both sides of the join
are plain shuffles and adaptive execution splits a frequent block's rows.

Defined results: a null text is an empty one; an empty text is one empty block.
Of equal texts the row with the largest key stays, a null key being smaller than
any, and of rows that share it as well one.  Rows are never merged: repeated rows
are told apart by where the scan found them, written once.  Columns named like the
added ones are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Bytes to a block.
BLOCK = 2048
#: Columns that ``deduplicate`` adds.
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normal(text: Column | str) -> Column:
    """The text that decides equality: A to Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def cut(data: Column, size: int = BLOCK) -> Column:
    """A binary in blocks of ``size`` bytes, the last one shorter; one block if empty."""
    last = F.greatest(F.floor((F.octet_length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def route(block: Column | str) -> list[Column]:
    """Where a block's name is looked up: two hashes with different seeds."""
    return [F.xxhash64(block), F.xxhash64(F.lit(1), block)]


def numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Append ``name``, a number of its own for each of the distinct rows, in their order within each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _block_names(rows: DataFrame) -> DataFrame:
    """(rid, pos, left, name): the name of each block, and how many the row has."""
    made = rows.select("rid", F.size("blocks").alias("left"), F.posexplode("blocks").alias("pos", "block"))
    distinct = numbered(rows.select(F.explode("blocks").alias("block")).distinct(), "block")
    on = {f"route{k}": c for k, c in enumerate(route("block"))}
    names = materialize(distinct.select(*[c.alias(k) for k, c in on.items()], "name"), "block-names")
    if names.groupBy(*on).count().where("count > 1").limit(1).count():
        discard(names)
        on, names = {"block": F.col("block")}, materialize(distinct, "block-names")
    return made.withColumns(on).select("rid", "pos", "left", *on).join(names, list(on)).select("rid", "pos", "left", "name")


def _pair_names(cur: DataFrame) -> DataFrame:
    """(rid, pos, left, name) of adjacent pairs; the last of an odd number is paired with none."""
    side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
    pairs = cur.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("half")).agg(
        side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"), F.ceil(F.first("left") / 2).cast("int").alias("left")
    )
    names = materialize(numbered(pairs.select("a", "b").distinct(), "a", "b"), "pair-names")
    return pairs.join(names, ["a", "b"]).select("rid", F.col("half").alias("pos"), "left", "name")


def identify(df: DataFrame, *, text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(rid, row, text_sha256, level, name): each row with its text's identity (level, name).

    ``row`` is a struct of the columns in ``carry``, all by default; rid numbers
    the rows of this result.
    """
    carry = df.columns if carry is None else carry
    most = Observation()  # of the longest text, counted while the blocks are written
    value = _let(normal(f"`{text}`").cast("binary"), lambda t: F.struct(F.sha2(t, 256).alias("text_sha256"), cut(t, block).alias("blocks")))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), value.alias("v"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "row", "v.text_sha256", "v.blocks")
    rows = materialize(rows.observe(most, F.max(F.size("blocks")).alias("n")), "blocks")

    levels = ((most.get["n"] or 1) - 1).bit_length()
    cur = materialize(_block_names(rows), "names-0")
    ended = [cur.where("left = 1").select("rid", F.lit(0).alias("level"), "name")]
    for level in range(1, levels + 1):
        cur = materialize(_pair_names(cur.where("left > 1")), f"names-{level}")
        ended.append(cur.where("left = 1").select("rid", F.lit(level).alias("level"), "name"))
    found = ended[0]
    for e in ended[1:]:
        found = found.unionByName(e)
    return rows.select("rid", "row", "text_sha256").join(found, "rid")


def deduplicate(df: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The rows, dropped ones too, with keep_id (the key of the row that stays), group_size, kept and text_sha256.

    ``carry`` names the columns to return, all by default; ``key`` must be one.
    """
    docs = materialize(identify(df, text=text, carry=carry, block=block), "identities")
    best = F.max(F.struct(F.col(f"row.`{key}`").alias("key"), (-F.col("rid")).alias("place")))
    groups = docs.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("n")).where("n > 1")
    # written: the rows of a large group are then split over tasks
    out = docs.join(materialize(groups, "groups"), ["level", "name"], "left")
    added = {
        "keep_id": F.when(F.col("n").isNull(), F.col(f"row.`{key}`")).otherwise(F.col("best.key")),
        "group_size": F.coalesce("n", F.lit(1)).cast("long"),
        "kept": F.coalesce(F.col("best.place") == -F.col("rid"), F.lit(True)),
        "text_sha256": F.col("text_sha256"),
    }
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in ADDED]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[v.alias(k) for k, v in added.items()])
