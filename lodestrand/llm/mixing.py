"""Mixing sources to target weights by Pareto order sampling.

Targets: all sources share the mix by weight, none above a multiple of its size;
the excess goes to the others by weight.  Of a source with target t and size s
every document is taken floor(t / s) whole times for certain.  The rest of the
target is spread over the documents with unequal expectations: in proportion to
the square root of their words (or another growing function of them), so longer
texts are likelier, and at most one.  A document whose expectation reaches one is
taken once more for certain, which raises the others'.  Among these a sample
without replacement, of fixed size in words, is drawn in Pareto order: u drawn
from (0, 1) for each document, inclusion probability p, rank
(u / (1 - u)) / (p / (1 - p)), smallest first, until the next document would
bring the words further from the target.

All of it is DataFrame operations.  The expectations' factor comes from a table
of one row for each number of words that a source's documents have.  A source's order is never sorted in
one task: ranks are cut into buckets, bucket sums are accumulated, and only the
one bucket in which the target falls is ordered exactly.

Rows: a null or empty text has size 0 and is taken 0 words; null is a source of
its own, last in order.  Rows equal in id, source and text are told apart by a
number, which any of them may get.  Draws depend on the seed, id, text and that
number only, so reruns agree.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize
from .common import free_name, row_hash

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Documents that a bucket of ranks aims to hold.
BUCKET_DOCS = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sorted by cap over weight, sources are capped from the front; the level at
    which the rest shares in proportion to weight is found with running sums.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    run = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    n = len(weights)
    d = sizes.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % n + 1).cast("int"))
    )
    d = d.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    d = d.withColumn("pool", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("weigh_all", F.sum("weight").over(everything))
    d = d.withColumn("cap_before", F.coalesce(F.sum("cap").over(run), F.lit(0.0))).withColumn("weigh_before", F.coalesce(F.sum("weight").over(run), F.lit(0.0)))
    level = (F.col("pool") - F.col("cap_before")) / (F.col("weigh_all") - F.col("weigh_before"))
    d = d.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("cap"))
    shared = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    d = d.withColumn("settled", shared["level"])
    target = F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled") * F.col("weight")))
    return d.select("source", "source_size", target.alias("target"))


def draw(seed: int, *key: Column) -> Column:
    """52 bits that depend on the seed and key only; SQL engines with md5 can draw the same."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


def unit(bits: Column) -> Column:
    """A number in (0, 1)."""
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def inclusion(docs: DataFrame, plan: DataFrame, weight: Callable[[Column], Column]) -> DataFrame:
    """(source, factor, certain): ``rest`` words of (source, rest) spread over rows (source, size).

    A document's expectation is factor times weight, one at most; ``certain`` are
    the words of those that reach one.  With the largest k numbers of words
    certain the others' factor is what is left of the rest, over the sum of
    words times weight; the first k for which none of the others reaches one is
    the solution.
    """
    r = plan.select(F.col("source").alias("_s"), "rest")
    each = docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    each = each.join(r, each.source.eqNullSafe(r._s)).drop("_s").withColumn("x", weight(F.col("size").cast("double")))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    moment = F.sum(F.col("n") * F.col("size") * F.col("x")).over(down.rowsBetween(0, W.unboundedFollowing))
    each = each.withColumn("certain", larger).withColumn("factor", (F.col("rest") - F.col("certain")) / moment)
    solved = F.col("factor") * F.col("x") < 1
    best = F.max(F.when(solved, F.struct("size", "factor", "certain")))
    return each.groupBy("source").agg(best.alias("b")).select("source", "b.factor", "b.certain")


def allocate(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0, weight: Callable[[Column], Column] = F.sqrt) -> DataFrame:
    """Append (source_size, target, expected, copies) to rows (doc_id, source, size, bits).

    ``expected`` is the mean of ``copies`` over all draws.
    """
    per_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    want = targets(per_source.select("source", "source_size"), weights=weights, share=share, most=most)
    count = per_source.select(F.col("source").alias("s"), "docs")
    plan = materialize(
        want.join(count, want.source.eqNullSafe(count.s)).drop("s")
        .withColumn("mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("sure", F.floor(F.col("mean") + F.lit(1e-12)).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("sure") * F.col("source_size"), F.lit(0.0)))
        .withColumn("buckets", F.greatest(F.ceil(F.col("docs") / BUCKET_DOCS), F.lit(1)))
        .drop("mean", "docs"),
        "mix-plan",
    )
    odds = inclusion(docs, plan, weight).withColumnRenamed("source", "_s")
    plan = plan.join(odds, plan.source.eqNullSafe(odds._s), "left").drop("_s")
    plan = materialize(plan.withColumn("factor", F.coalesce("factor", F.lit(0.0))).withColumn("left", F.col("rest") - F.coalesce("certain", F.lit(0))).drop("certain", "rest"), "mix-odds")
    q = plan.withColumnRenamed("source", "_s")
    u, p = unit(F.col("bits")), F.col("p")
    ranked = (
        docs.join(q, docs.source.eqNullSafe(q._s)).drop("_s")
        .withColumn("p", F.least(F.col("factor") * weight(F.col("size").cast("double")), F.lit(1.0)))
        .withColumn("sure", F.col("sure") + (p >= 1).cast("long"))
        .withColumn("rank", F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p))))
        # rank / (1 + rank) grows with the rank, from 0 to 1
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("buckets")).cast("long"))
    )
    sums = ranked.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    run = W.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    # the first bucket that reaches the target is ordered exactly
    edge = sums.where((F.col("before") < F.col("left")) & (F.col("upto") >= F.col("left")))
    edge = materialize(edge.select(F.col("source").alias("_s"), F.col("bucket").alias("_edge"), F.col("before").alias("_before")), "mix-edge")
    ranked = ranked.join(edge, ranked.source.eqNullSafe(edge._s), "left").drop("_s")
    on_edge = F.coalesce(F.col("bucket") == F.col("_edge"), F.lit(False))
    order = W.partitionBy("source").orderBy("rank", "doc_id", "bits")
    inside = ranked.where(on_edge).withColumn("sum", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("_before"))
    # the document that crosses the target is taken if that ends nearer to it
    nearer = F.abs(F.col("sum") - F.col("left")) <= F.abs(F.col("sum") - F.col("size") - F.col("left"))
    inside = inside.withColumn("extra", ((F.col("sum") <= F.col("left")) | ((F.col("sum") - F.col("size") < F.col("left")) & nearer)).cast("long")).drop("sum")
    before = F.col("bucket").isNotNull() & (F.col("left") > 0) & (F.col("_edge").isNull() | (F.col("bucket") < F.col("_edge")))
    both = ranked.where(~on_edge).withColumn("extra", before.cast("long")).unionByName(inside)
    expected = F.col("sure") + F.when(p < 1, p).otherwise(0.0)
    return both.select(*docs.columns, "source_size", "target", expected.alias("expected"), (F.col("sure") + F.col("extra")).alias("copies"))


def sized(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = 7, key: str | None = None) -> DataFrame:
    """(doc_id, source, size, bits[, key]) of every row, written once; ``bits`` is its draw."""
    d = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), draw(seed, F.col(doc_id), F.col(text)).alias("bits"), *([F.col(key).alias("key")] if key else []))
    # rows with all of this in common are counted first, so a frequent one is in no task's sort
    same = d.groupBy(*d.columns).agg(F.count("*").alias("n"))
    each = same.withColumn("at", F.explode(F.when(F.col("n") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("n")))))
    return materialize(each.withColumn("bits", F.when(F.col("at") == 1, F.col("bits")).otherwise(draw(seed, F.col("bits"), F.col("at")))).select(*d.columns), "mix-sizes")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = 7, **how) -> DataFrame:
    """(doc_id, size, source_size, target, expected, copies, taken) of every row."""
    got = allocate(sized(df, doc_id, text, source, seed=seed), **how)
    return got.select("doc_id", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sample(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, seed: int = 7, **how) -> DataFrame:
    """The rows of the mix: each row of ``df`` as many times as it is taken.

    Rows without words add none to the mix and are kept once.  Of rows equal in
    all columns one stands for all and is repeated for them, so no row needs a
    number and texts are dealt once, or not at all if the counts are few.
    """
    i, c, h, n, g_h = (free_name(df.columns, x) for x in ("_mix_id", "_mix_copies", "_mix_hash", "_mix_rows", "_mix_given"))
    rows = df.withColumn(h, row_hash(df))
    got = allocate(sized(rows, doc_id, text, source, seed=seed, key=h), **how)
    got = got.groupBy(F.col("doc_id").alias(i), F.col("key").alias(h)).agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))).alias(c), F.count("*").alias(n))
    got = materialize(got.where(F.col(c) > 0), "mix-copies")
    out = None
    for repeated in (False, True):
        g = got.where(F.col(n) > 1 if repeated else F.col(n) == 1)
        if repeated:
            g = materialize(g, "mix-repeated")  # written, so that a short list is known as such
        taken = rows.join(g.withColumnRenamed(h, g_h), F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(h) == F.col(g_h)))
        if repeated:
            taken = taken.dropDuplicates([i, h])
        taken = taken.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*[F.col(f"`{x}`") for x in df.columns])
        out = taken if out is None else out.unionByName(taken)
    return out
