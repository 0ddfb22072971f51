"""One-permutation MinHash fingerprints with optimal densification.

Each distinct run of words is hashed once; the hash's high bits choose a bin and
each bin keeps its least hash.  A bin that stays empty takes the value of a bin
chosen by a fixed sequence of hashes of its own number, the first that is not
empty, so that two texts agree there as likely as elsewhere.  The low ``bits``
bits of each bin are stored, packed.  Two unequal values agree in the stored bits
by chance, and the share of agreeing bins is corrected for that.

Rows: null and empty texts, and those of white space only, have a fingerprint of
their own, alike to each other (1) and to no other (0).  A text with fewer words
than a run is one run.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import ship
from .common import map_batches, slices
from .simhash import shingle_hashes

BINS, BITS, WIDTH, SEED = 512, 4, 5, 1_234_567
#: Documents that a range of ids aims at when documents are put in order, and the
#: number of ranges above which they grow instead.
RANGE_DOCS, MOST_RANGES = 1_000, 100_000


@functools.cache
def detours(bins: int) -> np.ndarray:
    """For each bin the bins it tries in turn when it is empty."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64), indexing="ij")
    x = i * np.uint64(0x9E3779B97F4A7C15) + t * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)


def fingerprint_of(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> bytes:
    """Packed fingerprint of unsigned 64-bit hashes; empty for none."""
    if not len(hashes):
        return b""
    shift = np.uint64(64 - (bins - 1).bit_length())
    h = np.sort(hashes)
    at = (h >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    value = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    value[at[first]], full[at[first]] = h[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        tries = full[detours(bins)[empty]]
        found = tries.any(axis=1)
        source = detours(bins)[empty, tries.argmax(axis=1)]
        some = int(np.flatnonzero(full)[0])
        value[empty] = np.where(found, value[source], value[some])
    low = (value & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = np.unpackbits(low[:, None], axis=1)[:, 8 - bits :]
    return np.packbits(planes).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated share of common runs, corrected for chance agreement; 0 to 1."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    diff = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8))[: bins * bits].reshape(bins, bits)
    agree = 1 - diff.any(axis=1).mean()
    chance = 1 / (1 << bits)
    return float(min(1.0, max(0.0, (agree - chance) / (1 - chance))))


@functools.lru_cache(maxsize=4)  # a document is also the next of the one before
def text_fingerprint(text: str | None, width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> bytes:
    words = (text or "").encode().lower().split()
    return fingerprint_of(np.array(shingle_hashes(words, width, SEED), np.uint64), bins, bits)


def fingerprint(df: DataFrame, text: str = "text", *, width: int = WIDTH, bins: int = BINS, bits: int = BITS, out: str = "minhash") -> DataFrame:
    """Append the packed fingerprint (binary) of each whole text."""

    def make():
        return lambda b: {out: pa.array([text_fingerprint(t, width, bins, bits) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.binary())}

    return map_batches(df, make, f"`{out}` binary")


def with_next(df: DataFrame, fn, added: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``fn(text, next_text)`` to each document and the next by descending id.

    After the last comes the first.  Ids are cut into ranges at quantiles that one
    narrow pass finds; texts are dealt by range, once, together with a copy of the
    first text of the next range; each range is sorted and read as a stream.  The
    driver and the tasks hold one id for each range, MOST_RANGES at most.

    Rows of one id are in the order of their text's hash.  A null id has no place
    in the order: its next is the first document, whose one text goes to all tasks
    that read rows without id.  Returns doc_id and the columns ``added``, which
    ``fn`` gives as a tuple.
    """
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out_type = T._parse_datatype_string(f"doc_id long, {added}")
    n, nulls = d.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if not n:
        return _alone(d, fn, out_type, "")
    unplaced, d = d.where("doc_id is null"), d.where("doc_id is not null")
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_DOCS)))
    quantiles = d.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], max(1e-5, 0.1 / ranges)) if ranges > 1 else []
    cuts = np.unique(np.array(quantiles, np.int64))

    def place(ids: pa.Array) -> np.ndarray:
        """Ranges count from the top."""
        return len(cuts) - np.searchsorted(cuts, ids.to_numpy(zero_copy_only=False), "left")

    def tops(batches):
        for b in batches:
            at, ids = place(b.column(0)), b.column(0).to_numpy(zero_copy_only=False)
            known = np.unique(at)
            yield pa.RecordBatch.from_pydict({"range": pa.array(known, pa.int64()), "top": pa.array([int(ids[at == r].max()) for r in known], pa.int64())})

    found = d.select("doc_id").mapInArrow(tops, "range long, top long").groupBy("range").agg(F.max("top").alias("top")).orderBy("range").collect()
    full = [r.range for r in found]
    # the first text of a range is also wanted at the end of the range before
    wanted = {r.top: full[i - 1] for i, r in enumerate(found)}

    def deal(batches):
        names = ["doc_id", "text", "range", "extra"]
        for b in (x for batch in batches for x in slices(batch)):
            at = place(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int64()), pa.array(np.zeros(len(at), bool))], names=names)
            copies = [(k, wanted[i]) for k, i in enumerate(b.column(0).to_pylist()) if i in wanted]
            if copies:
                c = b.take(pa.array([k for k, _ in copies]))
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([r for _, r in copies], pa.int64()), pa.array([True] * len(copies))], names=names)

    dealt = d.mapInArrow(deal, "doc_id long, text string, range long, extra boolean")
    parts = max(1, min(len(full), n // (4 * RANGE_DOCS)))  # several small ranges to a task, to even them out
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "extra", F.desc("doc_id"), F.xxhash64("text"))

    def run(batches):
        held, over, rows = None, None, []
        for b in (x for batch in batches for x in slices(batch)):
            for i, t, r, extra in zip(*(c.to_pylist() for c in b.columns)):
                t = t or ""
                if extra and over == r:
                    continue
                if held is not None:
                    rows.append((held[0], *fn(held[1], t)))
                held, over = (None, r) if extra else ((i, t), None)
            yield _batch(rows, out_type)
            rows = []

    placed = dealt.mapInArrow(run, out_type)
    if not nulls:
        return placed
    head = d.where(F.col("doc_id") == found[0].top).orderBy(F.xxhash64("text")).select("text").first().text or ""
    return placed.unionByName(_alone(unplaced, fn, out_type, head))


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    schema = to_arrow_schema(kind)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _alone(d: DataFrame, fn, kind: T.StructType, following: str) -> DataFrame:
    """Rows without id, each followed by the same text."""

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            yield _batch([(None, *fn(t or "", following)) for t in b.column(1).to_pylist()], kind)

    return d.mapInArrow(run, kind)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the front of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]
