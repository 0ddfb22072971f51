"""Conversation structure repair by a scan of min-plus matrices.

A repaired conversation is empty, or an optional system turn and then pairs of a
user's and an assistant's turn.  An automaton of four states reads that: START,
after the system turn (HEAD), after a user's (ASKED) and after an assistant's
(ANSWERED).  A turn is a 4x4 matrix: from each state to each the cheapest way to
keep, rerole or delete it, with turns inserted before and after (the closure).
An element is (cost, audit), audit being the initials of the edits; costs add up,
audits are put end to end, and the smaller of two, as a tuple, is taken.  That is
associative, and distributive: ways of equal cost over the same turns never have
audits of which one begins with the other, as what follows would be inserted
turns, which cost.  So turns are multiplied in chunks of CHUNK, and the chunks of
a long conversation in a tree of FAN branches: no task holds more than FAN
products, whatever share of the rows one conversation has.

Turns are sorted once, over all tasks, by conversation, turn (null first), role
and text, and numbered; turns equal in all of these are dealt anywhere, as they
are interchangeable.  Afterwards only flags are shuffled until the texts are
joined with their edits.

Defined results: null roles and texts are one space; a null conv_id is a
conversation of its own; turns of one number are ordered by role and text.  An
empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dense_ids, materialize, ship

CHUNK, FAN = 1024, 16
START, HEAD, ASKED, ANSWERED = range(4)
#: Costs of the edits, and what is added for a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: State after a user's or assistant's turn in each state, and whose turn that must be.
NEXT = {START: (ASKED, "user"), HEAD: (ASKED, "user"), ASKED: (ANSWERED, "assistant"), ANSWERED: (ASKED, "user")}
#: Whether a turn must be deleted, and whether it is truncated.
CLEAN, GONE, CUT = range(3)

Element = tuple[int, str] | None
Matrix = list[Element]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product: from i to j by the best state between."""
    out: Matrix = []
    for i in range(0, 16, 4):
        row = [(k, a[i + k]) for k in range(4) if a[i + k]]
        for j in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for k, x in row if (y := b[4 * k + j])]
            out.append(min(ways) if ways else None)
    return out


def _closure() -> Matrix:
    """Turns inserted as cheaply as possible, none between a state and itself."""
    out: Matrix = [None] * 16
    for start in range(4):
        state, way = start, (0, "")
        while out[4 * start + state] is None:
            out[4 * start + state] = way
            state, way = NEXT[state][0], (way[0] + INSERT, way[1] + "I")
    return out


def _turn(initial: str, fault: int) -> Matrix:
    """The matrix of a turn, with insertions before and after it."""
    one: Matrix = [None] * 16
    more = TRUNCATED if fault == CUT else 0
    for state in range(4):
        ways = {state: (DELETE, "D")}
        if fault != GONE:
            after, who = NEXT[state]
            ways[after] = (more, "K") if initial == who[0] else (REROLE + more, "R")
            if state == START and initial == "s":
                ways[HEAD] = (more, "K")
        for after, way in ways.items():
            one[4 * state + after] = way
    return times(times(_closure(), one), _closure())


TURNS = {(initial, fault): _turn(initial, fault) for initial in ("s", "u", "a", "") for fault in (CLEAN, GONE, CUT)}


def damage(df: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): turns dropped, emptied, cut, repeated or given to the user, by the CRC-32 of their conversation and number."""
    c, t = F.col(f"`{conv}`"), F.col(f"`{turn}`")
    name = F.concat(F.coalesce(c.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(t.cast("string"), F.lit(" ")))
    d = df.select(c.alias("conv_id"), t.alias("turn"), F.coalesce(f"`{role}`", F.lit(" ")).alias("role"), F.coalesce(f"`{text}`", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("case"))
    body = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("case") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.where("case <> 0").select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): turns numbered in the order of their conversations."""
    plain = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # the last key only tells equal turns apart, so that many of them can be dealt over tasks
    tied = plain.withColumn("tie", F.monotonically_increasing_id())
    return dense_ids(tied, "conv_id", F.asc_nulls_first("turn"), "role", "text", "tie", name="at").drop("tie")


def flags(numbered: DataFrame) -> DataFrame:
    """(at, conv_id, turn, initial, blank, duplicate, truncated) of ``ordered`` turns; one of the three at most is true."""
    ink = F.translate("text", " \t\n\x0b\x0c\r", "")
    d = numbered.select("at", "conv_id", "turn", "role", F.substring("role", 1, 1).alias("initial"), F.sha2("text", 256).alias("digest"), (ink == "").alias("blank"), (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # each task finds its own first turns, whoever has very many copies
    first = d.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    again = ~F.col("blank") & F.col("first").isNull()
    return d.join(first, "at", "left").select("at", "conv_id", "turn", "initial", "blank", again.alias("duplicate"), (~F.col("blank") & ~again & F.col("open")).alias("truncated"))


PART = "chunk long, rows long, lo long, head string, tail string, illegal long, costs array<long>, audits array<string>"


def _legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _parts(conv: pa.ChunkedArray, at: list[int], found: list[dict]) -> pa.Table:
    """A table of PART with the conv_id of given places."""
    columns = {"chunk": pa.int64(), "rows": pa.int64(), "lo": pa.int64(), "head": pa.string(), "tail": pa.string(), "illegal": pa.int64()}
    made = {k: pa.array([f[k] for f in found], t) for k, t in columns.items()}
    made["costs"] = pa.array([[e and e[0] for e in f["matrix"]] for f in found], pa.list_(pa.int64()))
    made["audits"] = pa.array([[e and e[1] for e in f["matrix"]] for f in found], pa.list_(pa.string()))
    return pa.table({"conv_id": conv.take(pa.array(at, pa.int64())), **made})


def _leaf(key: tuple, chunk: pa.Table) -> pa.Table:
    """The product of each conversation's turns in a chunk."""
    chunk = chunk.sort_by("at")
    conv, found, at = chunk["conv_id"], [], []
    names = conv.to_pylist()
    rows = zip(chunk["at"].to_pylist(), chunk["initial"].to_pylist(), chunk["fault"].to_pylist())
    for k, (place, initial, fault) in enumerate(rows):
        m = TURNS[initial if initial in "sua" else "", fault]
        if k and names[k] == names[k - 1]:
            last = found[-1]
            last.update(rows=last["rows"] + 1, matrix=times(last["matrix"], m), illegal=last["illegal"] + (not _legal(last["tail"], initial)), tail=initial)
        else:
            at.append(k)
            found.append({"chunk": key[0].as_py(), "rows": 1, "lo": place, "head": initial, "tail": initial, "illegal": 0, "matrix": m})
    return _parts(conv, at, found)


def _branch(key: tuple, group: pa.Table) -> pa.Table:
    """The product of up to FAN neighbouring parts of one conversation."""
    group = group.sort_by("lo")
    total: dict = {}
    for r in group.drop_columns(["conv_id"]).to_pylist():
        m = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"])]
        if total:
            total.update(rows=total["rows"] + r["rows"], matrix=times(total["matrix"], m), illegal=total["illegal"] + r["illegal"] + (not _legal(total["tail"], r["head"])), tail=r["tail"])
        else:
            total = {k: r[k] for k in ("rows", "lo", "head", "tail", "illegal")} | {"chunk": key[1].as_py(), "matrix": m}
    return _parts(group["conv_id"], [0], [total])


def scan(turns: DataFrame) -> DataFrame:
    """(conv_id, lo, rows, illegal, cost, audit) of each conversation of ``flags``; lo is its first turn's number."""
    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    fault = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), CUT).otherwise(CLEAN)
    rows = turns.select("at", "conv_id", "initial", fault.alias("fault"), F.floor(F.col("at") / CHUNK).alias("chunk"))
    parts = materialize(rows.groupBy("chunk").applyInArrow(_leaf, f"conv_id {kind}, {PART}"), "parts")
    # a conversation over several chunks: its parts are counted from its first one, and multiplied in a tree
    spans = parts.groupBy("conv_id").agg(F.min("chunk").alias("from"), F.max("chunk").alias("to")).where("to > from")
    spans = materialize(spans.withColumnRenamed("conv_id", "c"), "spans")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = parts.join(spans, same, "left_anti")
    tree = parts.join(spans, same).withColumn("chunk", F.col("chunk") - F.col("from")).select(*parts.columns)
    height = spans.agg(F.max(F.col("to") - F.col("from"))).first()[0]
    while height:
        tree = materialize(tree.groupBy("conv_id", F.floor(F.col("chunk") / FAN).alias("branch")).applyInArrow(_branch, parts.schema), "tree")
        height //= FAN
    best = F.least(*[F.struct(F.col("costs")[s].alias("cost"), F.col("audits")[s].alias("audit")) for s in (START, ANSWERED)])
    return whole.unionByName(tree).select("conv_id", "lo", "rows", "illegal", best.alias("b")).select("conv_id", "lo", "rows", "illegal", "b.cost", "b.audit")


def edits(scanned: DataFrame) -> DataFrame:
    """(conv_id, lo, at, place, edit, new_role): a row for each initial of an audit but D.

    place counts what stays and what is inserted; at is null for what is inserted,
    and new_role for what is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv = batch.column(batch.schema.get_field_index("conv_id"))
            for k, (lo, audit) in enumerate(zip(batch["lo"].to_pylist(), batch["audit"].to_pylist())):
                for made in _walk(lo, audit):
                    yield pa.RecordBatch.from_arrays(
                        [conv.take(pa.array([k] * len(made), pa.int64())), pa.array([lo] * len(made), pa.int64())]
                        + [pa.array([m[c] for m in made], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                        ["conv_id", "lo", "at", "place", "edit", "new_role"],
                    )

    kind = scanned.schema["conv_id"].dataType.simpleString()
    return scanned.select("conv_id", "lo", "audit").mapInArrow(run, f"conv_id {kind}, lo long, at long, place long, edit string, new_role string")


def _walk(lo: int, audit: str) -> Iterator[list[tuple]]:
    """(at, place, edit, new_role) of the edits that leave a turn, a bounded number at a time."""
    at, place, state, made = lo, 0, START, []
    head = (len(audit) - audit.count("D")) % 2 == 1  # pairs stay, and one turn more only if the first is the system's
    for e in audit:
        if e != "D":
            if head and place == 0:
                state, who = HEAD, None
            else:
                state, who = NEXT[state]
            made.append((None if e == "I" else at, place, e, None if e == "K" else who))
            place += 1
            if len(made) == 10_000:
                yield made
                made = []
        at += e != "I"
    if made:
        yield made


def apply_edits(numbered: DataFrame, scanned: DataFrame) -> DataFrame:
    """(conv_id, lo, place, role, text, edit): the repaired turns."""
    e = materialize(edits(scanned), "edits")
    texts = numbered.select("at", F.col("role").alias("old_role"), "text")
    role = F.coalesce("new_role", "old_role").alias("role")
    kept = e.where("at is not null").join(texts, "at").select("conv_id", "lo", "place", role, "text", "edit")
    return kept.unionByName(e.where("at is null").select("conv_id", "lo", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit"))


def digests(repaired: DataFrame) -> DataFrame:
    """(lo, sha256): of ``role:text`` of each conversation's turns, one to a line, read as a stream and never put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h, done = None, None, []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["lo", "sha256"])

        for batch in batches:
            for lo, role, text in zip(batch["lo"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist()):
                if lo != at:
                    if h is not None:
                        done.append((at, h.hexdigest()))
                    at, h = lo, hashlib.sha256()
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if done:
                yield flush()
                done = []
        if h is not None:
            done.append((at, h.hexdigest()))
            yield flush()

    rows = repaired.select("lo", "place", "role", "text").repartition("lo").sortWithinPartitions("lo", "place")
    return rows.mapInArrow(run, "lo long, sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of turns (conv_id, turn, role, text) a row for each conversation, and the repaired turns.

    The first has conv_id, lo (which the turns have too), gaps, blank, duplicate,
    truncated, illegal, cost and audit.
    """
    numbered = ordered(rows)
    turns = materialize(flags(numbered), "turns")
    scanned = materialize(scan(turns), "scanned")
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = turns.groupBy("conv_id").agg(F.min("at").alias("lo"), F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    summary = faults.join(scanned.drop("conv_id", "rows"), "lo").select("conv_id", "lo", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, apply_edits(numbered, scanned)
