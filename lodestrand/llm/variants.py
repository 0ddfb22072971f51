"""Spelling variants: words that one edit turns into each other, and the forms they go back to.

Of two words that differ by one inserted, deleted or replaced letter, either the
first half or the last half is intact.  So words are looked up in two sorted
dictionaries, of the words and of the words read backwards: neighbours share a
block of equal first halves in one or of equal last halves in the other.  Both
members of a pair count halves by the shorter one, so a word enters the blocks of
its own length and, as the longer member, those of the length below.

A block with more than LIMIT members is subdivided: the edit is in the first or
the second half of what the members don't share yet, so each enters two blocks
that share more.  A block that is open at one place can't be divided further and
has as many members as the alphabet has letters at most.  Blocks are then scanned
in sorted order (a merge join of the dictionary with itself) and the pairs of a
block are verified.  A pair is kept in the one block whose open places hold its
first difference, so nothing has to be made distinct afterwards.

Defined results: a null text has no words; a null id counts as an empty one; a
table without words gives no rows.  Repeated rows count as often as they occur.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import discard, materialize

#: Members of a block above which it is subdivided.
LIMIT = 32
#: The letters of words.
LETTERS = "A-Za-zÀ-ÿ"
KEY = ["kind", "m", "x", "y", "head", "tail"]


def runs(text: Column | str, least: int) -> Column:
    """The maximal runs of letters in a text that have ``least`` letters or more, A to Z lower-cased."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))


def damaged(word: Column, key: Column, *, one_in: int = 31) -> Column:
    """The word without one letter, for one in ``one_in`` of the (key, word), chosen by their CRC-32."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.left(word, at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(df: DataFrame, *, text: str = "text", key: str | None = None, least: int = 7, occurrences: int = 2) -> DataFrame:
    """(word, n): words of ``least`` letters or more that occur ``occurrences`` times or more; with ``key`` they are ``damaged`` first."""
    id_ = [F.col(f"`{key}`").alias("key")] if key else []
    words = df.select(*id_, F.explode(runs(F.col(f"`{text}`"), least)).alias("word"))
    if key:
        words = words.select(damaged(F.col("word"), F.col("key")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def _in_block(members: DataFrame, x: Column, y: Column) -> DataFrame:
    """Members with the block of the open places x to y: what is before them and, read backwards, what is after them."""
    behind = F.col("m") - F.col("hole") - y
    return members.withColumns({"x": x.cast("int"), "y": y.cast("int")}).withColumns(
        {"head": F.left("word", F.col("x")), "tail": F.left(F.reverse("word"), behind.cast("int"))}
    )


def _halved(members: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each member in the block of the first half of the open places low to high, and in that of the second."""
    mid = F.floor((low + high + 1) / 2)
    halves = F.array(F.struct(low.alias("x"), (mid - 1).alias("y")), F.struct(mid.alias("x"), high.alias("y")))
    both = members.withColumn("part", F.explode(halves)).where("part.y >= part.x")
    return _in_block(both, F.col("part.x"), F.col("part.y")).drop("part")


def _members(words: DataFrame) -> DataFrame:
    """Each word in its blocks of the two dictionaries.

    kind R: a letter at places 0 to m - 1 is replaced.  kind I: one is inserted at
    places 0 to m of the shorter word, whose length is m; the other is ``longer``.
    """
    size = F.length("word")
    role = lambda kind, m, hole, longer: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.lit(hole).alias("hole"), F.lit(longer).alias("longer"))
    roles = F.array(role("R", size, 1, False), role("I", size, 0, False), role("I", size - 1, 0, True))
    each = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*")
    return _halved(each, F.lit(0), F.col("m") - F.col("hole"))


def blocks(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, kind, m, x, y, head, tail, longer): members of blocks of ``limit`` at most, or open at one place."""
    cur, settled = materialize(_members(words), "blocks"), []
    while True:
        # counted before anything is gathered; few blocks are large, and their list is written so that this is known
        large = materialize(cur.groupBy(*KEY).count().where((F.col("count") > limit) & (F.col("y") > F.col("x"))).select(*KEY), "large-blocks")
        settled.append(cur.join(large, KEY, "left_anti"))
        left = Observation()
        cur = materialize(_halved(cur.join(large, KEY, "left_semi"), F.col("x"), F.col("y")).observe(left, F.count("*").alias("n")), "blocks")
        if not left.get["n"]:
            break
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, a_n, b, b_n): words of (word, n) that one edit turns into each other, each pair once."""
    found = blocks(words, limit)
    side = lambda w: found.select(*KEY, F.col("word").alias(w), F.col("n").alias(f"{w}_n"), F.col("longer").alias(f"{w}_longer"))
    both = side("a").join(side("b"), KEY)
    replaced = (F.col("kind") == "R") & (F.col("a") < F.col("b"))
    # of the places where the letter may have been inserted the last one counts
    here = (F.col("y") == F.col("m")) | (F.left("a", F.col("y") + 1) != F.left("b", F.col("y") + 1))
    inserted = (F.col("kind") == "I") & ~F.col("a_longer") & F.col("b_longer") & here
    return both.where(replaced | inserted).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word that following the forms reaches, by pointer jumping."""
    cur = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        moved = Observation()
        up = cur.select(F.col("word").alias("root"), F.col("root").alias("up"))
        step = cur.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        old, cur = cur, materialize(step.observe(moved, F.count_if("moved").alias("n")).select("word", "root"), "roots")
        discard(old)
        if not moved.get["n"]:
            return cur


def group(words: DataFrame, *, factor: int = 10, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is its near word of largest n, of equal ones the first in code
    point order, if that n is ``factor`` times the word's own or more; root is the
    last of the chain of forms, the word itself if it has none.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = near_pairs(words, limit)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    near = pairs.select(F.explode(ways).alias("p")).groupBy("p.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("p.near_n")).alias("less"), F.col("p.near").alias("near"))).alias("top"))
    is_form = -F.col("top.less") >= factor * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("top.near")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n")
    )
    found = materialize(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
