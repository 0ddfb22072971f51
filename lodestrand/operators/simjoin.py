"""Similarity self-join of strings by edit distance, on either strand.

With at most d edits one of d + 1 parts of the shorter string survives in the
longer one, shifted by a bounded offset.  So both sides are expanded to seeds and
joined on the seed - an equi-join that Spark shuffles - and the bounded distance
is a residual predicate of that join.  A theta join on the distance alone would
be a Cartesian product.

Strings of up to 31 letters of the alphabet are numbers: two bits a letter, in one
long.  Their seeds are slices of it, so what is shuffled is a few longs, and most
candidates are rejected by shifts, XOR and bit_count: a letter of the shorter
string that equals the longer one's on none of the allowed diagonals costs an
edit.  Only what passes is written out as letters, for its distance.

Other strings have hashes as seeds and the set of their substrings of three
letters as filter: an edit changes three of them at most.  What passes looks its
letters up.

Two strings may share several seeds.  A pair is kept at the first one only, in the
order of shifts, which the two strings tell by themselves: nothing is grouped, and
so nothing is shuffled, after the distance is known.

Frequent seeds would make one task verify most candidates.  They are looked for
in a sample of the strings, on both sides, and each side of a frequent seed is dealt over salts and
repeated for the other's, so a task compares blocks of bounded size.  The sample
decides only how work is dealt, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.sequences import ALPHABET, is_valid, parts, piece, revcomp
from ..storage import materialize

#: Rows of one seed on a side above which it is salted, and rows to a salt; one string of SAMPLE is looked at.
HOT_SEED, SAMPLE = 1_000, 16
#: Letters that fit in a long at two bits each.
CODED = 31


#: The substrings of three letters that are compared as sets; one is a bit of a long.
GRAM = 3
GRAMS = ["".join(g) for g in product("ACGT", repeat=GRAM)]


def grams(s: Column, *, back: bool = False) -> Column:
    """Which of GRAMS a string, or its reverse complement, contains; those with other letters do not count."""
    own = [g[::-1].translate(str.maketrans("ACGT", "TGCA")) if back else g for g in GRAMS]
    bits = [1 << k if k < 63 else -(1 << 63) for k in range(len(own))]
    one = [F.when(F.contains(s, F.lit(g)), F.lit(bit)).otherwise(F.lit(0)).cast("long") for g, bit in zip(own, bits)]
    return reduce(lambda x, y: x.bitwiseOR(y), one)


def may_be_near(x: Column, y: Column, d: int) -> Column:
    """Whether strings with these ``grams`` can be within ``d`` edits."""
    gone = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b))) <= GRAM * d
    return gone(x, y) & gone(y, x)


def code(s: Column) -> Column:
    """The string as a number, two bits a letter, the first letter highest; equal lengths sort as the strings do."""
    digits = F.conv(F.translate(s, ALPHABET, "0123"), 4, 10)
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(digits.cast("long")).cast("long")


def letters(x: Column, n: Column) -> Column:
    """The string of ``n`` letters with this ``code``."""
    return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), n, "0"), "0123", ALPHABET)


def unmatched(a: Column, o: Column, low: Column, odd: Column, d: int) -> Column:
    """How many letters of a code equal those of another, moved up by its ``pad``, on none of the diagonals that ``d`` edits reach.

    ``low`` has the lower bit of each letter; ``odd`` is all ones where the diagonals are ``d`` only.
    """
    miss = low
    for k in range(d + 1):
        differs = a.bitwiseXOR(F.shiftright(o, 2 * k))
        differs = differs.bitwiseOR(F.shiftright(differs, 1))
        miss = miss.bitwiseAND(differs.bitwiseOR(odd) if k == d else differs)
    return F.bit_count(miss)


@dataclass(frozen=True)
class Place:
    """Where a seed is looked for: the longer string's surplus, the part, its shift, and whether the complement stands there."""

    delta: int
    part: int
    shift: int
    flip: bool


def places(d: int, complete: bool) -> list[Place]:
    """The seeds of the longer string, in the order in which a pair prefers them.

    Complete: if parts 0 to i of the shorter string are the first that hold fewer
    edits than they are, then i holds none, those before it hold i and those after
    it d - i at most.  So the shift of part i is at most i from the left end's and
    d - i from the right end's, and no pair is lost.  Otherwise: shifts from 0 to
    delta, of the seed and of its complement.
    """
    out = []
    for delta in range(d + 1):
        for i in range(d + 1):
            shifts = range(max(-i, delta - (d - i)), min(i, delta + d - i) + 1) if complete else range(delta + 1)
            out += [Place(delta, i, s, f) for s in shifts for f in ((False,) if complete else (False, True))]
    return out


def _part(n: Column, part: Column | int, d: int) -> tuple[Column, Column]:
    """Start and size of a part of ``n`` letters, as ``parts`` has them."""
    i = F.lit(part) if isinstance(part, int) else part
    size, more = F.floor(n / (d + 1)).cast("int"), n % (d + 1)
    return (i * size + F.least(i, more)).cast("int"), (size + F.when(i < more, 1).otherwise(0)).cast("int")


def _check(d: int) -> None:
    if d < 0:
        raise ValueError("the distance must not be negative")


def salted_join(left: DataFrame, right: DataFrame, key: list[str], left_of: str, right_of: str) -> DataFrame:
    """``left`` joined with ``right`` on ``key``; rows of frequent keys are dealt by ``left_of`` and ``right_of``."""

    def frequent(side: DataFrame, of: str, name: str) -> DataFrame:
        some = side.where(F.pmod(F.xxhash64(of), F.lit(SAMPLE)) == 0).groupBy(*key).agg(F.count("*").alias("rows"))
        return some.where(F.col("rows") * SAMPLE > HOT_SEED).select(*key, F.ceil(F.col("rows") * SAMPLE / HOT_SEED).cast("int").alias(name))

    hot = frequent(left, left_of, "l_salts").join(frequent(right, right_of, "r_salts"), key, "full")
    hot = materialize(hot.na.fill(1, ["l_salts", "r_salts"]), "hot-seeds")  # written, so that a short list is known as such
    one = F.lit(1)
    own = lambda of, n: F.pmod(F.xxhash64(of), F.coalesce(n, one)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, one) - 1))
    left = left.join(hot, key, "left").withColumn("l_salt", own(left_of, "l_salts")).withColumn("r_salt", every("r_salts")).drop("l_salts", "r_salts")
    right = right.join(hot, key, "left").withColumn("r_salt", own(right_of, "r_salts")).withColumn("l_salt", every("l_salts")).drop("l_salts", "r_salts")
    return left.join(right, [*key, "l_salt", "r_salt"]).drop("l_salt", "r_salt")


def _ones(letters_: int) -> int:
    return (1 << 2 * letters_) - 1


class Join:
    """One similarity join: strings (id, sequence), written once with what the seeds need."""

    def __init__(self, u: DataFrame, d: int, mode: str, strands: bool, lengths: tuple[int, int] | None):
        _check(d)
        if mode not in ("complete", "reference"):
            raise ValueError(f"unknown mode {mode}")
        if lengths is not None:
            u = u.where(F.length("sequence").isin(*lengths))
        self.d, self.complete, self.strands, self.lengths = d, mode == "complete", strands, lengths
        self.places = [p for p in places(d, self.complete) if lengths is None or p.delta == max(lengths) - min(lengths)]
        self.spark = u.sparkSession
        coded = is_valid("sequence") & (F.length("sequence") <= CODED - d // 2)
        u = u.where("sequence is not null").select("id", "sequence", F.length("sequence").alias("n"), coded.alias("coded"))
        u = u.withColumns({"code": F.when(F.col("coded"), code(F.col("sequence"))), "back": F.when(F.col("coded"), code(revcomp("sequence")))})
        if u.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism:
            u = u.repartition(self.spark.sparkContext.defaultParallelism)
        seen = Observation()
        self.u = materialize(u.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("coded")).alias("others"), F.collect_set(F.when(F.col("coded"), F.col("n"))).alias("n")), "strings")
        self.rows, self.others, self.coded_lengths = seen.get["rows"], seen.get["others"], set(seen.get["n"])

    def _meet(self, short: DataFrame, long_: DataFrame) -> DataFrame:
        """Rows with equal seeds; those of equal lengths once, from the smaller id."""
        salted = self.rows > HOT_SEED  # of fewer strings no seed is frequent
        c = salted_join(short, long_, ["key"], "a_id", "b_id") if salted else short.join(long_, "key")
        return c.where((F.col("m") < F.col("longer")) | (F.col("a_id") < F.col("b_id")))

    def bit(self, k: int) -> int:
        """Of a place among those of its delta; none if they are more than a long has."""
        own = [j for j, p in enumerate(self.places) if p.delta == self.places[k].delta]
        return 1 << own.index(k) if self.told else 0

    @property
    def told(self) -> bool:
        """Whether pairs tell their first place by themselves; otherwise, for very large distances too, they are made distinct."""
        return self.complete and self.d * self.d // 2 + self.d + 1 < 63

    # -- strings that are numbers

    def _seeds(self) -> tuple[DataFrame, DataFrame]:
        """Tables by length, of a few hundred rows at most: the parts of the shorter string, and the places of the longer one."""
        d, parts_, looked_for = self.d, [], []
        key = lambda m, part: 1 << 2 * m if d == 0 else (m * (d + 1) + part) << 32  # noqa: E731  nothing else has it and the seed's bits
        for m in sorted(self.coded_lengths if self.lengths is None else self.coded_lengths & {min(self.lengths)}):
            size, more = divmod(m, d + 1)
            at = [(i * size + min(i, more), size + (i < more)) for i in range(d + 1)]
            after = [2 * (m - st - sz) for st, sz in at]
            masks = [_ones(sz) << by for (_, sz), by in zip(at, after)]
            parts_ += [(m, key(m, i), after[i], _ones(at[i][1]), _ones(m) & 0x5555555555555555, masks) for i in range(d + 1)]
            earlier: dict[int, int] = {}  # a bit for each place of the same delta before
            for k, p in enumerate(self.places):
                n, (st, sz) = m + p.delta, at[p.part]
                if n in self.coded_lengths and st + p.shift >= 0 and st + p.shift + sz <= n:
                    start = n - st - p.shift - sz if p.flip else st + p.shift  # of the seed, or of its complement on the other strand
                    pad = (d - p.delta) // 2
                    looked_for.append((n, m, key(m, p.part), 2 * (n - start - sz), _ones(sz), p.flip, 2 * pad, -1 if p.delta + 2 * pad < d else 0, earlier.get(p.delta, 0)))
                    earlier[p.delta] = earlier.get(p.delta, 0) | self.bit(k)
        table = lambda rows, ddl: F.broadcast(self.spark.createDataFrame(rows, ddl))
        return (
            table(parts_, "n int, base long, after int, ones long, low long, masks array<long>"),
            table(looked_for, "n int, m int, base long, after int, ones long, flip boolean, pad int, odd long, earlier long"),
        )

    def among_coded(self) -> DataFrame:
        """Pairs of coded strings, found and verified by their codes."""
        d, strands = self.d, self.strands
        parts_, looked_for = self._seeds()
        u = self.u.where("coded").select("id", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("code", "back")])
        seed = lambda x: F.col("base").bitwiseOR(F.call_function("shiftright", x, F.col("after")).bitwiseAND(F.col("ones"))).alias("key")
        masks = [F.coalesce(F.col("masks")[i], F.lit(0)).alias(f"mask{i}") for i in range(d + 1)]
        short = u.join(parts_, "n").select(seed(F.col("code")), F.col("id").alias("a_id"), F.col("code").alias("a"), F.col("n").alias("m"), "low", *masks)

        p = u.join(looked_for, "n")
        up = lambda x: F.call_function("shiftleft", x, F.col("pad"))
        cols = [F.col("id").alias("b_id"), F.col("n").alias("longer"), "pad", "odd", "earlier"]
        a, low, odd = F.col("a"), F.col("low"), F.col("odd")
        near = lambda o: unmatched(a, F.col(o), low, odd, d) <= d
        if self.complete:
            sides = [F.struct(F.col("code").alias("o"), F.lit(False).alias("turned"))] + ([F.struct(F.col("back").alias("o"), F.lit(True).alias("turned"))] if strands else [])
            p = p.select("*", F.explode(F.array(*sides)).alias("side"))
            c = self._meet(short, p.select(seed(F.col("side.o")), *cols, up(F.col("side.o")).alias("o"), "side.turned")).where(near("o"))
            # a pair is kept at the first place at which its codes agree all over a part
            for k, place in enumerate(self.places if self.told else []):
                by = 2 * (place.delta - place.shift + (d - place.delta) // 2)
                agree = a.bitwiseXOR(F.shiftright("o", by)).bitwiseAND(F.col(f"mask{place.part}")) == 0
                c = c.where((F.col("longer") - F.col("m") != place.delta) | (F.col("earlier").bitwiseAND(F.lit(self.bit(k))) == 0) | ~agree)
            if not self.told:
                c = c.select("a_id", "b_id", "a", "o", "pad", "m", "longer", "turned").distinct()
        else:
            own = seed(F.when(F.col("flip"), F.col("back")).otherwise(F.col("code")))
            c = self._meet(short, p.select(own, *cols, up(F.col("code")).alias("o"), up(F.col("back")).alias("r")))
            c = c.where(near("o") | near("r") if strands else near("o"))
            c = c.select("a_id", "b_id", "a", "o", "pad", "m", "longer", F.lit(False).alias("turned")).distinct()
        o = letters(F.call_function("shiftright", F.col("o"), F.col("pad")), F.col("longer"))
        return self._verified(c.select("*", _once(F.struct(letters(a, F.col("m")).alias("a_text"), o.alias("o_text"))).alias("t")).select("*", "t.*"), first=self.complete)

    # -- any other strings

    def _looked_for(self, u: DataFrame) -> DataFrame:
        """A row for each place of each string, as the longer one: m is the shorter one's length, start and size are the seed's."""
        at = F.explode(F.array(*[F.struct(F.lit(p.delta).alias("delta"), F.lit(p.part).alias("part"), F.lit(p.shift).alias("shift"), F.lit(p.flip).alias("flip")) for p in self.places]))
        s = u.select("*", at.alias("p")).select("*", (F.col("n") - F.col("p.delta")).alias("m")).where("m >= 0")
        # shorter lengths that do not occur need no seeds
        s = s.join(self.u.select(F.col("n").alias("m")).distinct(), "m", "left_semi")
        start, size = _part(F.col("m"), F.col("p.part"), self.d)
        return s.select("*", (start + F.col("p.shift")).alias("start"), size.alias("size")).where("start >= 0 and start + size <= n")

    def among_others(self) -> DataFrame:
        """Pairs of strings of which one at least is not coded."""
        d, strands = self.d, self.strands
        around = F.explode(F.sequence(F.col("n") - d, F.col("n") + d))
        lengths = self.u.where("not coded").select("n").distinct().select(around.alias("n")).distinct()
        u = self.u.join(lengths, "n", "left_semi").withColumns({"grams": grams(F.col("sequence")), "back_grams": grams(F.col("sequence"), back=True)})
        u = materialize(u, "other-strings")
        key = lambda n, part, seed: F.xxhash64(n, part, seed).alias("key")
        start, size = _part(F.col("n"), F.col("part"), d)
        s = u.select("id", "n", "coded", "grams", "sequence", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("part"))
        short = s.select(key(F.col("n"), F.col("part"), piece(F.col("sequence"), start, size)), F.col("id").alias("a_id"), F.col("n").alias("m"), F.col("coded").alias("a_coded"), F.col("grams").alias("a_grams"))

        p = self._looked_for(u)
        cols = [F.col("id").alias("b_id"), F.col("n").alias("longer"), F.col("coded").alias("b_coded")]
        near = may_be_near(F.col("a_grams"), F.col("o_grams"), d)
        if self.complete:
            sides = [F.struct(F.col("sequence").alias("o"), "grams")] + ([F.struct(revcomp("sequence").alias("o"), F.col("back_grams").alias("grams"))] if strands else [])
            q = p.select("*", F.explode(F.array(*sides)).alias("side"))
            long_ = q.select(key(F.col("m"), F.col("p.part"), piece(F.col("side.o"), F.col("start"), F.col("size"))), *cols, F.col("side.grams").alias("o_grams"))
        else:
            there = piece(F.col("sequence"), F.col("start"), F.col("size"))
            long_ = p.select(key(F.col("m"), F.col("p.part"), F.when(F.col("p.flip"), revcomp(there)).otherwise(there)), *cols, F.col("grams").alias("o_grams"), "back_grams")
            near = near | may_be_near(F.col("a_grams"), F.col("back_grams"), d) if strands else near
        c = self._meet(short, long_).where("not (a_coded and b_coded)").where(near).select("a_id", "b_id", "m", "longer").distinct()
        if self.lengths is not None:
            c = c.where((F.col("m") == min(self.lengths)) & (F.col("longer") == max(self.lengths)))
        text = lambda w, name: u.select(F.col("id").alias(f"{w}_id"), F.col("sequence").alias(name))
        c = c.join(text("a", "a_text"), "a_id").join(text("b", "o_text"), "b_id")
        return self._verified(c.withColumn("turned", F.lit(False)), first=False)

    def _verified(self, c: DataFrame, *, first: bool) -> DataFrame:
        """(a_id, b_id, a_text, b_text, m, longer, distance) of pairs within d edits, a the shorter; both strands count.

        With ``first`` a pair comes once for each strand on which its codes agree, and is kept on the turned one only
        if the other one is too far; without, it comes once.
        """
        d = self.d
        c = c.select("*", _once(F.levenshtein("a_text", "o_text", d)).alias("here"))
        if not self.strands:
            c = c.where("here >= 0").withColumn("distance", F.col("here"))
        else:
            c = c.where("here >= 0") if first else c
            c = c.select("*", _once(F.levenshtein("a_text", revcomp("o_text"), d)).alias("other"))
            c = c.where("not turned or other < 0") if first else c.where("here >= 0 or other >= 0")
            c = c.withColumn("distance", F.least(F.when(F.col("here") >= 0, F.col("here")), F.when(F.col("other") >= 0, F.col("other"))))
        b = F.when(F.col("turned"), revcomp("o_text")).otherwise(F.col("o_text")).alias("b_text")
        return c.select("a_id", "b_id", "a_text", b, "m", "longer", "distance")

    def pairs(self) -> DataFrame:
        found = self.among_coded()
        return found.unionByName(self.among_others()) if self.others else found


def _once(x: Column) -> Column:
    """The expression as a row of its own: conditions on it are not pushed below, so it is neither computed twice nor made part of the join."""
    return F.explode(F.array(x))


def similar_pairs(
    uniques: DataFrame, d: int, *, mode: str = "complete", strands: bool = True, lengths: tuple[int, int] | None = None
) -> DataFrame:
    """(a, b, distance): distinct strings within ``d`` edits, on either strand if ``strands``.

    ``uniques`` has a column ``sequence`` of distinct strings; nulls have no
    partners.  a is the shorter string, or the smaller one.  ``mode="complete"``
    finds every pair; ``mode="reference"`` those that the classic seeding finds,
    with complemented seeds at the same offsets.  ``lengths`` keeps pairs of these
    two lengths only, and prunes before the seeds are made.
    """
    found = Join(uniques.select(F.monotonically_increasing_id().alias("id"), "sequence"), d, mode, strands, lengths).pairs()
    swap = (F.col("m") == F.col("longer")) & (F.col("a_text") > F.col("b_text"))  # of equal lengths the smaller id came first
    a, b = (F.when(swap, F.col(y)).otherwise(F.col(x)) for x, y in (("a_text", "b_text"), ("b_text", "a_text")))
    return found.select(a.alias("a"), b.alias("b"), "distance")


def similar_edges(uniques: DataFrame, d: int, *, mode: str = "complete", strands: bool = True, lengths: tuple[int, int] | None = None, with_lengths: bool = False) -> DataFrame:
    """(id_a, id_b, distance[, length_a, length_b]) with id_a < id_b: ``similar_pairs`` of uniques (seq_id, sequence), whose ids travel with the seeds.

    length_a is that of the shorter string, whichever id it has.
    """
    found = Join(uniques.select(F.col("seq_id").alias("id"), "sequence"), d, mode, strands, lengths).pairs()
    more = [F.col("m").alias("length_a"), F.col("longer").alias("length_b")] if with_lengths else []
    return found.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), "distance", *more)


def edges_by_id(pairs: DataFrame, uniques: DataFrame) -> DataFrame:
    """(id_a, id_b, distance) with id_a < id_b of pairs (a, b, distance), for pairs that were made without ids."""
    ids = uniques.select("seq_id", "sequence")
    e = pairs.join(ids.withColumnsRenamed({"seq_id": "x", "sequence": "a"}), "a").join(ids.withColumnsRenamed({"seq_id": "y", "sequence": "b"}), "b")
    return e.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "distance")


def raw_edges(uniques: DataFrame, d: int) -> DataFrame:
    """(id_a, id_b) in the layout of the classic edge files, from uniques (seq_id, sequence).

    Pairs of one length appear in both directions, and with a loop (i, i) for
    each i in a bucket of two entries or more, where a palindromic seed counts
    twice; pairs of two lengths appear once, the shorter first.
    """
    _check(d)
    ids = uniques.select("seq_id", "sequence")
    e = Join(ids.withColumnRenamed("seq_id", "id"), d, "reference", True, None).pairs().select(F.col("a_id").alias("x"), F.col("b_id").alias("y"), (F.col("m") == F.col("longer")).alias("same"))
    both = e.select(F.explode(F.when(F.col("same"), F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).otherwise(F.array(F.struct("x", "y")))).alias("p"))
    s = ids.select("seq_id", F.length("sequence").alias("n"), "sequence", F.explode(parts(F.length("sequence"), d + 1)).alias("p"))
    seed = piece(F.col("sequence"), F.col("p.st"), F.col("p.sz"))
    s = s.select("seq_id", "n", F.col("p.part").alias("part"), F.explode(F.array(seed, revcomp(seed))).alias("seed"))
    full = s.groupBy("n", "part", "seed").agg(F.count("*").alias("entries")).where("entries > 1").drop("entries")
    loops = s.join(full, ["n", "part", "seed"], "left_semi").select(F.col("seq_id").alias("id_a"), F.col("seq_id").alias("id_b")).distinct()
    return both.select(F.col("p.x").alias("id_a"), F.col("p.y").alias("id_b")).unionByName(loops)


def length_pairs(lengths: DataFrame, d: int) -> DataFrame:
    """(length_a, length_b): pairs of lengths that differ by ``d`` at most, a not the longer.

    The join is on the difference, which is exploded, not a theta join.
    """
    _check(d)
    n = lengths.select("length").distinct()
    b = n.select(F.col("length").alias("length_b"), F.explode(F.sequence(F.lit(0), F.lit(d))).alias("delta")).withColumn("length_a", (F.col("length_b") - F.col("delta")).cast("int"))
    return b.join(n.withColumnRenamed("length", "length_a"), "length_a").select("length_a", "length_b")


def seed_index(uniques: DataFrame, d: int) -> DataFrame:
    """(length, part, seed, entries): buckets of the inverted index; each string enters both strands of a part."""
    s = uniques.select("sequence", F.length("sequence").alias("length"), F.explode(parts(F.length("sequence"), d + 1)).alias("p"))
    seed = piece(F.col("sequence"), F.col("p.st"), F.col("p.sz"))
    s = s.select("length", F.col("p.part").alias("part"), F.explode(F.array(seed, revcomp(seed))).alias("seed"))
    return s.groupBy("length", "part", "seed").agg(F.count("*").alias("entries"))


def residual(a: Column, b: Column, d: int) -> Column:
    """Whether two strings are within ``d`` edits on either strand."""
    return (F.levenshtein(a, b, d) >= 0) | (F.levenshtein(a, revcomp(b), d) >= 0)
