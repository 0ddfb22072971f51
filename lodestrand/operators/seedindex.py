"""A stored inverted index of strings, which new strings are compared with as they come.

The index holds each string once for each of its d + 1 parts: by the pigeonhole
principle one part survives d edits, at a bounded shift, in whichever string is the
longer one.  So new strings alone are expanded to all places, and what is stored is
d + 1 rows a string, as bucketed tables by (key, salt): a batch is dealt into as
many parts and meets them there, and no stored row moves.

Each batch is a generation: tables that are written once and named by the manifest
of the folder when all is done, so an index is never seen half-written, and a batch
that failed leaves it as it was.  ``compact`` makes one generation of all.

Keys that have many strings are dealt over salts when they are written, and a new
string looks all salts of its key up.  Keys that many new strings share are joined
apart, by a join that deals them; only stored rows of these keys move for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import is_valid, piece, revcomp
from ..storage import commit, committed, materialize, scratch, version
from .simjoin import CODED, HOT_SEED, SAMPLE, Place, _check, _once, _part, code, salted_join, unmatched

STORED = "key long, salt int, id long, part int, sequence string, code long"
EDGES = "id_a long, id_b long, distance int"


def signed_places(d: int) -> list[Place]:
    """Where a part of a stored string may stand in a new one that is longer by delta, which may be negative; see ``simjoin.places``."""
    return [
        Place(delta, i, shift, False)
        for delta in range(-d, d + 1)
        for i in range(d + 1)
        for shift in range(max(-i, delta - (d - i)), min(i, delta + d - i) + 1)
    ]


def _key(m: Column, part: Column, seed: Column) -> Column:
    return F.xxhash64(m.cast("int"), part.cast("int"), seed)


class SeedIndex:
    """Strings (id, sequence) stored under ``folder``, a shared one, for searches within ``d`` edits on either strand if ``strands``.

    Strings are compared as they are: one that is stored already is another
    entry, at distance 0.  Null strings are left out; ids must be distinct.
    Only one writer at a time may add to an index.
    """

    def __init__(self, spark: SparkSession, folder: str, d: int, *, strands: bool = True, buckets: int | None = None):
        _check(d)
        self.spark, self.folder, self.d, self.strands = spark, folder.rstrip("/"), d, strands
        found = committed(spark, self.folder)
        if found is not None and (found["d"], found["strands"]) != (d, strands):
            raise ValueError(f"the index of {folder} is for distance {found['d']}, strands {found['strands']}")
        self.buckets = found["buckets"] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.places = signed_places(d)

    # -- what is stored

    def generations(self) -> list[str]:
        found = committed(self.spark, self.folder)
        return found["generations"] if found else []

    def _commit(self, generations: list[str]) -> None:
        commit(self.spark, self.folder, {"d": self.d, "strands": self.strands, "buckets": self.buckets, "generations": generations})

    def _stored(self, generation: str) -> DataFrame:
        """The bucketed rows of a generation, also of one that another session wrote."""
        table = f"lodestrand_{generation.replace('-', '_')}"
        if not self.spark.catalog.tableExists(table):
            at = f"{self.folder}/{generation}/seeds".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({STORED}) USING parquet CLUSTERED BY (key, salt) SORTED BY (key, salt) INTO {self.buckets} BUCKETS LOCATION '{at}'")
        return self.spark.table(table)

    def _of(self, generation: str, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{generation}/{name}")

    def strings(self) -> DataFrame:
        """(id, sequence) of all that is stored."""
        every = [self._stored(g).where("part = 0").select("id", "sequence") for g in self.generations()]
        return reduce(DataFrame.unionByName, every) if every else self.spark.createDataFrame([], "id long, sequence string")

    def _write(self, strings: DataFrame) -> str:
        """A generation of these strings, which the manifest does not name yet."""
        generation = version()
        at = f"{self.folder}/{generation}"
        s = strings.select("id", "sequence", self._code().alias("code"), F.explode(F.sequence(F.lit(0), F.lit(self.d))).alias("part"))
        start, size = _part(F.length("sequence"), F.col("part"), self.d)
        rows = s.select(_key(F.length("sequence"), F.col("part"), piece(F.col("sequence"), start, size)).alias("key"), "id", "part", "sequence", "code")
        full = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > HOT_SEED)
        full.select("key", F.ceil(F.col("rows") / HOT_SEED).cast("int").alias("salts")).write.parquet(f"{at}/hot")
        strings.select(F.length("sequence").alias("m")).distinct().write.parquet(f"{at}/lengths")
        salts = F.coalesce("salts", F.lit(1))
        dealt = rows.join(self._of(generation, "hot", "key long, salts int"), "key", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
        whole = dealt.select("key", "salt", "id", "part", "sequence", "code").repartition(self.buckets, "key", "salt")
        table = f"lodestrand_{generation.replace('-', '_')}"
        whole.write.format("parquet").bucketBy(self.buckets, "key", "salt").sortBy("key", "salt").option("path", f"{at}/seeds").option("compression", "zstd").saveAsTable(table)
        return generation

    # -- what is looked for

    def _code(self) -> Column:
        """Of strings that fit in a long with all diagonals; null for others."""
        n = F.length("sequence")
        return F.when(is_valid("sequence") & (n > 0) & (n <= CODED - self.d // 2), code(F.col("sequence")))

    def _looked_for(self, new: DataFrame, lengths: DataFrame) -> DataFrame:
        """A row for each place of each new string and strand, for stored strings of length m."""
        d = self.d
        sides = [F.struct(F.col("sequence").alias("o"), F.lit(False).alias("turned"))] + ([F.struct(revcomp("sequence").alias("o"), F.lit(True).alias("turned"))] if self.strands else [])
        sided = new.select("id", F.explode(F.array(*sides)).alias("side")).select("id", F.col("side.o").alias("sequence"), "side.turned")
        s = sided.select("*", self._code().alias("o_code"), F.length("sequence").alias("n"))
        at = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(p.delta).alias("delta"), F.lit(p.part).alias("part"), F.lit(p.shift).alias("shift")) for k, p in enumerate(self.places)]))
        s = s.select("*", at.alias("p")).select("*", "p.*", (F.col("n") - F.col("p.delta")).alias("m")).join(lengths, "m", "left_semi")
        start, size = _part(F.col("m"), F.col("part"), d)
        start = start + F.col("shift")
        s = s.where((start >= 0) & (start + size <= F.col("n")))
        pad = F.floor((F.lit(d) - F.col("delta")) / 2).cast("int")
        odd = F.when(F.col("delta") + 2 * pad < d, F.lit(-1)).otherwise(F.lit(0)).cast("long")
        up = F.call_function("shiftleft", F.col("o_code"), 2 * pad)
        return s.select(_key(F.col("m"), F.col("part"), piece(F.col("sequence"), start, size)).alias("key"), F.col("id").alias("b_id"), F.col("sequence").alias("o"), up.alias("o_code"), odd.alias("odd"), "turned", "delta", "m", "place")

    def _first_place(self) -> Column:
        """The first place at which a part of ``a`` stands in ``o``; a pair is kept there only, so nothing is grouped afterwards."""
        first = F
        for k, p in enumerate(self.places):
            start, size = _part(F.col("m"), p.part, self.d)
            fits = (start + p.shift >= 0) & (start + p.shift + size <= F.col("m") + p.delta)
            same = piece(F.col("a"), start, size) == piece(F.col("o"), start + p.shift, size)
            first = first.when((F.col("delta") == p.delta) & fits & same, F.lit(k))
        return first

    def _shared(self, p: DataFrame) -> DataFrame | None:
        """Keys that many new strings share, by a sample; None if there are none."""
        some = p.where(F.pmod(F.xxhash64("b_id"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("rows"))
        seen = Observation()
        shared = materialize(some.where(F.col("rows") * SAMPLE > HOT_SEED).select("key").observe(seen, F.count("*").alias("keys")), "shared-seeds")
        return shared if seen.get["keys"] else None

    def _meet(self, new: DataFrame, generation: str, *, own: bool) -> DataFrame:
        """(id_a, id_b, distance) of new strings with those of a generation; ``own``: with each other, each pair once."""
        d, one = self.d, F.lit(1)
        stored = self._stored(generation).select("key", "salt", F.col("id").alias("a_id"), F.col("sequence").alias("a"), F.col("code").alias("a_code"))
        p = self._looked_for(new, self._of(generation, "lengths", "m int"))
        shared = self._shared(p) if new._rows > HOT_SEED else None  # of fewer strings no key is frequent
        hot = self._of(generation, "hot", "key long, salts int")
        q = (p if shared is None else p.join(shared, "key", "left_anti")).join(hot, "key", "left")
        q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", one) - 1))).drop("salts")
        # by sort and merge the new strings stream past the few rows of a stored key; a small batch may be broadcast instead
        c = q.join(stored, ["key", "salt"]).drop("salt")
        if shared is not None:
            apart = stored.drop("salt").join(shared, "key", "left_semi")
            c = c.unionByName(salted_join(apart, p.join(shared, "key", "left_semi"), ["key"], "a_id", "b_id"))
        if own:
            c = c.where((F.col("delta") > 0) | ((F.col("delta") == 0) & (F.col("a_id") < F.col("b_id"))))
        low = F.call_function("shiftrightunsigned", F.lit(0x5555555555555555), 64 - 2 * F.col("m"))
        both = F.col("a_code").isNotNull() & F.col("o_code").isNotNull()
        c = c.where(F.when(both, unmatched(F.col("a_code"), F.col("o_code"), low, F.col("odd"), d) <= d).otherwise(F.lit(True)))
        c = c.where(self._first_place() == F.col("place")).select("*", _once(F.levenshtein("a", "o", d)).alias("here")).where("here >= 0")
        c = c.select("*", _once(F.levenshtein("a", revcomp("o"), d)).alias("other")) if self.strands else c.withColumn("other", F.lit(-1))
        # on the turned strand a pair is kept only if it is too far on the other one
        c = c.where("not turned or other < 0")
        distance = F.when(F.col("other") >= 0, F.least("here", "other")).otherwise(F.col("here"))
        return c.select(F.least("a_id", "b_id").alias("id_a"), F.greatest("a_id", "b_id").alias("id_b"), distance.alias("distance"))

    def _given(self, strings: DataFrame) -> DataFrame:
        seen = Observation()
        new = strings.where("sequence is not null").select(F.col("id").cast("long").alias("id"), "sequence").observe(seen, F.count("*").alias("rows"))
        new = materialize(new, "new-strings")
        new._rows = seen.get["rows"]
        return new

    def near(self, strings: DataFrame) -> DataFrame:
        """(id_a, id_b, distance) of strings (id, sequence), with ids that the index has not, with what is stored; they are not added."""
        new = self._given(strings)
        every = [self._meet(new, g, own=False) for g in self.generations()]
        return reduce(DataFrame.unionByName, every) if every else self.spark.createDataFrame([], EDGES)

    def add(self, strings: DataFrame) -> DataFrame:
        """Store strings (id, sequence); (id_a, id_b, distance) of them with each other and with all that were stored before.

        The pairs are written before the strings count as stored, so after a failure the batch is simply added again.
        """
        new, before = self._given(strings), self.generations()
        generation = self._write(new)
        every = [self._meet(new, g, own=False) for g in before] + [self._meet(new, generation, own=True)]
        found = materialize(reduce(DataFrame.unionByName, every), "new-edges")
        self._commit([*before, generation])
        return found

    def compact(self) -> None:
        """Make one generation of all; older folders stay for their readers until ``storage.vacuum``."""
        if len(self.generations()) > 1:
            self._commit([self._write(self.strings())])


def edges_in_batches(strings: DataFrame, d: int, batch: Column, batches: int) -> DataFrame:
    """The edges of uniques (seq_id, sequence) that an index finds which gets them in batches 0, 1, ... by the number ``batch``."""
    spark = strings.sparkSession
    index = SeedIndex(spark, scratch(spark, "seed-index"), d)
    u = materialize(strings.select(F.col("seq_id").alias("id"), "sequence", batch.alias("batch")), "batches")
    return reduce(DataFrame.unionByName, [index.add(u.where(F.col("batch") == k)) for k in range(batches)])
