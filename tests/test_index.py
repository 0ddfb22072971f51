"""The stored seed index against all pairs, and manifests."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand import storage
from lodestrand.operators import seedindex, simjoin
from lodestrand.operators.seedindex import SeedIndex


def strings(rng, n, length=12):
    """Strings with near ones, on both strands, among them; other letters, short and long ones too."""
    out = {"", "A", "AC", "ACGTNACGT", "ACGTNACGA", "acgt" * 3, "acgt" * 2 + "acga", "é" * 9, "é" * 8}
    while len(out) < n:
        s = "".join(rng.choices("ACGT", k=rng.choice([length - 1, length, length + 1, 3, 30, 31, 40])))
        out.add(s)
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(s))
            s = s[:i] + rng.choice(["", "A", "CG", "T"]) + s[i + 1 :]
            out.add(s)
        out.add(s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, sequence string")


def near(a, b, d):
    """Edits between two strings on the nearer strand, None beyond d."""

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    if abs(len(a) - len(b)) > d:
        return None
    n = min(edits(a, b), edits(a, b[::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return n if n <= d else None


def brute(rows, d):
    out = []
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if (n := near(a, b, d)) is not None:
                out.append((min(i, j), max(i, j), n))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("id_a", "id_b", "distance").collect())


@pytest.mark.parametrize("d", [0, 2, 3])
def test_batches_find_all_pairs_once(spark, tmp_path, d):
    rng = random.Random(d)
    rows = list(enumerate(strings(rng, 90)))
    rows += [(1000 + k, s) for k, s in rng.sample(rows, 5)]  # repeated strings are entries of their own
    rng.shuffle(rows)
    index = SeedIndex(spark, str(tmp_path / "i"), d)
    assert got(index.near(frame(spark, rows[:3]))) == []
    found = got(index.add(frame(spark, rows[:60]))) + got(index.add(frame(spark, [*rows[60:80], (-1, None)])))
    assert got(index.add(frame(spark, []))) == []
    again = SeedIndex(spark, str(tmp_path / "i"), d)
    asked = got(again.near(frame(spark, rows[80:])))
    assert sorted(found + got(again.add(frame(spark, rows[80:])))) == brute(rows, d)
    assert set(asked) <= set(brute(rows, d)) and len(asked) == len(set(asked))
    assert sorted((r.id, r.sequence) for r in again.strings().collect()) == sorted(rows)


def test_compacted_index_finds_the_same(spark, tmp_path):
    rows = list(enumerate(strings(random.Random(9), 60)))
    index = SeedIndex(spark, str(tmp_path / "i"), 2)
    index.add(frame(spark, rows[:20]))
    index.add(frame(spark, rows[20:40]))
    before, old = got(index.near(frame(spark, rows[40:]))), index.generations()
    index.compact()
    assert len(index.generations()) == 1 and got(index.near(frame(spark, rows[40:]))) == before
    assert storage.vacuum(spark, index.folder) == sorted(old)
    assert got(index.near(frame(spark, rows[40:]))) == before


def test_frequent_keys_on_either_side(spark, tmp_path, monkeypatch):
    """Keys of many stored strings are salted, keys of many new ones joined apart."""
    monkeypatch.setattr(seedindex, "HOT_SEED", 4)
    monkeypatch.setattr(seedindex, "SAMPLE", 1)
    monkeypatch.setattr(simjoin, "HOT_SEED", 4)
    monkeypatch.setattr(simjoin, "SAMPLE", 1)
    rng = random.Random(4)
    rows = list(enumerate({"ACGTAC" + "".join(rng.choices("ACGT", k=4)) for _ in range(60)}))
    index = SeedIndex(spark, str(tmp_path / "i"), 1)
    found = got(index.add(frame(spark, rows[:30]))) + got(index.add(frame(spark, rows[30:])))
    assert sorted(found) == brute(rows, 1) and found
    assert index._stored(index.generations()[0]).agg(F.max("salt")).first()[0] > 0


def test_stored_rows_are_not_shuffled(spark, tmp_path, capsys):
    rows = list(enumerate(strings(random.Random(5), 60)))
    index = SeedIndex(spark, str(tmp_path / "i"), 1, buckets=4)
    index.add(frame(spark, rows[:50]))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        index.near(frame(spark, rows[50:])).explain()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    plan = capsys.readouterr().out.split("\n")
    scan = next(k for k, line in enumerate(plan) if "FileScan" in line and "a_code" not in line and "Bucketed: true" in line)
    depth = lambda k: len(plan[k]) - len(plan[k].lstrip(" :+-"))
    at, above = depth(scan), []
    for k in range(scan, -1, -1):
        if depth(k) < at:
            at = depth(k)
            above.append(plan[k])
    assert "SortMergeJoin" in "".join(above) and not any("Exchange" in line for line in above)


def test_a_batch_that_failed_leaves_the_index(spark, tmp_path, monkeypatch):
    rows = list(enumerate(strings(random.Random(6), 40)))
    index = SeedIndex(spark, str(tmp_path / "i"), 1)
    first = got(index.add(frame(spark, rows[:20])))
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.add(frame(spark, rows[20:]))
    again = SeedIndex(spark, str(tmp_path / "i"), 1)
    assert len(again.generations()) == 1
    assert sorted(first + got(again.add(frame(spark, rows[20:])))) == brute(rows, 1)
    with pytest.raises(ValueError):
        SeedIndex(spark, str(tmp_path / "i"), 2)


def test_manifests(spark, tmp_path):
    at = str(tmp_path / "m")
    assert storage.committed(spark, at) is None
    for k in range(11):
        storage.commit(spark, at, {"n": k, "é": [1]})
    assert storage.committed(spark, at) == {"n": 10, "é": [1]}
