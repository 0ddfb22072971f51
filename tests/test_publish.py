"""Folders of tables whose manifest says which of them count."""

import pytest

from lodestrand import storage
from lodestrand.sources import reads as scan
from lodestrand.sources import sinks


def uniques(spark, *words):
    return spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "sequence string, count long")


def edges(spark, *rows):
    return spark.createDataFrame(rows, "id_a long, id_b long, length_a int, length_b int")


def lengths(spark, folder):
    return {n: sorted(r.sequence for r in scan.read_unique_table(spark, p).collect()) for n, p in scan.discover_lengths(spark, folder).items()}


def found(spark, folder, d=None):
    return sorted(tuple(r) for r in scan.read_edges(spark, folder, distance=d).collect())


def lost(*_):
    raise OSError("lost")


@pytest.mark.parametrize("dies_at", ["commit", "move"])
def test_a_write_that_dies_leaves_the_old_tables(spark, tmp_path, monkeypatch, dies_at):
    at, e = str(tmp_path / "n"), str(tmp_path / "e")
    sinks.write_length_tables(uniques(spark, "AC", "ACG"), at, single=False)
    sinks.write_edge_files(edges(spark, (0, 1, 2, 3)), e, 1, versioned=True)
    with monkeypatch.context() as m:
        m.setattr(storage, dies_at, lost)
        with pytest.raises(OSError):
            sinks.write_length_tables(uniques(spark, "GG", "GGGG"), at, single=False)
        with pytest.raises(OSError):
            sinks.write_edge_files(edges(spark, (5, 6, 2, 2)), e, 1, versioned=True)
    assert lengths(spark, at) == {2: ["AC"], 3: ["ACG"]} and found(spark, e) == [(0, 1)]
    sinks.write_length_tables(uniques(spark, "GG", "GGGG"), at, single=False)
    sinks.write_edge_files(edges(spark, (5, 6, 2, 2)), e, 1, versioned=True)
    for _ in range(2):  # nothing of the old state is left, before and after old folders go
        assert lengths(spark, at) == {2: ["GG"], 4: ["GGGG"]} and found(spark, e) == [(5, 6)]
        storage.vacuum(spark, at), storage.vacuum(spark, e)


def test_old_folders_are_deleted_when_asked(spark, tmp_path):
    at = str(tmp_path / "n")
    for word in ("AC", "GG", "TT"):
        sinks.write_length_tables(uniques(spark, word), at, single=False)
    assert len(list((tmp_path / "n").glob("v-*"))) == 3
    assert len(storage.vacuum(spark, at)) == 2 and len(list((tmp_path / "n").glob("v-*"))) == 1
    assert storage.vacuum(spark, at) == [] and lengths(spark, at) == {2: ["TT"]}


def test_files_and_versions_replace_each_other(spark, tmp_path):
    at = str(tmp_path / "n")
    sinks.write_length_tables(uniques(spark, "AC", "ACG"), at)
    assert sorted(p.name for p in (tmp_path / "n").glob("*.csv")) == ["length_2.csv", "length_3.csv"]
    sinks.write_length_tables(uniques(spark, "GG"), at, single=False)
    assert lengths(spark, at) == {2: ["GG"]} and not list((tmp_path / "n").glob("*.csv"))
    sinks.write_length_tables(uniques(spark, "TT", "TTTT"), at)
    assert lengths(spark, at) == {2: ["TT"], 4: ["TTTT"]}
    sinks.write_length_tables(uniques(spark, "TTTTT"), at)
    assert lengths(spark, at) == {5: ["TTTTT"]}


def test_a_table_replaced_by_a_version_does_not_come_back(spark, tmp_path, monkeypatch):
    """A writer that dies after its commit, before the old files at the top are deleted."""
    at = str(tmp_path / "n")
    sinks.write_length_tables(uniques(spark, "AC", "ACG"), at)
    real = storage.commit
    with monkeypatch.context() as m:
        m.setattr(storage, "commit", lambda *a: (real(*a), lost()))
        with pytest.raises(OSError):
            sinks.write_length_tables(uniques(spark, "GG"), at, single=False)
    assert (tmp_path / "n" / "length_3.csv").exists() and lengths(spark, at) == {2: ["GG"]}


def test_distances_and_pairs_of_lengths_are_replaced_for_themselves(spark, tmp_path):
    at = str(tmp_path / "e")
    sinks.write_edge_files(edges(spark, (0, 1, 2, 3), (0, 2, 2, 2)), at, 1, versioned=True)
    sinks.write_edge_files(edges(spark, (7, 8, 3, 3)), at, 2, versioned=True)
    with pytest.raises(ValueError):
        scan.read_edges(spark, at)
    sinks.write_edge_files(edges(spark, (3, 4, 3, 2)), at, 1, lengths=(3, 2), versioned=True)
    assert found(spark, at, 1) == [(0, 2), (3, 4)] and found(spark, at, 2) == [(7, 8)]
    sinks.write_edge_files(edges(spark), at, 1, versioned=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        found(spark, at, 1)
    assert found(spark, at) == [(7, 8)]


def test_commands_with_parts(spark, tmp_path, capsys):
    from lodestrand.cli import main

    sinks.write_unique_table(uniques(spark, "ACGTACGT", "ACGTACGA", "ACGTACG"), f"{tmp_path}/u.csv")
    main(["split", "-i", f"{tmp_path}/u.csv", "-o", f"{tmp_path}/n", "--parts"], spark)
    for parts in ([], ["--parts"], []):
        main(["all-pairs", "--length-dir", f"{tmp_path}/n", "-d", "1", "-o", f"{tmp_path}/e", *parts], spark)
        every = found(spark, f"{tmp_path}/e", 1)
        main(["pairs", "--length-dir", f"{tmp_path}/n", "--length-a", "8", "--length-b", "7", "-d", "1", "-o", f"{tmp_path}/e", *parts], spark)
        assert len(every) == 3 and found(spark, f"{tmp_path}/e", 1) == every
    main(["cluster", "--unique", f"{tmp_path}/u.csv", "--edges-dir", f"{tmp_path}/e", "-o", f"{tmp_path}/c.csv"], spark)
    assert len(open(f"{tmp_path}/c.csv").readlines()) == 2
