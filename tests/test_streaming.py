"""Unique counts over streams: what arrives in several files, and event-time windows."""

from datetime import datetime

from pyspark.sql import functions as F

from lodestrand.streaming import unique as stream


def test_state_spans_batches(spark, tmp_path):
    src = f"{tmp_path}/in"
    for rows in ([(1, "AC"), (2, "AN")], [(3, "AC"), (4, "GG")]):
        spark.createDataFrame(rows, "read_idx long, sequence string").coalesce(1).write.mode("append").parquet(src)
    lines = spark.readStream.schema("read_idx long, sequence string").option("maxFilesPerTrigger", 1).parquet(src)
    got = {(r.sequence, r["count"], r.first_seen) for r in stream.run_available(stream.unique_counts(lines)).collect()}
    assert got == {("AC", 2, 1), ("GG", 1, 4)}


def test_windows_leave_out_late_reads(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    at = lambda m: datetime(2024, 1, 1, 0, m)
    kind = "at timestamp, sequence string"

    def run():
        lines = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
        counts = stream.windowed_counts(lines, "at", "10 minutes", "5 minutes").select(F.col("window.start").alias("start"), "sequence", "count")
        counts.writeStream.outputMode("append").option("checkpointLocation", f"{out}-log").format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()

    for rows in ([(at(1), "AC"), (at(9), "AC"), (at(9), "nn")], [(at(30), "GG")], [(at(2), "AC")], [(at(59), "GG")]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        run()
    got = {(r.start.minute, r.sequence, r["count"]) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "AC", 2), (30, "GG", 1)}


def test_online_groups_whatever_the_micro_batches_and_after_a_restart(spark, tmp_path):
    import random

    from lodestrand.operators import greedy, unique
    from lodestrand.streaming.greedy import OnlineGreedy

    rng = random.Random(4)
    rows = [(k, "".join(rng.choice("ACGN" if k % 20 == 0 else "ACG") for _ in range(rng.choice([5, 6])))) for k in range(150)]
    schema = "read_idx long, sequence string"
    want = sorted(map(tuple, greedy.greedy_seen(unique.unique_sequences(spark.createDataFrame(rows, schema)).drop("length"), 2).collect()))
    for cuts, order in (((40, 90, 91), False), ((), False), ((30, 60), True)):
        parts = [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)))]
        online = OnlineGreedy(spark, str(tmp_path / f"state{len(cuts)}{order}"), 2)
        for k, part in enumerate(reversed(parts) if order else parts):
            online.add(spark.createDataFrame(part, schema), k)
        assert sorted(map(tuple, online.groups().select("root", "sequence", "count", "first_seen", "root_first_seen").collect())) == want
    # a micro-batch that fails after it has written pairs is repeated by another run
    folder = str(tmp_path / "broken")
    OnlineGreedy(spark, folder, 2).add(spark.createDataFrame(rows[:50], schema), 0)
    spark.createDataFrame([("AAAAA", "CCCCC")], "s string, t string").write.parquet(f"{folder}/near/1")
    again = OnlineGreedy(spark, folder, 2)
    again.add(spark.createDataFrame(rows[50:], schema), 1)
    again.add(spark.createDataFrame(rows[50:], schema), 1)
    assert sorted(map(tuple, again.groups().select("root", "sequence", "count", "first_seen", "root_first_seen").collect())) == want


def test_a_stream_of_reads_goes_on_where_it_ended(spark, tmp_path):
    from lodestrand.operators import greedy, unique
    from lodestrand.streaming.greedy import OnlineGreedy

    schema = "read_idx long, sequence string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    first, second = [(0, "ACGT"), (1, "ACGA"), (2, "TTTT")], [(3, "ACGT"), (4, "TTTA"), (5, "ACCA")]
    put(first)
    OnlineGreedy(spark, str(tmp_path / "state")).run(stream(), str(tmp_path / "checkpoint"))
    put(second)
    online = OnlineGreedy(spark, str(tmp_path / "state"))
    online.run(stream(), str(tmp_path / "checkpoint"))
    want = greedy.greedy_seen(unique.unique_sequences(spark.createDataFrame(first + second, schema)).drop("length"))
    assert sorted(map(tuple, online.groups().select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_the_query_writes_a_large_table_by_as_many_tasks_as_its_scan_has(spark, sf_dir, tmp_path, monkeypatch):
    from lodestrand.plans import queries

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").repartition(13).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, queries.QUERIES["greedy_seen"](spark, sf_dir).collect()))
    monkeypatch.setattr(queries, "scratch", lambda s, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 20))
    try:
        got = sorted(map(tuple, queries.QUERIES["greedy_stream"](spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert len(list((tmp_path / "arrivals" / "reads").rglob("*.parquet"))) == 65
    assert len(list((tmp_path / "arrivals" / "state" / "done").glob("[0-9]*"))) == 5
