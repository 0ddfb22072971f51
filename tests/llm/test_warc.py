import hashlib

import duckdb
from pyspark.sql import functions as F

from lodestrand.llm import queries, warc
from tests.helpers import assert_same


def capture(spark, rows, out, **how):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, capture_id string")
    warc.write(df, out, key="page_id", uri="url", payload="html", **how)
    return warc.resolve(warc.transactions(warc.read(spark, out)))


def test_copies_are_revisits_of_the_greatest_key(spark, tmp_path):
    big, small = "é" * 500, "s" * 999
    rows = [(1, "http://a/", big, ""), (2, "http://b/", big, ""), (3, None, big, ""), (4, "u", small, ""), (5, "u", small, ""), (6, "u\r\nx: y", None, ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 99, "")]
    got = {int(r.metadata.fields["key"]): r for r in capture(spark, rows, f"{tmp_path}/w").collect()}
    assert {k: r.response.record_type for k, r in got.items()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response", 7: "response"}
    assert got[1].metadata.fields["refersToKey"] == "3" and got[1].response.payload_bytes == 0
    for k, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[k].full_bytes == len(raw) and got[k].full_sha1 == hashlib.sha1(raw).hexdigest()
        if got[k].response.record_type == "response":
            assert bytes(got[k].response.payload) == raw
        assert got[k].request.concurrent_to == got[k].capture_id == got[k].metadata.concurrent_to
    assert got[3].response.uri is None and got[6].response.uri == "u x: y"


def test_plain_files_and_their_layout(spark, tmp_path):
    capture(spark, [(1, "http://a/", "x" * 10, "")], f"{tmp_path}/w", compression="none")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: request\r\n") and raw.endswith(b"\r\n\r\n")
    assert [h["warc-type"] for h, _ in warc.parse(raw)] == ["request", "response", "metadata"]


def test_records_join_across_files_and_gaps(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", "p" * i) for i in range(40)], "page_id long, url string, html string").repartition(7)
    warc.write(df, f"{tmp_path}/w", key="page_id", uri="url", payload="html", file_bytes=8_000)
    records = warc.read(spark, f"{tmp_path}/w").repartition(5)
    assert records.count() == 120 and records.select("file").distinct().count() > 4
    whole = warc.transactions(records)
    assert whole.count() == 40 and whole.where("response is null or request is null or metadata is null").count() == 0
    lost = warc.transactions(records.where("record_type <> 'response'"))
    assert lost.count() == 40 and lost.where("response is null").count() == 40
    assert warc.transactions(records.union(records)).count() == 40


def test_rows(spark, tmp_path):
    none = capture(spark, [(None, "u", "a", ""), (None, "u", "b", ""), (1, "u", "c", ""), (1, "u", "c", "")], f"{tmp_path}/a")
    assert none.count() == 3
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/b", key="page_id", uri="url", payload="html")
    assert warc.transactions(warc.read(spark, f"{tmp_path}/b")).count() == 0


def test_query_against_sql(spark, sf_dir, oracle):
    got = queries.op6_warc(spark, sf_dir).toPandas()
    want = oracle.execute(queries.OP6_SQL).df()
    got["refers_to"], want["refers_to"] = got["refers_to"].astype("Int64"), want["refers_to"].astype("Int64")
    assert_same(got, want)


def test_rows_that_share_a_key_or_have_none_keep_their_payloads(spark, tmp_path):
    big, other = "b" * 2000, "o" * 2000
    rows = [(1, "u", big), (1, "u", other), (1, "v", other), (2, "u", big), (None, "u", "n"), (None, "v", "n"), (3, "u", "same"), (3, "u", "same")]
    got = capture(spark, [(*r, "") for r in rows], f"{tmp_path}/w").collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    found = sorted((r.metadata.fields.get("key") or "", r.response.uri, r.full_sha1, r.response.record_type) for r in got)
    kinds = {(1, big): "revisit"}
    assert found == sorted({("" if k is None else str(k), u, sha(h), kinds.get((k, h), "response")) for k, u, h in rows})
    assert [r.metadata.fields["copies"] for r in got if r.metadata.fields.get("key") == "3"] == ["2"]


def test_query_gives_each_row_of_pages(spark, tmp_path):
    rows = [(1, "u", "b" * 2000), (1, "u", "o" * 2000), (2, "u", "b" * 2000), (3, "u", "same"), (3, "u", "same"), (None, "u", "n"), (None, "u", "n"), (None, None, "b" * 2000), (4, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = queries.op6_warc(spark, str(tmp_path)).toPandas(), con.execute(queries.OP6_SQL).df()
    for c in ("page_id", "refers_to"):
        got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert_same(got, want)


def test_files_have_about_the_size_asked_for(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("x"), 20_000), F.col("id").cast("string")).alias("html")).coalesce(1)
    warc.write(df, f"{tmp_path}/w", key="page_id", uri="url", payload="html", file_bytes=1 << 20, compression="none")
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) >= 8 and max(sizes) < 1.2 * (1 << 20)
