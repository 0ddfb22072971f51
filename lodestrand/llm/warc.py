"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: a request, a response or revisit, and
metadata.  The request and the metadata name the response through
WARC-Concurrent-To; records of one capture may lie in different files.  The
reader parses files by Content-Length, and the assembly joins the records of
each capture to one nested row.

Archives are written by Spark's text writer, each record closed by the two line
ends that the format asks for, so files appear under Spark's commit protocol on
any file system that Spark knows.

Rows: a null payload is an empty one; null URIs are written as an empty field and
read back as null.  Rows equal in key, URI and payload are one capture, whose
metadata says how many they are; all others are captures of their own.  Rows
without a key are always whole.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, ship
from .common import BATCH_BYTES, slices

#: Fixed values of the format.
VERSION, CRLF = "WARC/1.1", "\r\n"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 1_000
#: What the heads of a capture's three records take, about.
HEAD_BYTES = 1_500
RECORD = (
    "file string, record_id string, record_type string, uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, content_type string, content_length long, http_headers string, payload_bytes long, payload_sha1 string, fields map<string,string>, payload binary"
)


def uuid_of(*key: Column) -> Column:
    """A URN that depends on the key only."""
    h = F.md5(F.concat_ws("|", *key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def revisits(pages: DataFrame, key: str, digest: str, size: str, uri: str, *, least: int = LEAST_REVISIT) -> DataFrame:
    """(key, digest, original, original_uri) of narrow rows (key, digest, size, uri): the capture that holds the payload.

    It is the greatest key of those with the digest; rows below the size limit
    hold their own.  Keys are pre-aggregated by digest before they are shuffled,
    and the join back is of narrow rows, whose hot digests Spark can split.
    """
    large = pages.where(F.col(size) >= least)
    greatest = large.groupBy(F.col(digest).alias("_d")).agg(F.max(F.struct(F.col(key).alias("k"), F.col(uri).alias("u"))).alias("top"), F.count("*").alias("_n")).where("_n > 1").select("_d", F.col("top.k").alias("original"), F.col("top.u").alias("original_uri"))
    return large.join(greatest, large[digest] == greatest["_d"]).where(F.col(key) != F.col("original")).groupBy(F.col(key).alias("_key"), F.col(digest).alias("_digest")).agg(F.max("original").alias("original"), F.max("original_uri").alias("original_uri"))


def http_head(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit(VERSION)]
    for name, value in fields:
        head.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value)))
    head.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF * 2), block)


def write(df: DataFrame, out: str, *, key: str, uri: str, payload: str, date: str = "2024-01-01T00:00:00Z", least: int = LEAST_REVISIT, file_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Write each row of ``df`` as a capture to the folder ``out``, gzipped by file or ``none``.

    Files have about ``file_bytes`` before compression.

    Of captures with equal payloads of at least ``least`` bytes, that with the greatest key is a response and the others are
    revisits of it.
    """
    spark = df.sparkSession
    ship(spark)
    pages = df.select(F.col(key).alias("key"), F.col(uri).alias("uri"), F.coalesce(payload, F.lit("")).alias("html"))
    pages = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    narrow = materialize(pages.select("key", "sha1", "size", "uri"), "warc-digests")
    again = revisits(narrow, "key", "sha1", "size", "uri", least=least)
    # what there is to say of a capture but its payload, for those of which there is something; a short list leaves the payloads where they are
    same = narrow.groupBy("key", "sha1", "uri").agg(F.count("*").alias("copies"))
    notes = same.join(again, (same.key == again._key) & (same.sha1 == again._digest), "left").drop("_key", "_digest")
    notes = materialize(notes.where("copies > 1 or original is not null"), "warc-notes").withColumnsRenamed({"key": "_key", "sha1": "_digest", "uri": "_uri"})
    p = pages.join(notes, pages.key.eqNullSafe(notes._key) & (pages.sha1 == notes._digest) & pages.uri.eqNullSafe(notes._uri), "left").drop("_key", "_digest", "_uri")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("none"))
    own = lambda kind, k="key", u="uri": uuid_of(F.lit(kind), part(k), F.col("sha1"), part(u))
    url = F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]+", " ")
    common = [("WARC-Target-URI", F.when(url != "", url)), ("WARC-Date", F.lit(date))]
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    whole = F.col("original").isNull()
    response = _record(
        [
            ("WARC-Type", F.when(whole, F.lit("response")).otherwise(F.lit("revisit"))), ("WARC-Record-ID", own("response")), *common,
            ("WARC-Payload-Digest", digest),
            ("WARC-Refers-To", F.when(~whole, own("response", "original", "original_uri"))),
            ("WARC-Profile", F.when(~whole, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http_head(F.col("size")), F.when(whole, F.col("html")).otherwise(F.lit(""))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", own("request")), *common, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(url == "", F.lit("/")).otherwise(url), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", own("metadata")), *common, ("WARC-Concurrent-To", own("response")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws("", *[F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))) for name, c in (("key", F.col("key")), ("refersToKey", F.col("original")), ("copies", F.when(F.col("copies") > 1, F.col("copies"))))]),
    )
    records = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    # a task's rows are a mixture, so files of so many records are of about the size asked for
    mean = narrow.agg(F.avg("size")).first()[0] or 0.0
    per_file = max(3, int(3 * file_bytes / (mean + HEAD_BYTES)))
    records.write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", compression).text(out)


def parse(raw: bytes):
    """(headers, block) of each record; names of headers are in lower case."""
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = raw[at:end].decode("utf-8", "replace").split(CRLF)
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(heads["content-length"])
        yield heads, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _row(name: str, h: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    head, payload, fields = None, block, None
    if h.get("content-type", "").startswith("application/http"):
        a, _, payload = block.partition(b"\r\n\r\n")
        head = a.decode("utf-8", "replace")
    elif h.get("content-type", "") == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
    digest = h.get("warc-payload-digest")
    if digest and digest.lower().startswith("sha1:") and len(digest) == 37:  # base32, as other writers have it
        digest = "sha1:" + base64.b32decode(digest[5:].upper()).hex()
    return (
        name, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
        digest, h.get("content-type"), len(block), head, len(payload), hashlib.sha1(payload).hexdigest(), fields, payload if with_payload else None,
    )


def read(spark: SparkSession, at: str, *, with_payload: bool = True) -> DataFrame:
    """One row a record of all archives of a folder; plain or gzipped.

    ``payload_bytes`` and ``payload_sha1`` are of the payload that the record
    itself holds.
    """
    ship(spark)
    kinds = [pa.string()] * 9 + [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if raw[:2] == b"\x1f\x8b":
                    import gzip

                    raw = gzip.decompress(raw)
                rows, size = [], 0
                for heads, block in parse(raw):
                    rows.append(_row(name.rpartition("/")[2], heads, block, with_payload))
                    size += 400 + len(block) * with_payload
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("path", "content")
    return files.mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, response, request, metadata).

    A record belongs to the capture that its WARC-Concurrent-To names, a response
    or revisit to its own.  A capture without response has a null one; of several
    records of one kind the one with the smallest id is kept.
    """
    main = F.col("record_type").isin("response", "revisit", "resource")
    r = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture_id is not null")
    body = F.struct(*records.columns)
    pick = lambda cond: F.min_by(F.when(cond, body), F.when(cond, F.col("record_id")))
    return r.groupBy("capture_id").agg(
        pick(main).alias("response"), pick(F.col("record_type") == "request").alias("request"), pick(F.col("record_type") == "metadata").alias("metadata")
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Append (full_bytes, full_sha1, original_id) to captures.

    A revisit takes them from the response it refers to, by a join of narrow rows;
    null if that is not among the captures.
    """
    c = captures.select(
        "*", F.col("response.payload_bytes").alias("_bytes"), F.col("response.payload_sha1").alias("_sha1"),
        F.when(F.col("response.record_type") == "revisit", F.col("response.refers_to")).alias("original_id"),
    )
    held = captures.where("response.record_type <> 'revisit'").select(F.col("capture_id").alias("_id"), F.col("response.payload_bytes").alias("_fb"), F.col("response.payload_sha1").alias("_fs"))
    j = c.join(held, c.original_id == held._id, "left")
    own = F.col("original_id").isNull()
    return j.select(*captures.columns, "original_id", F.when(own, F.col("_bytes")).otherwise(F.col("_fb")).alias("full_bytes"), F.when(own, F.col("_sha1")).otherwise(F.col("_fs")).alias("full_sha1"))
