"""The registered ``opN_*`` queries: each applies one operator, with production
parameters, to its whole table and derives the digest columns from the
operator's real output."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exactdedup, html, minhash, mixing, pii, simhash, tokenfile, toxicity, turns, variants, warc
from ..storage import materialize, scratch
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path=public_tokenizers.path("byte_bpe_50k.json"), with_decoded=True, keep_text=False)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _printed(text: str, following: str) -> tuple:
    edited = minhash.edited(text, following)
    own, its, next_ = (minhash.text_fingerprint(t) for t in (text, edited, following))
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), its.hex(), minhash.likeness(own, its), minhash.likeness(own, next_)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_next(
        table(spark, sf_dir, "documents"), _printed,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out, key="page_id", uri="url", payload="html")
    captures = warc.transactions(warc.read(spark, out, with_payload=False))
    narrow = captures.select("capture_id", F.struct("response.record_type", "response.refers_to", "response.payload_bytes", "response.payload_sha1").alias("response"), "metadata.fields")
    full = warc.resolve(materialize(narrow, "captures"))
    full = full.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("fields")["copies"].cast("int"), F.lit(1)))))  # equal rows are one capture
    return full.select(
        F.col("fields")["key"].try_cast("long").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("full_sha1").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("fields")["refersToKey"].try_cast("long").alias("refers_to"),
    )


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), out, path=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(spark, out, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = ~F.coalesce(toxicity.may_teach(F.col("doc_id")), F.lit(True))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts are of the base spans; ``n_added`` counts the others."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["plain"])
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    n_added = F.size(F.filter("pii", lambda s: ~s["plain"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"), n_added)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.count_words(table(spark, sf_dir, "documents"), key="doc_id"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.deduplicate(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    summary, repaired = turns.repair(turns.damage(given))
    found = summary.join(turns.digests(repaired), "lo", "left").withColumnRenamed("conv_id", "c")
    every = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict:
    ops = (op1_bpe, op2_html, op3_minhash, op4_mixing, op5_ann, op6_warc, op7_tokenfile, op8_toxicity, op9_pii, op10_simhash, op11_variants, op12_exact_dedup, op13_repair)
    return {f.__name__: f for f in ops}


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
                  max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
     w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
     v AS (SELECT (SELECT level FROM l WHERE level * weight < cap ORDER BY cap / weight, place LIMIT 1) AS settled),
     t AS (SELECT source, source_size, CASE WHEN settled IS NULL THEN cap ELSE least(cap, settled * weight) END AS target FROM l, v),
     q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS sure FROM t),
     e AS (SELECT *, greatest(target - sure * source_size, 0) AS rest FROM q),
     -- if documents of more than a.size words are certain, the others share what is left
     z AS (SELECT source, size, count(*) AS n, sqrt(size::DOUBLE) AS x FROM d WHERE size > 0 GROUP BY ALL),
     k AS (SELECT a.source, a.size, a.x, any_value(e.rest) AS rest, coalesce(sum(b.n * b.size) FILTER (b.size > a.size), 0) AS certain, sum(b.n * b.size * b.x) FILTER (b.size <= a.size) AS moment
           FROM z a JOIN z b ON a.source IS NOT DISTINCT FROM b.source JOIN e ON e.source IS NOT DISTINCT FROM a.source GROUP BY ALL),
     m AS (SELECT source, arg_max((rest - certain) / moment, size) AS factor, arg_max(certain, size) AS certain FROM k WHERE (rest - certain) / moment * x < 1 GROUP BY source),
     u AS (SELECT *, (CAST(concat('0x', substr(md5(concat_ws('|', 7, doc_id, text)), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d),
     i AS (SELECT u.*, e.source_size, e.target, e.sure, e.rest - coalesce(m.certain, 0) AS rest, least(coalesce(factor, 0) * sqrt(size::DOUBLE), 1) AS p
           FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM e.source),
     r AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN sum(CASE WHEN p > 0 AND p < 1 THEN size END) OVER
                       (PARTITION BY source ORDER BY CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) END AS upto FROM i)
SELECT doc_id, size, source_size, target,
       CAST(size * (sure + CASE WHEN p >= 1 OR (rest > 0 AND (upto <= rest OR (upto - size < rest AND abs(upto - rest) <= abs(upto - size - rest)))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


#: For the layout of the test pages: headings and paragraphs of the one article.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages),
     b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x:
             regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g')) AS parts FROM a),
     c AS (SELECT page_id, url, list_transform(parts, lambda x:
             trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM b),
     t AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""
#: Base spans; the test tables hold no disguised identifiers, so ``spans`` has no others there.
#: A match's start is the length of the pieces between matches and of the matches before it.
_FOUND = "SELECT doc_id, {k} AS place, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d"
_BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     f AS ({" UNION ALL ".join(_FOUND.format(k=k, kind=kind, pattern=p) for k, (kind, p) in enumerate(_BASE_PATTERNS.items()))}),
     h AS (SELECT doc_id, place, kind, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
             'hit': hits[i], 'start': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0)}})) AS x FROM f),
     n AS (SELECT doc_id, place, kind, x.hit AS hit, CAST(x.start AS BIGINT) AS start, regexp_replace(x.hit, '[^0-9]', '', 'g') AS digits FROM h),
     b AS (SELECT * FROM n WHERE kind = 'email'
           OR (kind = 'ip' AND len(list_filter(string_split(hit, '.'), lambda o: length(ltrim(o, '0')) > 3 OR coalesce(TRY_CAST(right(o, 4) AS INT), 0) > 255)) = 0)
           OR (kind = 'phone' AND length(digits) BETWEEN 9 AND 15)
           OR (kind = 'card' AND length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
                 CASE WHEN i % 2 = 1 THEN CAST(reverse(digits)[i] AS INT) ELSE 2 * CAST(reverse(digits)[i] AS INT) - CASE WHEN reverse(digits)[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0)),
     a AS (SELECT doc_id, string_agg(concat(kind, ':', start, ':', start + length(hit)), ',' ORDER BY start, place) AS spans,
                  {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _BASE_PATTERNS)} FROM b GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _BASE_PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(0 AS BIGINT) AS n_added
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


#: CRC-32 a byte at a time by a table made from its rule; near words share what is left when one letter of either, or of the longer, is taken out.
OP11_SQL = r"""
WITH RECURSIVE
     bit AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
             UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
     crc AS (SELECT list(c ORDER BY i) AS entries FROM bit WHERE k = 8),
     r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
     o AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
     b AS (SELECT run, n, hex(encode(concat(doc_id, ':', run))) AS bytes FROM o),
     h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(bytes), 2), lambda i: CAST(concat('0x', bytes[i:i + 1]) AS BIGINT))),
                                                      lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1]))) AS h FROM b, crc),
     d AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
     w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     z AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
     x AS (SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest FROM z),
     p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
           UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word
           UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word),
     g AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -near_n, near := near)) AS top FROM p GROUP BY word),
     f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 10 * n THEN top.near END AS form, CASE WHEN -top.less >= 10 * n THEN -top.less END AS form_n
           FROM w LEFT JOIN g USING (word)),
     c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.at WHERE e.form IS NULL
"""


#: Lower-casing A to Z only, as a step of its own: texts equal after it are one group.
OP12_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_html": OP2_SQL, "op9_pii": OP9_SQL, "op4_mixing": OP4_SQL, "op6_warc": OP6_SQL, "op11_variants": OP11_SQL, "op12_exact_dedup": OP12_SQL}
