import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestrand.llm import mixing, pii
from tests.llm.test_simhash import brute_classes, brute_print


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, frames = docs.columns, [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        frames.append(docs.collect())
        if name != "bpe":
            assert docs.columns == cols
    start, clean, single, masked, mixed, coded = frames
    # toxicity: rows go, none changes; rows labelled harmless stay
    by_id = {r.doc_id: r for r in start}
    assert 0 < len(clean) < len(start) and all(by_id[r.doc_id] == r for r in clean)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    left = {r.doc_id for r in clean}
    harmless = [i for i, t in labels.items() if t == 0]
    assert sum(i in left for i in harmless) >= 0.98 * len(harmless)
    # simhash: the smallest id of each class
    classes = brute_classes({r.doc_id: brute_print(r.text) for r in clean})
    assert sorted(r.doc_id for r in single) == sorted(set(classes.values())) and all(by_id[r.doc_id] == r for r in single)
    # pii: the same rows, masked
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: pii.mask(r.text, pii.spans(r.text)) for r in single}
    assert all(r.n_chars == len(r.text) for r in masked)
    # mixing: as often as the mix takes them
    take = mixing.mix(spark.createDataFrame(masked)).collect()
    want = {r.doc_id: r.copies if r["size"] else 1 for r in take}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in want.items() if n})
    # bpe: the library's ids, and the text again
    lib, text = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {r.doc_id: r.text for r in masked}
    assert Counter(r.doc_id for r in coded) == Counter(r.doc_id for r in mixed)
    for r in coded:
        ids = lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages(spark, sf_dir):
    from __spark_entry__ import queries

    assert queries()["pipeline"] is corpus_pipeline.run
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(corpus_pipeline.run(spark, sf_dir).columns)


def _all_stages(spark, docs, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        cols, docs = docs.columns, stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        assert name == "bpe" or docs.columns == cols
    return counts, docs


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nulls_repeats_and_columns_with_the_names_of_helpers(spark, tmp_path):
    """Such rows go through every stage; only near copies and what the mix leaves out are missing."""
    names = ["_toxicity", "_mix_hash", "_mix_hashg", "_mix_id", "_mix_given", "_mix_rows", "_mix_copies", "fp", "_text", "pii", "ids", "decoded", "Score"]
    texts = [None, "", " ", "\x00", "Mail me at jo.doe@example.org today, or call.", "A plain note on the weather in the hills. " * 200, "word " * 30_000, "été À noël"]
    rows = []
    for k in range(40):
        r = (None if k % 9 == 0 else k % 30, texts[k % 8], None if k % 4 else "en", None if k % 5 == 0 else "s" + str(k % 3), None)
        rows += [(*r, *[-7] * len(names))] * (1 + (k % 10 == 3))
    docs = spark.createDataFrame(rows, COLUMNS + "".join(f", {n} int" for n in names))
    counts, last = _all_stages(spark, docs, tmp_path, [(k, 1, int(k % 7 == 0)) for k in range(30)] + [(None, None, None)])
    assert counts[1] > 0 and counts[2] > 0 and counts[3] == counts[2] and counts[5] == counts[4]
    assert {"doc_id", "n_tokens", "ids"} <= set(last.columns) and last.where("n_tokens is null").count() == 0


def test_an_empty_table(spark, tmp_path):
    counts, _ = _all_stages(spark, spark.createDataFrame([], COLUMNS), tmp_path, [])
    assert counts == [0] * 6
