import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrand.llm import queries, tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(kind, width):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 1 << (8 * width - 3), n).astype(f"<u{width}")
        planes = tokenfile.to_planes(ids, kind)
        assert len(planes) == (8 * width if kind == "bit" else width)
        assert (tokenfile.from_planes(planes, n, width, kind) == ids).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(None if k == 0 else k, rng.integers(0, 49_000, n)) for k, n in enumerate([0, 5, 4096, 1, 0, 20_000, 64, 64])]
    w = tokenfile.FileWriter(2, kind, block=64)
    pieces = [p for i, ids in docs for p in w.add(i, ids)] + list(w.close())
    raw = b"".join(p + b"\n" for p in pieces)
    got = [(i, np.concatenate([np.zeros(0, int), *parts])) for i, parts in tokenfile.FileReader(raw).documents()]
    assert [i for i, _ in got] == [i for i, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(got, docs))
    assert len(w.blocks) == -(-sum(len(d) for _, d in docs) // 64)


def test_ids_equal_the_library(library):
    rng = random.Random(4)
    letters = "abcXYZ éÉüΣσİıß0123.,!?-_'\n\t\r　 \x1c  你好🙂̈<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 80))) for _ in range(2000)] + ["ΟΔΟΣ ΣΑΣ", "a<|endoftext|>b <|startoftext|>", "x" * 30_000, " " * 5000]
    enc = tokenfile.WordIds(PATH)
    enc.MEMO = 3000
    for k in range(0, len(texts), 300):
        for t, ids in zip(texts[k : k + 300], enc(texts[k : k + 300])):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert len(enc.memo) <= 3000


def test_ids_equal_the_library_beside_control_characters(library):
    rng = random.Random(9)
    odd = [chr(c) for c in (*range(0x20), 0x7F, 0x85, 0xA0, 0xAA, 0xB2, 0xD7, 0x130, 0x2028)]
    usual = list("aB1'.,.,-  \n") + ["'s", "n't", " . ", ", ", ". "]
    texts = ["".join(rng.choice(odd if rng.random() < 0.35 else usual) for _ in range(rng.randrange(1, 24))) for _ in range(20_000)]
    enc = tokenfile.WordIds(PATH)
    assert enc.by_word
    for k in range(0, len(texts), 2_000):
        want = library.encode_batch(texts[k : k + 2_000], add_special_tokens=False)
        for t, ids, e in zip(texts[k : k + 2_000], enc(texts[k : k + 2_000]), want):
            assert ids.tolist() == e.ids, repr(t)
    assert enc(["a\x1c. b"])[0].tolist() == [320, 216, 269, 321]


def test_another_tokenizer_gets_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, enc = Tokenizer.from_file(path), tokenfile.WordIds(path)
    texts = ["Some words, here. And THERE", "", " x\n\ty "]
    assert not enc.by_word and [i.tolist() for i in enc(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_against_the_library(spark, sf_dir, library, oracle):
    got = {r.doc_id: r for r in queries.op7_tokenfile(spark, sf_dir).collect()}
    start = 0
    for i, t in oracle.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        r = got.pop(i)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, None, 1), (None, "b", 1), (1, "", 1), (3, "word " * 100_000, 1), (3, "a", 1), (3, "a", 1)], "doc_id long, text string, n_tokens int")
    for k, per in enumerate((6_000, 2)):
        tokenfile.write(df, f"{tmp_path}/{k}", path=PATH, end_id=1, file_docs=per)
        got = tokenfile.read(spark, f"{tmp_path}/{k}").orderBy("start").collect()
        assert [r.doc_id for r in got] == [None, 1, 2, 3, 3, 3]
        assert [r.n_tokens for r in got][:3] == [2, 1, 1] and sorted(r.n_tokens for r in got)[-1] == 100_001
        assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
        for r in got:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens
    many = spark.createDataFrame([(None if i % 3 else i, f"t{i}") for i in range(400)], "doc_id long, text string")
    tokenfile.write(many, f"{tmp_path}/many", path=PATH, end_id=1, file_docs=20)
    got = tokenfile.read(spark, f"{tmp_path}/many").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 266 + list(range(0, 400, 3))
    assert max(Counter(r.file for r in got if r.doc_id is None).values()) < 100
    tokenfile.write(df.limit(0), f"{tmp_path}/none", path=PATH, end_id=1)
    assert tokenfile.read(spark, f"{tmp_path}/none").count() == 0


def test_files_are_read_in_the_order_of_their_part_numbers(spark, tmp_path):
    for doc, part in enumerate(("00002", "10001", "99999", "100000", "100001")):
        w = tokenfile.FileWriter()
        pieces = [*w.add(doc, np.arange(10 + doc)), *w.close()]
        (tmp_path / f"part-{part}-x-c000.txt").write_bytes(b"".join(p + b"\n" for p in pieces))
    got = {r.doc_id: r.start for r in tokenfile.read(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 10, 2: 21, 3: 33, 4: 46}
