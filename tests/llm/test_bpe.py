import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestrand.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return bpe.coder(PATH)


def texts():
    rng = random.Random(1)
    vocab = bpe.coder(PATH)[0].vocab
    letters = "abcdefghijklmnopqrstuvwxyzABC éüñ0123456789.,!?-_'\n\t　 \x1c   你好世界🙂࢏́<|endoftext|>"
    for k in range(3000):
        kind = k % 5
        if kind == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))
        elif kind == 1:
            yield "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 60)))
        elif kind == 2:
            yield bytes("".join(rng.choice(vocab.text) for _ in range(rng.randrange(1, 8))), "latin-1").decode("utf8", "replace")
        elif kind == 3:
            yield "".join(rng.choice(["a", "b", "A", " ", "=", "-", "0", "\n"]) * rng.randrange(1, 40) for _ in range(4))
        else:
            yield rng.choice(["x", " ", ""]) + "<|endoftext|>" + rng.choice(["y", " z", "<|endoftext|>", ""])


def test_ids_and_text_equal_the_library(coder, library):
    enc, dec = coder
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert bpe.unpack(enc(t)) == want, t
        assert dec(np.array(want)) == library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(coder):
    vocab = coder[0].vocab
    whole, vocab.number = vocab.number, {}
    try:
        for n in range(0, len(vocab.text), 7):
            assert vocab.encode(vocab.text[n]) == [n]
    finally:
        vocab.number = whole


def test_very_long_words_take_linear_time(coder, library):
    t = "a" * 100_000 + "é" * 20_000 + "=" * 30_000
    assert bpe.unpack(coder[0](t)) == library.encode(t, add_special_tokens=False).ids


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "hello", "z"), (3, "hello", "z")], "doc_id long, text string, IDS string")
    got = bpe.encode(df, path=PATH, with_decoded=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0, 0, 1, 1] and [r.decoded for r in got] == ["", "", "hello", "hello"]
    assert bpe.encode(df.limit(0), path=PATH).count() == 0
    back = bpe.decode(bpe.encode(df, path=PATH), path=PATH, out="again").select("again").collect()
    assert sorted(r.again for r in back) == ["", "", "hello", "hello"]


def test_query_against_the_library(spark, sf_dir, library, oracle):
    got = {r.doc_id: r for r in queries.op1_bpe(spark, sf_dir).collect()}
    rows = oracle.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
