import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrand.llm import variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    forms, out = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        top = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = top if top is not None and words[top] >= 10 * n else None
        out[w] = (n, len(near))
    def root(w):
        return w if forms[w] is None else root(forms[w])
    return {(w, forms[w], root(w), n, near, words[forms[w]] if forms[w] else None) for w, (n, near) in out.items()}


def as_set(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def neighbours():
    """Words that share halves with very many others, repeated letters, chains of forms, ties and one very long word."""
    words = {"xxxxxxx": 3000, "xxxxxxxx": 40, "xxxxxxxxx": 3, "aaaaaab": 2, "aaaaabb": 20, "aaaabbb": 200, "aaabbbb": 2000, "éàaaabb": 5, "ÉÀaaabb": 7, "z" * 3000: 2, "z" * 2999: 50}
    for k in range(400):
        words[f"prefix{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwx'[k // 100]}"] = 2 + k % 50
        words[f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwx'[k // 100]}suffix"] = 2 + k % 3
    for c in "abcdefghijklmnopqrstuvwxyz":
        words[f"middl{c}middle"] = 2 + ord(c) % 5 * 20
        words[f"middl{c}{c}middle"] = 4
    return words


@pytest.mark.parametrize("limit", [2, 5, variants.LIMIT])
def test_near_words_equal_brute_force(spark, limit):
    words = neighbours()
    assert as_set(variants.group(spark.createDataFrame(list(words.items()), "word string, n long"), limit=limit)) == brute(words)


def test_each_pair_once_and_blocks_bounded(spark):
    words = spark.createDataFrame(list(neighbours().items()), "word string, n long")
    pairs = variants.near_pairs(words, 3).select(F.least("a", "b"), F.greatest("a", "b"))
    assert pairs.count() == pairs.distinct().count() > 1000
    sizes = variants.blocks(words, 3).groupBy(*variants.KEY).count().where("count > 3 and y > x")
    assert sizes.count() == 0


def test_texts(spark):
    common = "Straße Überraschung überraschung ÜBERRASCHUNG alphabet Alphabet alphabed×alphabet alphabets naïveté1naïveté ｆｕｌｌｗｉｄｔｈ"
    rows = [(k % 40 if k % 7 else None, t) for k, t in enumerate([common, None, "", "short words only", "a" * 5000, common.lower(), "alphabet " * 30] * 40)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    counted = variants.count_words(df, key="doc_id")
    want = brute_words(rows)
    assert {r.word: r.n for r in counted.collect()} == want and any(len(w) == 7 for w in want)
    assert as_set(variants.group(counted)) == brute(want)


def test_empty_table(spark):
    assert as_set(variants.group(variants.count_words(spark.createDataFrame([], "doc_id long, text string"), key="doc_id"))) == set()
