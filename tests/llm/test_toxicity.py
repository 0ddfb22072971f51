import random
import zlib

import numpy as np

from lodestrand.llm import queries, toxicity


def corpus(seed, n, toxic_share=0.15):
    """Invented prose; toxic texts hold words of two stems or of the lexicon."""
    rng = random.Random(seed)
    syll = "ba be bi bo da de di do la le li lo ma me mi mo na ne ni no".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(2, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 120))]
        bad = rng.random() < toxic_share
        if bad:
            kind = rng.randrange(3)
            for _ in range(max(2, len(words) // 12)):
                words.insert(rng.randrange(len(words)), ("zorka" + word(), "quipse" + word(), rng.choice(["idiot", "scum", "moron"]))[kind])
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_learns_stems_and_leaves_clean_texts(spark):
    docs, labels = corpus(1, 1500)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any("zorka".startswith(s.lstrip("2")) or s.lstrip("2").startswith("zorka") for s in m.stems)
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == bool(labels[i][1]) for i in held])
    clean_hit = np.mean([got[i] >= 0.5 for i in held if not labels[i][1]])
    assert right > 0.95 and clean_hit < 0.01


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(2, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.stems == b.stems and np.allclose(a.weights, b.weights) and a.intercept == b.intercept


def packed(votes, label):
    return [(bytearray(np.packbits(v.astype(np.uint8)).tobytes()), t, 1) for v, t in zip(votes, label)]


def test_label_model_finds_accuracies_and_correlations(spark):
    rng = np.random.default_rng(0)
    y = rng.random(8000) < 0.2
    rates = [(0.7, 0.01), (0.4, 0.05), (0.4, 0.05)]
    votes = np.stack([np.where(y, rng.random(8000) < a, rng.random(8000) < b) for a, b in rates], axis=1)
    votes = np.hstack([votes, votes[:, 2:3]])  # the last repeats the one before
    rows = packed(votes, [int(t) if k % 4 == 0 else None for k, t in enumerate(y)])
    m = toxicity.label_model(spark.createDataFrame(rows, "votes binary, label int, n long"), 4)
    assert np.allclose(m.toxic[:3], [0.7, 0.4, 0.4], atol=0.06) and np.allclose(m.other[:3], [0.01, 0.05, 0.05], atol=0.02)
    assert abs(m.balance - 0.2) < 0.03 and m.told[1] > 0.9 and m.told[0] < 0.05
    assert sorted(m.parent.tolist()) in ([-1, -1, -1, 2], [-1, -1, -1, 3]) and (m.parent[3] == 2 or m.parent[2] == 3)
    # a voter that only repeats another adds next to nothing, an independent one does
    p = m.posterior(np.array([[0, 0, 1, 1], [0, 1, 1, 1]], float))
    odds = 0.2 / 0.8 * (0.3 / 0.99) * (0.6 / 0.95) * (0.4 / 0.05)
    assert abs(p[0] - odds / (1 + odds)) < 0.08 and p[1] > p[0] + 0.2


def test_a_label_is_evidence_and_may_be_overruled(spark):
    """A few labels are wrong; what nine good voters say of such rows is believed."""
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.05) for _ in range(9)], axis=1)
    wrong = rng.random(4000) < 0.05
    rows = packed(votes, (y ^ wrong).astype(int).tolist())
    pats = spark.createDataFrame(rows, "votes binary, label int, n long")
    m = toxicity.label_model(pats, 9)
    assert 0.85 < m.told[1] < 0.99 and 0.01 < m.told[0] < 0.15
    p = m.posterior(votes.astype(float), (y ^ wrong).astype(float))
    assert np.mean((p > 0.5) == y) > 0.99
    w, b = toxicity.classifier(pats, 9, m)
    assert (w > 0.5).all() and np.mean((votes @ w + b > 0) == y) > 0.98


def test_voters_teach_each_other_without_labels(spark):
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    votes = np.stack([np.where(y, rng.random(6000) < a, rng.random(6000) < 0.03) for a in (0.8, 0.7, 0.6, 0.7)], axis=1)
    m = toxicity.label_model(spark.createDataFrame(packed(votes, [None] * 6000), "votes binary, label int, n long"), 4, rounds=30)
    assert np.allclose(m.toxic, [0.8, 0.7, 0.6, 0.7], atol=0.08) and (m.other < 0.08).all()


def test_query_finds_held_out_toxic_documents(spark, sf_dir):
    rows = queries.op8_toxicity(spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    _precision_and_recall(spark, "/root/testdata/sf0.1")


def _precision_and_recall(spark, sf_dir):
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [(r.predicted, label[r.doc_id]) for r in queries.op8_toxicity(spark, sf_dir).where("held_out").collect() if label.get(r.doc_id) is not None]
    hit = sum(p and t for p, t in got)
    assert sum(t for _, t in got) >= 20
    assert hit >= 0.9 * sum(t for _, t in got) and hit >= 0.9 * sum(p for p, _ in got)


def test_rows(spark):
    d = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "IDIOT!!! you are scum " * 5000, 9.0), (None, "x", 9.0), (3, "x", 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.fit(d, none)
    got = toxicity.score(d, m).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    s = {(r.doc_id, (r.text or "")[:1]): r.score for r in got}
    assert s[1, ""] == s[2, ""] < s[3, "I"]
    toxicity.fit(d.limit(0), none)
    toxicity.fit(d, spark.createDataFrame([(3, 1), (3, None), (None, 1)], "doc_id long, toxic int"))
