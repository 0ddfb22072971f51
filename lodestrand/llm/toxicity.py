"""Toxicity scores by weak supervision.

Voters: a fixed lexicon, pattern voters, stems (word beginnings) that set toxic
rows apart, mined from labelled rows, and the label itself, which most rows lack.
A generative label model says how a row's class makes the voters vote: each voter
depends on the class and on one other voter, the one it agrees with most within
the classes, so the voters form a tree and correlated ones add little to each
other.  Expectation maximisation over all rows that may teach, labelled or not,
estimates the accuracies and correlations of all voters in both classes, and the
accuracy of labels with them.  Its posterior is the label on which a linear
classifier over the votes is trained; a row's given label is evidence of it, no
more.

Only mining stems uses a bounded sample: ``mine_rows`` labelled rows at most.
Label model and classifier are fitted to all rows by sums over vote patterns that
Spark adds up; the driver holds square tables of voters.

Rows: a null or empty text has no votes and gets the score of the intercept.
Repeated rows get equal scores.  Other columns pass through.  Without labels the
fixed voters teach each other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import map_batches, slices

#: A small lexicon of insults.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "fool", "jerk", "imbecile", "bastard", "pig", "filth", "garbage", "freak", "creep", "hate", "ugly", "shut up", "crap", "damn")
#: Pattern voters.
PATTERNS = {
    "address": r"\b(?:you|you're|u)\s+(?:are\s+)?(?:an?\s+|such\s+an?\s+)?(?:idiot|moron|loser|clown|scum|fool)",
    "threat": r"\b(?:kill|hurt|destroy)\s+(?:you|him|her|them)\b",
    "shouting": r"\b[A-Z]{4,}(?:\s+[A-Z]{4,}){2,}\b",
    "bangs": r"!{3,}",
    "masked": r"\b[a-z]+[*@#$]{2,}[a-z]*\b",
}
STEM_SIZES = range(3, 9)
#: Numbers of different words that lexicon and stems find, over the text's words.
DENSITIES = (0.0, 0.002, 0.004, 0.007, 0.012, 0.02, 0.04)
WORDS = re.compile(r"[^\W\d_]+")
_PATTERNS = {k: re.compile(p) for k, p in PATTERNS.items()}
#: A row without label counts as so many with one.
UNLABELLED = 0.1


@dataclass
class Model:
    """All that scoring needs; a few hundred kB."""

    lexicon: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    intercept: float = 0.0
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)  # P(votes | toxic), P(silent | harmless)
    leans_on: dict[str, str] = field(default_factory=dict)  # the voter that one depends on

    @property
    def voters(self) -> list[str]:
        return [f"word:{w}" for w in self.lexicon] + [f"stem:{s}" for s in self.stems] + [f"pattern:{p}" for p in PATTERNS] + [f"dense:{x:g}" for x in DENSITIES]


class Featurizer:
    """Votes of a text: one number a voter, 1 where it says toxic.

    A stem votes if a word begins with it; a stem written with a 2 in front, if
    two different words do.  One automaton finds all voters in a pass.
    """

    def __init__(self, lexicon: list[str], stems: list[str]):
        self.n_lex, self.n_stem = len(lexicon), len(stems)
        self.known = self.n_lex + self.n_stem
        self.width = self.known + len(_PATTERNS) + len(DENSITIES)
        bare = list(dict.fromkeys(s.lstrip("2") for s in stems))
        at = {s: i for i, s in enumerate(bare)}
        self.stem_at = [(self.n_lex + i, at[s.lstrip("2")], 1 + s.startswith("2")) for i, s in enumerate(stems)]
        self.n_bare = len(bare)
        keys: dict[str, list[int]] = {}
        for s, i in at.items():
            keys.setdefault(s, []).append(i)
        for i, w in enumerate(lexicon):
            keys.setdefault(w, []).append(-1 - i)
        self.auto = ahocorasick.Automaton()
        for s, ks in keys.items():
            self.auto.add_word(s, (len(s), ks))
        self.auto.make_automaton()

    def __call__(self, text: str) -> np.ndarray:
        out = np.zeros(self.width, np.uint8)
        low = text.lower()
        stems: dict[int, set[str]] = {}
        words, end = set(), len(low)
        for last, (n, keys) in self.auto.iter(low):
            a, b = last + 1 - n, last + 1
            if a and low[a - 1].isalpha():
                continue
            while b < end and low[b].isalpha():
                b += 1
            word = low[a:b]
            for k in keys:
                if k >= 0:
                    stems.setdefault(k, set()).add(word)
                    words.add(word)
                elif b == last + 1:
                    out[-1 - k] = 1
                    words.add(word)
        if stems:
            for i, k, least in self.stem_at:
                out[i] = len(stems.get(k, ())) >= least
        for i, p in enumerate(_PATTERNS.values()):
            out[self.known + i] = p.search(text) is not None
        if words:
            n = 1 + low.count(" ") + low.count("\n")
            for i, least in enumerate(DENSITIES, self.known + len(_PATTERNS)):
                out[i] = len(words) > least * n
        return out


def may_teach(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds != 0


def mine(labelled: DataFrame, text: str, toxic: str, *, at_most: int = 60, rounds: int = 4) -> tuple[list[str], list[str], int, int]:
    """Lexicon words and stems that labels support, and the numbers of toxic and other rows.

    Each round looks only at rows that no voter so far finds, so stems of a small
    group of toxic rows are not lost among the others.  A stem is taken if the
    odds against so many of its rows being toxic by chance exceed the number of
    stems tried.  Counting is distributed: tasks count the rows that hold a stem,
    Spark adds the counts up, and only the best few come to the driver.
    """
    lexicon, chosen, first = list(LEXICON), [], (0, 0)

    def counter(lexicon: list[str], stems: list[str]):
        def count(batches):
            f = Featurizer(lexicon, stems)
            for b in (part for batch in batches for part in slices(batch)):
                pos, neg, n = Counter(), Counter(), [0, 0]
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if f(t or "")[: f.known].any():
                        continue
                    words = set(WORDS.findall((t or "").lower()))
                    once = Counter(w[:k] for w in words for k in STEM_SIZES if len(w) >= k)
                    found = [*once, *("2" + s for s, c in once.items() if c > 1), *("=" + w for w in words if len(w) <= 12)]
                    (pos if y else neg).update(found)
                    n[bool(y)] += 1
                keys = list(pos.keys() | neg.keys())
                yield pa.RecordBatch.from_pydict({"stem": ["", *keys], "pos": [n[1], *(pos[k] for k in keys)], "neg": [n[0], *(neg[k] for k in keys)]})

        return count

    rows = labelled.select(F.col(text), F.col(toxic).cast("int"))
    for r in range(rounds):
        counted = rows.mapInArrow(counter(lexicon, chosen), "stem string, pos long, neg long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        counted = materialize(counted.where("pos + neg >= 3 or stem = ''"), "toxicity-stems")
        left = counted.where("stem = ''").first()
        if r == 0:
            classes = rows.agg(F.sum(F.col(toxic)).alias("y"), F.count("*").alias("n")).first()
            first = (int(classes.y or 0), int(classes.n - (classes.y or 0)))
        if not left or not left.pos or not left.neg:
            break
        p, tried = left.pos / (left.pos + left.neg), max(2, counted.count())
        n = F.col("pos") + F.col("neg")
        part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / n / q)).otherwise(0.0)
        odds = counted.where(f"stem <> '' and pos >= 3 and pos > 4 * neg and pos > {2 * p} * (pos + neg)").withColumn("gain", part("pos", p) + part("neg", 1 - p))
        best = odds.where(F.col("gain") > math.log(tried) + 1).orderBy(F.desc("gain"), F.length("stem").desc(), "stem").limit(20 * at_most).collect()
        taken: list[tuple[str, int]] = []
        for row in best:
            s = row.stem
            bare = s.lstrip("=2")
            # a stem within a chosen one, or around it, of about the same rows says nothing new
            if any((bare.startswith(c) or c.startswith(bare)) and row.pos <= 1.3 * k for c, k in taken):
                continue
            taken.append((bare, row.pos))
            if s[0] == "=":
                lexicon.append(bare)
            else:
                chosen.append(s)
            if len(chosen) >= at_most:
                break
        if not taken or len(chosen) >= at_most:
            break
    return list(dict.fromkeys(lexicon)), list(dict.fromkeys(chosen)), *first


def patterns(docs: DataFrame, known: DataFrame, lexicon: list[str], stems: list[str]) -> DataFrame:
    """(votes, label, n): rows (doc_id, text) by packed votes and the label of ``known`` (l_id, toxic), which may be null.

    Texts stay where they are; votes are joined with labels.
    """

    def vote(batches):
        f = Featurizer(lexicon, stems)
        for b in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(f(t or "")).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["id", "votes"])

    voted = docs.select("doc_id", "text").mapInArrow(vote, "id long, votes binary")
    return voted.join(known, voted.id == known.l_id, "left").groupBy("votes", F.col("toxic").alias("label")).agg(F.count("*").alias("n"))


def unpacked(votes: list[bytes], width: int) -> np.ndarray:
    if not votes:
        return np.zeros((0, width))
    return np.unpackbits(np.frombuffer(b"".join(votes), np.uint8).reshape(len(votes), -1), axis=1)[:, :width].astype(float)


@dataclass
class LabelModel:
    toxic: np.ndarray  # P(votes | toxic) of each voter
    other: np.ndarray  # P(votes | harmless)
    parent: np.ndarray  # the voter that each depends on; -1: none
    given: np.ndarray  # P(votes | class, parent silent or voting): classes x 2 x voters
    told: np.ndarray  # P(label is toxic | class) of labelled rows
    balance: float  # P(toxic)

    def posterior(self, votes: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes, label); nan: no label."""
        leads = np.where(self.parent >= 0, votes[:, self.parent], 0) > 0
        no, yes = (np.where(leads, self.given[c, 1], self.given[c, 0]) for c in (0, 1))
        z = np.where(votes > 0, np.log(yes / no), np.log((1 - yes) / (1 - no))).sum(1) + math.log(self.balance / (1 - self.balance))
        if label is not None:
            said = np.where(label > 0, math.log(self.told[1] / self.told[0]), math.log((1 - self.told[1]) / (1 - self.told[0])))
            z = z + np.where(np.isnan(label), 0, said)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def first_guess(width: int) -> LabelModel:
    """Before anything is known: a toxic row has a few votes, another one hardly any, and labels are nearly always right."""
    toxic = np.full(width, min(0.3, 6 / max(1, width)))
    other = toxic / 30
    return LabelModel(toxic, other, np.full(width, -1), np.stack([np.stack([r, r]) for r in (other, toxic)]), np.array([0.01, 0.97]), 0.05)


def summed(pats: DataFrame, table, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``table(votes, label, n)`` over all vote patterns; tasks' tables are added up by Spark."""

    def add(batches):
        total = np.zeros(shape)
        for b in batches:
            label = np.array([np.nan if x is None else float(x > 0) for x in b.column(1).to_pylist()])
            total += table(b.column(0).to_pylist(), label, b.column(2).to_numpy().astype(float))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": at, "s": total.ravel()[at]})

    out = np.zeros(shape)
    got = pats.select("votes", "label", "n").mapInArrow(add, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    out.ravel()[got.column("at").to_numpy()] = got.column("s").to_numpy()
    return out


def class_moments(pats: DataFrame, width: int, model: LabelModel, weight: float) -> np.ndarray:
    """Sums of v v' by class, v being 1, the votes, label is toxic, label is harmless.

    Rows count for both classes by the posterior, those without label ``weight`` times.
    """

    def table(votes, label, n):
        x = unpacked(votes, width)
        y = model.posterior(x, label)
        n = np.where(np.isnan(label), weight * n, n)
        v = np.hstack([np.ones((len(x), 1)), x, (label == 1)[:, None], (label == 0)[:, None]])
        return np.stack([(v * share[:, None]).T @ v for share in (n * (1 - y), n * y)])

    return summed(pats, table, (2, width + 3, width + 3))


def leading(both: np.ndarray, ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each voter the one it depends on: the tree of the most information about each other within the classes.

    ``both`` and ``ones`` count votes of two and of one voter by class, ``n``
    rows.  Links that chance could explain are left out.
    """
    width = ones.shape[1]
    info = np.zeros((width, width))
    for c in (0, 1):
        if n[c] <= 0:
            continue
        p, q = both[c] / n[c], ones[c] / n[c]
        for cell, a, b in ((p, q[:, None], q), (q[:, None] - p, q[:, None], 1 - q), (q - p, 1 - q[:, None], q), (1 - q[:, None] - q + p, 1 - q[:, None], 1 - q)):
            ok = cell > 1e-12
            info += n[c] * np.where(ok, cell * np.log(np.where(ok, cell, 1) / np.maximum(a * b, 1e-300)), 0)
    parent, joined = np.full(width, -1), np.zeros(width, bool)
    gain, via = np.full(width, -1.0), np.full(width, -1)
    for _ in range(width):  # the next voter is the one that the tree so far says most about
        k = int(np.where(joined, -2.0, gain).argmax())
        parent[k] = via[k] if gain[k] > 10 else -1
        joined[k] = True
        nearer = info[k] > gain
        gain, via = np.where(nearer, info[k], gain), np.where(nearer, k, via)
    return parent


def label_model(pats: DataFrame, width: int, *, rounds: int = 5, weight: float = UNLABELLED) -> LabelModel:
    """The model that expectation maximisation finds, from the votes' agreement and the labels.

    A voter's probabilities given its parent are drawn to its own where few rows
    tell them.
    """
    model = guess = first_guess(width)
    for _ in range(rounds):
        m = class_moments(pats, width, model, weight)
        n, ones, both = m[:, 0, 0], m[:, 0, 1 : width + 1], m[:, 1 : width + 1, 1 : width + 1]
        if n.sum() <= 0:
            break
        rate = np.clip((ones + np.stack([guess.other, guess.toxic])) / (n[:, None] + 1), np.array([[1e-6], [1e-4]]), 1 - 1e-4)
        parent = leading(both, ones, n)
        at = np.arange(width)
        with_, leads = both[:, at, parent], ones[:, parent]
        given = np.stack([(ones - with_ + 4 * rate) / (n[:, None] - leads + 4), (with_ + 4 * rate) / (leads + 4)], axis=1)
        given = np.clip(np.where(parent < 0, rate[:, None], given), 1e-6, 1 - 1e-4)
        yes, no = m[:, 0, width + 1], m[:, 0, width + 2]
        told = np.clip((yes + 20 * np.array([0.01, 0.97])) / (yes + no + 20), 1e-3, 1 - 1e-3)
        new = LabelModel(rate[1], rate[0], parent, given, told, float(min(0.5, max(0.002, n[1] / n.sum()))))
        settled = np.abs(new.toxic - model.toxic).max() < 1e-4
        model = new
        if settled:
            break
    return model


def classifier(pats: DataFrame, width: int, model: LabelModel, *, rounds: int = 15, weight: float = UNLABELLED, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on the posterior labels of all rows, by Newton steps.

    Gradient and curvature are sums over the vote patterns, one Spark job a step.
    """
    w = np.r_[np.zeros(width), math.log(model.balance / (1 - model.balance))]
    pen = np.r_[np.full(width, penalty), 1e-9]

    def table(votes, label, n):
        x = unpacked(votes, width)
        y = model.posterior(x, label)
        n = np.where(np.isnan(label), weight * n, n)
        x = np.hstack([x, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (n * p * (1 - p))[:, None]).T @ x
        return np.vstack([curve, x.T @ (n * (y - p)), np.r_[np.zeros(width), n.sum()]])

    for _ in range(rounds):
        t = summed(pats, table, (width + 3, width + 1))
        total = t[-1, -1]
        if total <= 0:
            return np.zeros(width), -2.0
        step = np.linalg.solve(t[:-2] / total + np.diag(pen + 1e-9), t[-2] / total - pen * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", *, folds: int = 5, mine_rows: int = 40_000) -> Model:
    """A model from the rows that may teach.

    Stems are mined from about ``mine_rows`` labelled rows at most, chosen by a
    hash; the label model and the classifier cover all teaching rows and all
    their labels.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & may_teach(F.col("doc_id"), folds))
    known = labels.select(F.col(doc_id).cast("long").alias("l_id"), F.col(toxic).cast("int").alias("toxic")).where("l_id is not null and toxic is not null")
    known = known.groupBy("l_id").agg(F.max("toxic").alias("toxic")).where(may_teach(F.col("l_id"), folds))
    total = known.count()
    slot = F.shiftrightunsigned(F.xxhash64(F.lit(11), "l_id"), 33) / F.lit(float(1 << 31))
    some = known.where(slot < min(1.0, mine_rows / max(total, 1)))
    lexicon, stems, *_ = mine(materialize(d.join(F.broadcast(some), d.doc_id == some.l_id).select("text", "toxic"), "toxicity-known"), "text", "toxic")  # mine_rows ids at most
    model = Model(lexicon, stems)
    width = len(model.voters)
    pats = materialize(patterns(d, known, lexicon, stems), "toxicity-votes")
    truth = label_model(pats, width)
    model.accuracy = {v: (float(a), float(1 - b)) for v, a, b in zip(model.voters, truth.toxic, truth.other)}
    model.leans_on = {v: model.voters[p] for v, p in zip(model.voters, truth.parent) if p >= 0}
    model.weights, model.intercept = classifier(pats, width, truth)
    return model


def score(df: DataFrame, model: Model, text: str = "text", *, out: str = "score") -> DataFrame:
    """Append the classifier's probability that each whole text is toxic."""
    lexicon, stems, w, b = model.lexicon, model.stems, model.weights, model.intercept

    def make():
        f = Featurizer(lexicon, stems)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            v = np.array([f(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], float)
            return {out: pa.array(1 / (1 + np.exp(-np.clip(v @ w + b, -30, 30))))}

        return run

    return map_batches(df, make, f"`{out}` double")
