"""Byte-pair encoding and decoding.

The encoder never runs merge rounds.  One pass of a reversed Aho-Corasick
automaton gives, for every position, the longest vocabulary token that starts
there.  Backtracking over these, with a test whether two neighbouring tokens
could come out of the merges side by side, finds the one segmentation that the
merges give, in time linear in the text.  The decoder gathers bytes through an
offset table.

Rows: a null or empty text has no ids and decodes to an empty string.  Repeated
rows give repeated results.  Other columns pass through; those named like an
output column are replaced.
"""

from __future__ import annotations

import functools
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_batches

#: Fixed values of the byte-level pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class is the same in all Unicode versions that the libraries
#: were built with.  Texts that hold others are split by the tokenizer file's own
#: pre-tokenizer.
SETTLED = r"[\x00-՗֐-ࠀऀ-ఀ฀-῿ -⁯₠-ꟍ가-힣豈-￿\U0001f000-\U0001faff\U00020000-\U0002a6df]*+"
#: Words whose ids a task remembers.
MEMO_WORDS = 200_000
MEMO_CHARS = 64
#: Pairs of tokens whose test is remembered.
MEMO_PAIRS = 300_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: character to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE tokenizer file as tables.

    Tokens are numbered by merge order: 0-255 are the bytes, then the merges.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec.get("normalizer") or model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE file without normalizer is expected")
        alphabet = byte_alphabet()
        raw = lambda s: "".join(chr(alphabet[c]) for c in s)
        self.text = [chr(b) for b in range(256)]
        number = {t: i for i, t in enumerate(self.text)}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(256)]
        self.pair: dict[int, int] = {}
        for m in model["merges"]:
            left, right = (raw(x) for x in (m if isinstance(m, list) else m.split(" ")))
            a, b = number[left], number[right]
            n = number.get(left + right)
            if n is None:
                n = number[left + right] = len(self.text)
                self.text.append(left + right)
                self.parts.append((a, b))
            self.pair.setdefault(a << 20 | b, n)
        ids = {raw(k): v for k, v in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = [ids[t] for t in self.text]
        auto = ahocorasick.Automaton()
        for n, t in enumerate(self.text):
            auto.add_word(t[::-1], (n, len(t)))
        auto.make_automaton()
        self.backwards = auto
        self.size = [len(t) for t in self.text]
        self.number = number
        self._fits: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}

    def shorter(self, n: int) -> int:
        """The longest token that is a proper prefix of token ``n``; -1 if none."""
        got = self._shorter.get(n)
        if got is None:
            t = self.text[n]
            got = next((self.number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.number), -1)
            self._shorter[n] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges can leave token ``a`` right before token ``b``.

        They can unless a merge across the border would have come before the
        merges that built the two.  The later of the two inner pieces is undone
        again and again, and each state's border pair is looked up.
        """
        key = a << 20 | b
        got = self._fits.get(key)
        if got is not None:
            return got
        left, right, before, ok = a, b, 1 << 30, True
        while True:
            across = self.pair.get(left << 20 | right)
            if across is not None and across < before:
                ok = False
                break
            # The last piece formed is taken apart; of equal numbers the left one forms first.
            if left > right:
                before, undo_left = left, True
            else:
                before, undo_left = right + 1, False
            if max(left, right) < 256:
                break
            if undo_left:
                left = self.parts[left][1]
            else:
                right = self.parts[right][0]
        if len(self._fits) < MEMO_PAIRS:
            self._fits[key] = ok
        return ok

    def encode(self, s: str) -> list[int]:
        """Token numbers of a word, given as a string of byte values."""
        whole = self.number.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        longest, reach = [-1] * n, [0] * n
        for end, (tok, k) in self.backwards.iter(s[::-1]):
            start = n - 1 - end
            if k > reach[start]:
                reach[start], longest[start] = k, tok
        size, known, dead, out, pos = self.size, self._fits, bytearray(n + 1), [], 0
        tok, end, last = longest[0], reach[0], -1
        while True:
            if not dead[end]:
                ok = last < 0 or known.get(last << 20 | tok)
                if ok or ok is None and self.fits(last, tok):
                    out.append(tok)
                    if end == n:
                        return out
                    pos, last, tok = end, tok, longest[end]
                    end += size[tok]
                    continue
            tok = self.shorter(tok)
            while tok < 0:  # nothing fits here: this position is of no use
                dead[pos] = 1
                last = out.pop()
                pos -= size[last]
                tok = self.shorter(last)
                last = out[-1] if out else -1
            end = pos + size[tok]


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words = regex.compile(WORD_PATTERN).findall
        self.settled = regex.compile(SETTLED).fullmatch
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.packed = [i.to_bytes(4, "little") for i in vocab.id_of]
        self._pre = None
        outer = self

        class Memo(dict):
            def __missing__(self, word: str) -> bytes:
                ids = b"".join(map(outer.packed.__getitem__, outer.vocab.encode(word.encode().decode("latin-1"))))
                if len(word) <= MEMO_CHARS and len(self) < MEMO_WORDS:
                    self[word] = ids
                return ids

        self.memo = Memo()

    def split(self, text: str) -> list[str]:
        if self.settled(text):
            return self.words(text)
        if self._pre is None:
            from tokenizers import Tokenizer

            self._pre = Tokenizer.from_file(self.vocab.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._pre.pre_tokenize_str(text)]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special is None or "<" not in text or not self.special.search(text):
            return b"".join(map(self.memo.__getitem__, self.split(text)))
        out = []
        for i, piece in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.vocab.special[piece].to_bytes(4, "little"))
            elif piece:
                out += map(self.memo.__getitem__, self.split(piece))
        return b"".join(out)


class Decoder:
    """Ids to text: a blob of all tokens' bytes, and each id's offset in it."""

    def __init__(self, vocab: Vocabulary):
        by_id = {i: t.encode("latin-1") for t, i in zip(vocab.text, vocab.id_of)} | {i: t.encode() for t, i in vocab.special.items()}
        top = max(by_id) + 1
        pieces = [by_id.get(i, b"") for i in range(top)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.start = np.zeros(top + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.start[1:])

    def __call__(self, ids: np.ndarray) -> str:
        return self.bytes(ids).decode("utf-8", "replace")

    def bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        out = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i : i + (1 << 18)]
            first = self.start[part]
            size = self.start[part + 1] - first
            ends = np.cumsum(size)
            at = np.repeat(first - (ends - size), size)
            at += np.arange(len(at))
            out.append(self.blob[at].tobytes())
        return b"".join(out)


@functools.cache
def coder(path: str) -> tuple[Encoder, Decoder]:
    """One of each for a Python worker, whatever the number of its tasks."""
    vocab = Vocabulary(path)
    return Encoder(vocab), Decoder(vocab)


def encode(df: DataFrame, text: str = "text", *, path: str, with_decoded: bool = False, keep_text: bool = True) -> DataFrame:
    """Append ``n_tokens`` and ``ids`` (packed little-endian unsigned 32-bit).

    ``with_decoded`` also appends ``decoded``, the decoder's text of those ids.
    ``unpack`` turns packed ids into an array.
    """

    def make():
        enc, dec = coder(path)

        def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            packed = [enc(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            out = {"n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()), "ids": pa.array(packed, pa.binary())}
            if with_decoded:
                out["decoded"] = pa.array([dec(np.frombuffer(p, "<u4")) for p in packed], pa.string())
            return out

        return run

    return map_batches(df, make, "n_tokens long, ids binary" + ", decoded string" * with_decoded, () if keep_text else (text,))


def decode(df: DataFrame, ids: str = "ids", *, path: str, out: str = "decoded") -> DataFrame:
    """Append the text of the packed ids in column ``ids``; null ids give an empty text.

    Bytes that are not UTF-8 become U+FFFD, as ids from elsewhere may cut characters.
    """

    def make():
        dec = coder(path)[1]
        return lambda batch: {out: pa.array([dec(np.frombuffer(p or b"", "<u4")) for p in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())}

    return map_batches(df, make, f"`{out}` string")


def unpack(packed: bytes | None) -> list[int]:
    return np.frombuffer(packed or b"", "<u4").tolist()
