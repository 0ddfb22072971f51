"""Token ids in a binary file format with bit-plane shuffled blocks.

A file holds consecutive documents.  Their ids, end ids included, are one stream,
cut into blocks of BLOCK ids; only a file's last block is shorter.  A block's
16- or 32-bit ids are transposed into bit planes (or byte planes), each plane is
compressed with zstandard on its own, and planes of zeros take no bytes.

Layout (little-endian): blocks, then the index, each closed by MARK so that
Spark's own text writer can write the file under its commit protocol:

    block  plane bytes, one after the other
    index  zstd(JSON): kind of planes, id width, for each block (offset, ids,
           plane sizes), and for the documents (ids or null, numbers of ids)
    tail   length of the index as 8 bytes, MAGIC

The part numbers in file names ascend in the order of the documents.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import ship
from .common import BATCH_BYTES, slices

MAGIC, MARK = b"TOKPLAN1", "\n"
BLOCK = 1 << 16
#: Above so many files their size grows instead.
MOST_FILES = 300_000
LEVEL = 3


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Bit or byte planes of unsigned ids, the least significant first."""
    width = ids.dtype.itemsize
    raw = np.ascontiguousarray(ids).view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, width: int, kind: str = "bit") -> np.ndarray:
    """The ids again; an empty bit plane is one of zeros."""
    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
        return np.ascontiguousarray(raw).view(f"<u{width}").ravel()
    out = np.zeros(n, f"<u{width}")
    for k, p in enumerate(planes):
        if p:
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            out |= bits.astype(out.dtype) << out.dtype.type(k)
    return out


def pack_block(ids: np.ndarray, kind: str, squeeze: zstandard.ZstdCompressor) -> tuple[bytes, list[int]]:
    """The block's bytes and its planes' sizes; a plane of zeros has size 0 and no bytes."""
    out, sizes = [], []
    for p in to_planes(ids, kind):
        if not any(p):
            sizes.append(0)
        else:
            c = squeeze.compress(p)
            out.append(c)
            sizes.append(len(c))
    return b"".join(out), sizes


def unpack_block(raw: bytes, n: int, sizes: list[int], width: int, kind: str, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    planes, at = [], 0
    for s in sizes:
        planes.append(expand.decompress(raw[at : at + s]) if s else bytes(n if kind == "byte" else 0))
        at += s
    return from_planes(planes, n, width, kind)


class FileWriter:
    """Feeds on documents' ids and gives the pieces of a file, each to be closed by MARK."""

    def __init__(self, width: int = 2, kind: str = "bit", block: int = BLOCK):
        self.dtype, self.width, self.kind, self.block = np.dtype(f"<u{width}"), width, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL)
        self.wait: list[np.ndarray] = []
        self.waiting = self.offset = 0
        self.blocks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def _block(self, ids: np.ndarray) -> bytes:
        raw, sizes = pack_block(ids, self.kind, self.squeeze)
        self.blocks.append([self.offset, len(ids), sizes])
        self.offset += len(raw) + len(MARK)
        return raw

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.wait.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every = np.concatenate(self.wait)
            whole = len(every) // self.block * self.block
            for k in range(0, whole, self.block):
                yield self._block(every[k : k + self.block])
            self.wait, self.waiting = [every[whole:]], len(every) - whole

    def close(self):
        if self.waiting:
            yield self._block(np.concatenate(self.wait))
        index = {"planes": self.kind, "width": self.width, "blocks": self.blocks, "doc_ids": self.doc_ids, "sizes": self.sizes}
        raw = zstandard.ZstdCompressor(level=9).compress(json.dumps(index, separators=(",", ":")).encode())
        yield raw + len(raw).to_bytes(8, "little") + MAGIC


class FileReader:
    """Documents of a file, one block in memory at a time."""

    def __init__(self, raw: bytes):
        end = len(raw) - len(MARK)
        if raw[end - 8 : end] != MAGIC:
            raise ValueError("not a token file")
        n = int.from_bytes(raw[end - 16 : end - 8], "little")
        self.raw = raw
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(raw[end - 16 - n : end - 16]))

    def blocks(self):
        expand = zstandard.ZstdDecompressor()
        for offset, n, sizes in self.index["blocks"]:
            yield unpack_block(self.raw[offset : offset + sum(sizes)], n, sizes, self.index["width"], self.index["planes"], expand)

    def documents(self):
        """(doc_id, parts): the parts are the runs of ids that the document has in its blocks."""
        blocks, rest = self.blocks(), np.zeros(0, f"<u{self.index['width']}")
        for doc_id, n in zip(self.index["doc_ids"], self.index["sizes"]):
            parts = []
            while n:
                if not len(rest):
                    rest = next(blocks)
                parts.append(rest[:n])
                n -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            yield doc_id, parts


class WordIds:
    """Ids of texts by the tokenizers library, word by word.

    The tokenizer's own pre-tokenizer drops white space and never joins across
    it, and its normalizer acts within words, so a text's ids are those of its
    runs without space, tab or newline in turn.  Each different run is encoded
    by the library once, in batches, and remembered up to a bound.

    Where a text is Latin and holds no special token, lower case and a full stop
    or comma set apart from its word change no id, and make runs meet more often.

    All of this holds for tokenizers with the normalizer, pre-tokenizer and model
    below; texts go whole to the library if the file has others.
    """

    MEMO, RUN, JOINED = 500_000, 48, 4_000
    #: What the tokenizer's file must say.
    NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    SPLIT = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.memo: dict[str, bytes] = {}
        told = json.loads(self.lib.to_str())
        self.by_word = (
            told["normalizer"] == self.NORMAL and told["pre_tokenizer"] == self.SPLIT and told["post_processor"] is None
            and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and all(t["content"].startswith("<") and t["special"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in told["added_tokens"])
        )

    def _runs(self, text: str) -> list[str]:
        if "<" not in text and _LATIN(text):
            text = text.lower()
            if not _DOUBLED(text):
                text = text.replace(". ", " . ").replace(".\n", " . ").replace(", ", " , ").replace(",\n", " , ")
        return text.replace("\n", " ").replace("\t", " ").split(" ")

    def _encode(self, runs: list[str]) -> None:
        """Fill the memo: Latin words joined to long texts, other runs one by one."""
        put = self.memo.update
        plain = [w for w in runs if (low := w.lower()).isalpha() and _LATIN(low)]
        for k in range(0, len(plain), self.JOINED):
            part = plain[k : k + self.JOINED]
            e = self.lib.encode(" ".join(part), add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), (4 * np.bincount(e.word_ids, minlength=len(part)).cumsum()).tolist()
            put(zip(part, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        done = set(plain)
        other = [w for w in runs if w not in done]
        for k in range(0, len(other), self.JOINED):
            part = other[k : k + self.JOINED]
            put(zip(part, [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(part, add_special_tokens=False)]))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(e.ids, "<u4") for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        get, split, open_, new = self.memo.get, [], [], set()
        for t in texts:
            words = self._runs(t)
            pieces = list(map(get, words))
            if None in pieces:  # most words are known: one look-up is all they cost
                at = [k for k, p in enumerate(pieces) if p is None]
                new.update(map(words.__getitem__, at))
                open_.append((pieces, at, [words[k] for k in at]))
            split.append(pieces)
        if new:
            self._encode(list(new))
        for pieces, at, words in open_:
            for k, w in zip(at, words):
                pieces[k] = self.memo[w]
        out = [np.frombuffer(b"".join(pieces), "<u4") for pieces in split]
        if len(self.memo) > self.MEMO:  # the newest go, the oldest are the most frequent
            for w in new:
                del self.memo[w]
        else:
            for w in new:
                if len(w) > self.RUN:
                    del self.memo[w]
        return out


#: Of these characters lower case and class are the same in all Unicode versions, and none combine.
_LATIN = re.compile("[\x00-\u024f]*+").fullmatch
#: A full stop or comma after a sign, which belongs to one word with it; the white space is the tokenizer's, which has no U+001C to U+001F.
_DOUBLED = re.compile("[^ \t-\r\u0085\u00a0a-z0-9\u00df-\u00f6\u00f8-\u024f][.,](?=[ \t-\r])").search
_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for a Python worker, whatever the number of its tasks."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def write(df: DataFrame, out: str, *, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", kind: str = "bit", file_docs: int = 6_000) -> None:
    """Encode each whole text, add ``end_id``, and write files in ascending id.

    Ids are cut into ranges; a range is sorted, encoded and written as a stream,
    as one file.  Null ids come first, rows of one id in the order of the text's
    hash; a null or empty text is its end id alone.  Ids take 16 bits if the
    tokenizer's vocabulary allows.
    """
    from tokenizers import Tokenizer

    spark = df.sparkSession
    ship(spark)
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    d = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, min(MOST_FILES, -(-d.count() // file_docs)))
    # a frequent id, or none, is dealt over several ranges by the hash
    ordered = d.repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))

    def run(batches):
        enc, w, seen = word_ids(path), FileWriter(width, kind), False
        end = np.array([end_id])
        for b in (x for batch in batches for x in slices(batch, 1 << 20)):  # its words are a hundred times as large
            ids = b.column(0).to_pylist()
            seen = seen or bool(ids)
            pieces = []
            for i, t in zip(ids, enc([t or "" for t in b.column(1).to_pylist()])):
                pieces += w.add(i, np.concatenate([t, end]))
            yield pa.RecordBatch.from_pydict({"piece": pa.array(pieces, pa.binary())})
        if seen:
            yield pa.RecordBatch.from_pydict({"piece": pa.array(list(w.close()), pa.binary())})

    pieces = ordered.mapInArrow(run, "piece binary")
    pieces.select(F.col("piece").cast("string").alias("value")).write.option("lineSep", MARK).text(out)


def read(spark: SparkSession, at: str, *, with_ids: bool = True) -> DataFrame:
    """(file, place, doc_id, start, n_tokens, ids_crc32, ids) of all files of a folder.

    ``start`` counts the ids of all documents before; ``ids`` is packed
    little-endian unsigned 32-bit.  Files are expanded block by block.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(at).select("path", "content")

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if not raw:
                    continue
                rows, size, start = [], 0, 0
                for place, (doc_id, parts) in enumerate(FileReader(raw).documents()):
                    crc, n, kept = 0, 0, []
                    for p in parts:
                        wide = p.astype("<u4").tobytes()
                        crc, n = zlib.crc32(wide, crc), n + len(p)
                        if with_ids:
                            kept.append(wide)
                    rows.append((name.rpartition("/")[2], place, doc_id, start, n, crc, b"".join(kept)))
                    start += n
                    size += 4 * n if with_ids else 64
                    if size > BATCH_BYTES:
                        yield _rows(rows, with_ids)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    kind = "file string, place long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    got = files.mapInArrow(run, kind)
    # ids of the files before, in the order of their part numbers, which have five digits or more: from the files' indexes alone, one row a file

    def totals(batches):
        for b in (x for batch in batches for x in slices(batch)):
            names, sums = [], []
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if raw:
                    names.append(name.rpartition("/")[2])
                    sums.append(sum(FileReader(raw).index["sizes"]))
            yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "n": pa.array(sums, pa.int64())})

    total = files.mapInArrow(totals, "f string, n long")
    run_sum = F.coalesce(F.sum("n").over(W.orderBy(F.regexp_extract("f", "^part-([0-9]+)", 1).try_cast("long"), "f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = total.withColumn("before", run_sum).select("f", "before")
    out = got.join(before, got.file == before.f).withColumn("start", F.col("at") + F.col("before"))
    return out.select("file", "place", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 6 + with_ids]
    names = ["file", "place", "doc_id", "at", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names[: len(kinds)])
