"""Packing by power-of-two decomposition.

Each document is tokenised, closed by an end id and cut into pieces whose lengths are powers of two: as many of the longest
as fit, then the binary digits of the rest from high to low. Each piece is a sequence of its own, so no sequence crosses
documents and none is padded. Equal lengths form a bucket, the column `bucket` (log2 of the length); write() puts each into a
folder of its own, and sequence_id modulo BUCKETS names it too.

Null text is empty: its only id is the end id. Repeated rows are packed as often as they come. Extra columns are ignored.
Needs no shuffle; a lost executor costs the tasks it ran. Sequence ids are unique within a result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .common import trimmed

LONGEST, END, BUCKETS = 4096, 2, 13
#: Distinct words that each of two generations of a worker's cache holds.
_CACHE = 600_000
_MARKS = b".,;:!?"


def cuts(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


class WordEncoder:
    """Ids of whole texts with a tokenizer that never looks across white space and lowers case.

    Each distinct word is encoded once while a cache holds it; words of many texts are encoded in one call. Marks at the end
    of a word are words of their own to the tokenizer, so word and mark are looked up apart. Texts that may hold one of the
    tokenizer's special strings are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        ending = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that close a word
        if ending:
            self.ends[[i for w, i in vocabulary.items() if w.endswith(ending)]] = True

    def forget(self) -> None:
        self.known, self.old = {}, {}

    def _encode(self, words: list[bytes]) -> None:
        """Words of letters only are one word to the tokenizer too: many go in one text, whose ids are parted at word ends."""
        known, apart = self.known, []
        texts = [w.decode("utf-8") for w in words]
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        for lo in range(0, len(plain), 2048):
            at = plain[lo : lo + 2048]
            raw = array("I", self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in at])], add_special_tokens=False)[0].ids)
            cuts = (np.flatnonzero(self.ends[np.frombuffer(raw, dtype=np.uint32)]) + 1) * 4
            if len(cuts) != len(at):
                apart += at
                continue
            ids, start = raw.tobytes(), 0
            for k, stop in zip(at, cuts.tolist(), strict=True):
                known[words[k]] = ids[start:stop]
                start = stop
        apart += [k for k, t in enumerate(texts) if not t.isalpha()]
        for k, e in zip(apart, self.tokenizer.encode_batch_fast([texts[k] for k in apart], add_special_tokens=False), strict=True):
            known[words[k]] = array("I", e.ids).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        known, old, new = self.known, self.old, []
        ends: dict[bytes, tuple[bytes, bytes]] = {}
        for w in words:
            if (ids := old.get(w)) is not None:
                known[w] = ids
                continue
            base = w.rstrip(_MARKS)
            if base and base != w and (base[-1] in _LETTERS):
                ends[w] = base, w[len(base) :]
            else:
                new.append(w)
        needed = {x for pair in ends.values() for x in pair if x not in known}
        for x in needed:
            if (ids := old.get(x)) is not None:
                known[x] = ids
        new = list({*new, *(x for x in needed if x not in known)})
        self._encode(new)
        for w, (base, mark) in ends.items():
            known[w] = known[base] + known[mark]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > _CACHE:
            self.known, self.old = {}, self.known
        self._learn(set(words).difference(self.known))
        return list(map(self.known.__getitem__, words))

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each document in data. Each distinct word of the lot is looked up once, the rest is array work."""
        raw = data.tobytes()
        if b"<|" in raw:
            texts = [raw[i:j].decode("utf-8") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        data = _LOWER[data]
        start, end = scan.spans(data, offsets, scan.BLANKS)
        if not len(start):
            return [np.zeros(0, dtype="<u4")] * (len(offsets) - 1)
        size = np.append(0, np.cumsum(end - start))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(size), pa.py_buffer(data[~scan.BLANKS[data]])])
        words = words.dictionary_encode()  # by the bytes themselves
        of = words.indices.to_numpy()
        parts = self._ids(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), dtype="<u4")
        count = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        at = (np.cumsum(count) - count)[of]
        count = count[of]
        upto = np.cumsum(count)
        ids = flat[np.repeat(at - (upto - count), count) + np.arange(upto[-1])]
        doc = np.searchsorted(start, offsets[1:], "left")  # words up to the end of each document
        cut = np.append(0, upto)[doc]
        return np.split(ids, cut[:-1])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTERS = frozenset(range(97, 123))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One a worker process, so that later tasks find its cache filled."""
    return WordEncoder(path)


def _pieces(path: str, longest: int, end: int, with_ids: bool, keep: bool = True):
    """keep: whether a worker keeps the words it knows for its next task."""

    def run(batches):
        own = encoder(path)
        for b in batches:
            for lo, hi, data, offsets in scan.texts(b, most=8 << 20):
                yield batch(b.column("doc_id").slice(lo, hi - lo).to_pylist(), own.documents(data, offsets))
        if not keep:
            own.forget()

    def batch(doc_ids, documents):
        cols: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        for doc_id, ids in zip(doc_ids, documents, strict=True):
            ids = np.append(ids, np.array([end], dtype="<u4")).astype("<u4", copy=False)
            at = 0
            for n in cuts(len(ids), longest):
                piece = ids[at : at + n]
                cols["doc_id"].append(doc_id)
                cols["start"].append(at)
                cols["length"].append(n)
                cols["ids_crc32"].append(zlib.crc32(piece))
                cols["doc_tokens"].append(len(ids))
                if with_ids:
                    cols["ids"].append(piece.view(np.int32))
                at += n
        arrays = [pa.array(cols[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array(cols["ids"], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end: int = END, with_ids: bool = False, keep: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, ids if asked for, bucket, sequence_id, offset."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(trimmed(_pieces(tokenizer, longest, end, with_ids, keep)), schema)
    out = out.withColumn("bucket", F.log2("length").cast("int"))
    return out.withColumn("sequence_id", F.monotonically_increasing_id() * BUCKETS + F.col("bucket")).withColumn("offset", F.lit(0).cast("long"))


def write(packed: DataFrame, path: str) -> None:
    """Parquet with a folder for each bucket, so that a batch of sequences of one length is read from one place."""
    packed.write.partitionBy("bucket").parquet(path)


def stage(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All documents, packed, with their ids. Workers serve other stages too, so none keeps its words."""
    return pack(docs, tokenizer, with_ids=True, keep=False)
