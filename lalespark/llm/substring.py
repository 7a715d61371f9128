"""Substring dedup with suffix automata of reference shards.

A window is WIDTH consecutive words. Each window picks one anchor, the GRAM-word run of least hash in it, so equal windows
pick equal anchors; neighbouring windows with one anchor make a segment. The anchor names the shard: every segment is dealt
to the shard of its anchor, and there segments stream, in order of their place in the corpus, through a suffix automaton of
the shard's earlier segments. Matching statistics of WIDTH or more mark windows that start earlier too; their words go.

The reference is the corpus itself, which has no size bound, so a shard's automaton isn't broadcast to all documents: it
stands where the anchor sends the only segments that can match it. Anchors that occur once are dropped before any text
moves. An anchor of more than HOT places is dealt to several salted shards first, each of which keeps only the windows that
are new to it; what they keep is dealt out once more, each window by its own hash, so no group grows with the corpus. Exact
copies of a whole text are found by aggregated hashes and don't stream at all.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Null or empty text has none. A null id sorts first. Rows of equal id and text are
one document and get equal results; of different texts with one id the order is that of their hashes. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .automaton import SuffixAutomaton
from .common import changes, groups, id_back, keyed, met, slices, written

WIDTH, GRAM = 20, 6
#: Places of an anchor from which on it is dealt to several shards.
HOT = 2000
_SHIFT = np.uint64(26)


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """(document, first window, windows, anchor hash) of each segment of the documents in data."""
    start, end = scan.spans(data, offsets, scan.BLANKS)
    if len(start) < width:
        return None
    words = scan.word_hashes(data, start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    grams = scan.gram_hashes(words, gram)
    key = ((grams >> _SHIFT) << _SHIFT) | np.arange(len(grams), dtype=np.uint64)  # ties go to the leftmost
    span, reach = width - gram + 1, 1
    low = key
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    n = len(words) - width + 1
    anchor = (low[:n] & np.uint64((1 << 26) - 1)).astype(np.int64)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    if not len(whole):
        return None
    a, d = anchor[whole], doc[whole]
    new = np.ones(len(whole), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    first = np.searchsorted(doc, d[at], "left")
    count = np.diff(np.append(at, len(whole)))
    return d[at], whole[at] - first, count, grams[a[at]].view(np.int64)


def _anchors(width: int, gram: int):
    """(h, d, p): p holds the first window and, in its low 8 bits, the number of windows."""

    def run(batches):
        for b in batches:
            d = b.column("d").to_numpy()
            for lo, _, data, offsets in scan.texts(b):
                got = segments(data, offsets, width, gram)
                if got is not None:
                    doc, first, count, h = got
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d[lo + doc]), pa.array(first << 8 | count)], names=["h", "d", "p"])

    return run


def _cut_out(width: int):
    """From documents with the places of their shared segments: a row for each segment, with its words."""

    def run(batches):
        for b in slices(batches):
            rows = {k: [] for k in _KINDS}
            for d, t1, text, places in zip(*(b.column(k).to_pylist() for k in ("d", "t1", "text", "places")), strict=True):
                words = text.encode("utf-8").split()
                for p in places:
                    at, n = p["p"] >> 8, p["p"] & 255
                    if at + n + width - 1 > len(words):  # of another text of this id
                        continue
                    for k, v in zip(_KINDS, (p["h"], p["salt"], d, t1, at, b" ".join(words[at : at + n + width - 1])), strict=True):
                        rows[k].append(v)
                if len(rows["g"]) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in _KINDS.items()], names=list(_KINDS))
                    rows = {k: [] for k in rows}
            if rows["g"]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in _KINDS.items()], names=list(_KINDS))

    return run


_SEGMENT = "g long, salt int, d long, t1 long, s int, words binary"
_KINDS = {"g": pa.int64(), "salt": pa.int32(), "d": pa.int64(), "t1": pa.int64(), "s": pa.int32(), "words": pa.binary()}


def _match(width: int):
    """Streams each group's segments, in order, through an automaton of the earlier ones."""

    def run(batches):
        for t in groups(batches, ["g", "salt"], 5_000):
            start = changes(t, ["g", "salt"])
            ends = np.append(start[1:], t.num_rows)
            words = t.column("words").to_pylist()
            salt = t.column("salt").to_numpy()
            gone: list[list[int]] = [[] for _ in words]
            fresh: list[list[int]] = [[] for _ in words]
            first = t.column("s").to_pylist()
            for lo, hi in zip(start.tolist(), ends.tolist(), strict=True):
                auto, waiting, whole = None, None, set()
                for k in range(lo, hi):
                    text = words[k]
                    if text in whole:  # the same segment once more: all its windows match
                        gone[k] = list(range(first[k], first[k] + text.count(b" ") + 2 - width))
                        continue
                    whole.add(text)
                    seg = text.split(b" ")
                    total = len(seg) - width + 1
                    if waiting is None:  # the group's first segment: nothing is earlier
                        waiting, hits = seg, []
                    else:
                        if auto is None:
                            auto = SuffixAutomaton()
                            auto.add(waiting)
                        hits = [i - width + 1 for i, n in enumerate(auto.statistics(seg)) if n >= width]
                        if len(hits) < total:
                            auto.add(seg)
                    gone[k] = [first[k] + i for i in hits]
                    if salt[k] >= 0:
                        seen = set(hits)
                        fresh[k] = [i for i in range(total) if i not in seen]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(t.column(c).to_numpy()) for c in ("d", "t1", "s")),
                    pa.array(gone, pa.list_(pa.int32())),
                    pa.array([[b" ".join(w.split(b" ")[i : i + width]) for i in f] if f else [] for w, f in zip(words, fresh, strict=True)], pa.list_(pa.binary())),
                    pa.array(fresh, pa.list_(pa.int32())),
                ],
                names=["d", "t1", "s", "gone", "fresh", "at"],
            )

    return run


_MATCHED = "d long, t1 long, s int, gone array<int>, fresh array<binary>, at array<int>"


def _stream(rows: DataFrame, width: int) -> DataFrame:
    keys = ["g", "salt"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "d", "t1", "s").mapInArrow(_match(width), _MATCHED)


def copies(keys: DataFrame) -> DataFrame:
    """(d, t1, t2) of texts that a smaller id has too. The smallest id is an aggregate, and copies of frequent texts meet it by
    broadcast, so that no task gets all of them."""
    ids = written(keys.filter(F.length("text") > 0).select("d", "t1", "t2"), "substring-ids")
    first = ids.groupBy("t1", "t2").agg(F.min("d").alias("d0"), F.max("d").alias("d9"), F.count(F.lit(1)).alias("c")).filter("d9 > d0").drop("d9")
    first = written(first, "substring-first")
    rows = first.agg(F.sum("c")).first()[0] or 0
    return met(ids, first, ["t1", "t2"], "c", rows).filter("d > d0").select("d", "t1", "t2").distinct()


def marked(keys: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """keys with `copy` (a smaller id has the same text) and `gone` (starts of windows that start earlier too)."""
    copy = written(copies(keys).withColumn("copy", F.lit(True)), "substring-copies")
    anchors = written(keys.mapInArrow(_anchors(width, gram), "h long, d long, p long"), "substring-anchors")
    # A table of its own, so that a skew join can split the anchors of a frequent hash.
    shared = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "substring-shared")
    # The count decides on salting: -1 for the one shard of an anchor, else one of several.
    salt = F.when(F.col("c") > HOT, F.pmod(F.xxhash64("d"), F.ceil(F.col("c") / F.lit(HOT / 2)))).otherwise(F.lit(-1)).cast("int")
    places = anchors.join(shared, "h").select("d", F.struct("h", "p", salt.alias("salt")).alias("p"))
    places = written(places.groupBy("d").agg(F.collect_set("p").alias("places")), "substring-places")
    whole = copy.groupBy("d").agg(F.collect_set(F.struct("t1", "t2")).alias("whole"))
    cut_out = keys.join(places, "d").join(whole, "d", "left")
    cut_out = cut_out.filter(~F.coalesce(F.array_contains("whole", F.struct("t1", "t2")), F.lit(False)))
    cut_out = cut_out.select("d", "t1", "text", "places").mapInArrow(_cut_out(width), _SEGMENT)
    one = written(_stream(cut_out, width), "substring-matched")
    # What salted shards kept, one window a row, by its own hash: each is compared with its equals only.
    again = one.filter(F.size("fresh") > 0).select("d", "t1", "s", F.explode(F.arrays_zip("fresh", "at")).alias("w"))
    again = again.select(F.xxhash64("w.fresh").alias("g"), F.lit(-1).alias("salt"), "d", "t1", (F.col("s") + F.col("w.at")).alias("s"), F.col("w.fresh").alias("words"))
    two = _stream(again, width)
    gone = one.select("d", "t1", "gone").unionByName(two.select("d", "t1", "gone")).filter(F.size("gone") > 0)
    gone = gone.groupBy("d", "t1").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    copy = copy.select("d", "t1", "copy").distinct()
    return keys.join(gone, ["d", "t1"], "left").join(copy, ["d", "t1"], "left")


def _kept(width: int, digest: bool):
    def run(batches):
        for b in slices(batches):
            n, removed, texts = [], [], []
            for text, gone, copy in zip(*(b.column(k).to_pylist() for k in ("text", "gone", "copy")), strict=True):
                words = text.encode("utf-8").split()
                keep = words
                if copy and len(words) >= width:
                    keep = []
                elif gone:
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    at = np.unique(np.array(gone, dtype=np.int64))
                    edge[at] += 1
                    edge[at + width] -= 1
                    keep = [w for w, c in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not c]
                n.append(len(words))
                removed.append(len(words) - len(keep))
                left = b" ".join(keep)
                texts.append(hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["d", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is what is left, words joined by one space, or its SHA-256."""
    rows = marked(keyed(docs), width, gram).select("d", "text", "gone", "copy")
    out = rows.mapInArrow(_kept(width, digest), "d long, n_words long, n_removed long, kept string")
    return out.select(id_back().alias("doc_id"), "n_words", "n_removed", "kept")
