"""Substring dedup by suffix arrays of shards.

Each window of WIDTH bytes picks one anchor, its GRAM-byte run of least hash, so equal windows pick equal anchors; neighbouring
windows with one anchor make a segment. The anchor names the group in which equal windows meet. Anchors of one document only
are dropped before any text moves. A task takes whole groups: equal segments are counted once, the different ones of many
groups are put together to a shard, whose suffix array is sorted by induction (see suffixarray), and places whose permuted
common prefix with the place before reaches WIDTH make runs of equal windows. What starts in a smaller document is removed.

An anchor of more than LARGE segments isn't held by one task: its equal segments meet by aggregation, and windows of the
different ones by aggregation of their hashes (128 bits). Frequent keys are found on a sample of documents, which decides only
how rows are dealt out, or counted, and are salted or joined by broadcast.

Null or empty text has no bytes. A null id sorts before all others. Rows of equal id and text are one document and get equal
results; texts of equal ids are not compared with each other. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .common import HOT_KEYS, groups, id_back, keyed, met, removed, slices, trimmed, written
from .suffixarray import permuted_common, suffix_array

WIDTH, GRAM = 50, 24
#: Segments of an anchor that one task holds at most, rows and bytes that a task sorts at once (some 80 bytes of arrays for
#: each), sampled documents.
LARGE, ROWS, SHARD, SAMPLE = 100_000, 200_000, 3 << 20, 10_000
#: Anchors that are grouped at once, and about as many a part gets.
FLUSH = 1_500_000
_LOW = np.uint64((1 << 26) - 1)
_RARE = np.uint64(26)


def segments(data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
    """(document, first window, windows, anchor hash) of each segment of the documents in data."""
    if len(data) < width:
        return None
    grams = scan.gram_hashes(scan.BYTES[data], gram)
    low = ((grams >> _RARE) << _RARE) | np.arange(len(grams), dtype=np.uint64)  # ties go to the leftmost
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    anchor = (low & _LOW).astype(np.int64)
    new = np.append(True, anchor[1:] != anchor[:-1])
    # Windows of a document: those that start at least `width` before its end; a document's first one starts a segment.
    first, last = offsets[:-1], np.maximum(offsets[1:] - width + 1, offsets[:-1])
    some = last > first
    new[first[some]] = True
    whole = np.zeros(len(anchor) + 1, dtype=np.int32)
    np.add.at(whole, first[some], 1)
    np.add.at(whole, last[some], -1)
    whole = np.cumsum(whole[:-1]) > 0
    at = np.flatnonzero(new & whole)
    if not len(at):
        return None
    doc = np.searchsorted(offsets, at, "right") - 1
    ends = np.minimum(np.append(at[1:], len(anchor)), last[doc])
    return doc, at - offsets[doc], ends - at, grams[anchor[at]].view(np.int64)


def _anchors(width: int, gram: int, hot: np.ndarray):
    """(r, h, d, p): p holds the first window and, in its low 8 bits, the windows; r deals rows out. h is null where r is it;
    anchors in `hot`, known to be shared, are salted by document."""

    def run(batches):
        for b in batches:
            d = b.column("d").to_numpy()
            for lo, _, data, offsets in scan.texts(b, most=1 << 18):  # what fits a cache
                got = segments(data, offsets, width, gram)
                if got is None:
                    continue
                doc, first, count, h = got
                ids = d[lo + doc]
                known = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
                with np.errstate(over="ignore"):
                    r = np.where(known, scan.mix(h.view(np.uint64) ^ scan.mix(ids.view(np.uint64))).view(np.int64), h)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(h, mask=~known), pa.array(ids), pa.array(first << 8 | count)], names=["r", "h", "d", "p"])

    return run


def _shared(batches):
    """The anchors of a part that more than one document has, and those known to be shared, in any order.

    Rows are grouped FLUSH at a time. Of an anchor that turned out to be shared one row is kept as a mark, of others all, which
    are of one document: so what is held doesn't grow with how frequent an anchor is.
    """
    names = ["h", "d", "p"]
    held, new, rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)], [], 0

    def grouped():
        nonlocal held
        r, d, p = (np.concatenate([h, *(b.column(c).to_numpy() for b in new)]) for h, c in zip(held, ("r", "d", "p")))
        mark = np.concatenate([held[3], np.zeros(len(r) - len(held[3]), bool)])
        order = np.argsort(r)
        r, d, p, mark = r[order], d[order], p[order], mark[order]
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        size = np.diff(np.append(start, len(r)))
        both = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | np.logical_or.reduceat(mark, start)
        several = np.repeat(both, size)
        one = start[both]
        held = [np.concatenate([x[~several], x[one]]) for x in (r, d, p)] + [np.concatenate([mark[~several], np.ones(len(one), bool)])]
        out = several & ~mark
        return pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (r, d, p)], names=names)

    for b in batches:
        known = b.column("h").is_valid()
        if pc.any(known).as_py():
            yield b.filter(known).select(names)
            b = b.filter(pc.invert(known))
        new.append(b)
        rows += b.num_rows
        if rows >= FLUSH:
            yield grouped()
            new, rows = [], 0
    if rows:
        yield grouped()


def _gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each piece, put together, and where each begins (one more: the end)."""
    offsets = np.append(0, np.cumsum(length))
    return data[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _cut_out(width: int, most: int = 20_000):
    """From documents with the places of their shared segments: a row for each segment, with its bytes."""

    def run(batches):
        for b in batches:
            d, t1, places = b.column("d").to_numpy(), b.column("t1").to_numpy(), b.column("places")
            for lo, hi, data, offsets in scan.texts(b):
                part = places.slice(lo, hi - lo)
                sizes, flat = pc.list_value_length(part).to_numpy(), part.flatten()
                doc = np.repeat(np.arange(hi - lo), sizes)
                h, p = (flat.field(c).to_numpy() for c in ("h", "p"))
                at, n = p >> 8, p & 255
                fits = np.flatnonzero(at + n + width - 1 <= np.diff(offsets)[doc])  # else of another text of this id
                for k in range(0, len(fits), most):
                    i = fits[k : k + most]
                    words = _binary(*_gathered(data, offsets[doc[i]] + at[i], n[i] + width - 1))
                    yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(d[lo + doc[i]]), pa.array(t1[lo + doc[i]]), pa.array(at[i].astype(np.int32)), pa.array(n[i].astype(np.int32)), words], names=["h", "d", "t1", "at", "n", "words"])

    return run


def repeated(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place) of each window that a segment of a smaller document has too, by the segments' suffix array."""
    sizes = np.diff(offsets)
    segment = np.repeat(np.arange(len(docs)), sizes + 1)
    first = offsets[:-1] + np.arange(len(docs))
    text = np.ones(len(segment) + 1, dtype=np.int64)  # 1 ends a segment, 0 the text
    text[np.arange(len(data)) + np.repeat(np.arange(len(docs)), sizes)] = data.astype(np.int64) + 2
    text[-1] = 0
    ends = np.append((first + sizes)[segment], len(segment))
    fresh = np.zeros(len(text), dtype=bool)
    fresh[first] = True
    order = suffix_array(text)
    shared = permuted_common(text, order, ends, fresh)[order] >= width
    start = np.flatnonzero(~shared)
    doc = docs[segment[np.minimum(order, len(segment) - 1)]]
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(order))))
    place = np.sort(order[doc > least])
    return segment[place], place - first[segment[place]]


def _matched(width: int):
    """From whole groups, sorted by anchor, bytes and document: (d, t1, at, n), windows that start in a smaller document too."""

    def shard(t: pa.Table, rep: np.ndarray, d: np.ndarray):
        words = t.column("words").combine_chunks().take(pa.array(rep))
        _, off, raw = words.buffers()
        offsets = np.frombuffer(off, dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        return repeated(np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0], d[rep], width)

    def run(batches):
        for t in groups(batches, ["h"], ROWS):
            h, d, t1, at, n = (t.column(c).to_numpy() for c in ("h", "d", "t1", "at", "n"))
            words = t.column("words").combine_chunks()
            new = np.ones(t.num_rows, dtype=bool)
            if t.num_rows > 1:
                new[1:] = (h[1:] != h[:-1]) | ~pc.equal(words.slice(1), words.slice(0, t.num_rows - 1)).to_numpy(zero_copy_only=False)
            rep, of = np.flatnonzero(new), np.cumsum(new) - 1
            whole = d > d[rep][of]
            out = [(np.flatnonzero(whole), at[whole], n[whole])]
            start = np.flatnonzero(np.append(True, h[rep][1:] != h[rep][:-1]))
            kinds = np.diff(np.append(start, len(rep)))
            many = np.flatnonzero(np.repeat(kinds > 1, kinds))  # only of anchors with different segments
            size = np.cumsum(n[rep[many]] + width)
            edges = start[np.isin(start, many)]
            cut, lo = [], 0
            while lo < len(many):
                hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SHARD))
                hi = len(many) if hi >= len(many) else int(np.searchsorted(many, edges[max(1, np.searchsorted(edges, many[hi], "right")) - 1]))
                if hi <= lo:  # one group above the size
                    k = int(np.searchsorted(edges, many[lo], "right"))
                    hi = int(np.searchsorted(many, edges[k])) if k < len(edges) else len(many)
                cut.append((lo, hi))
                lo = hi
            for lo, hi in cut:
                seg, place = shard(t, rep[many[lo:hi]], d)
                if not len(seg):
                    continue
                first = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (place[1:] != place[:-1] + 1)))
                kind, begin, count = many[lo:hi][seg[first]], place[first], np.diff(np.append(first, len(seg)))
                rows = np.flatnonzero(~whole)  # a document may have its segment at several places
                a, z = np.searchsorted(kind, of[rows]), np.searchsorted(kind, of[rows], "right")
                rows, a, z = rows[z > a], a[z > a], z[z > a]
                k = np.repeat(a - np.append(0, np.cumsum(z - a)[:-1]), z - a) + np.arange((z - a).sum())
                rows = np.repeat(rows, z - a)
                out.append((rows, at[rows] + begin[k], count[k]))
            i, a, c = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(d[i]), pa.array(t1[i]), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32))], names=["d", "t1", "at", "n"])

    return run


def _windows(width: int):
    """The windows of segments, by 128 hash bits."""

    def run(batches):
        for b in slices(batches, 2_000):
            w1, w2, row, place = [], [], [], []
            for i, text in enumerate(b.column("words").to_pylist()):
                for k in range(len(text) - width + 1):
                    x = xxhash.xxh3_128_digest(text[k : k + width])
                    w1.append(int.from_bytes(x[:8], "little", signed=True))
                    w2.append(int.from_bytes(x[8:], "little", signed=True))
                    row.append(i)
                    place.append(k)
            at = b.column("at").to_numpy()[row] + np.array(place, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(w1, pa.int64()), pa.array(w2, pa.int64()), b.column("d").take(pa.array(row, pa.int32())), b.column("t1").take(pa.array(row, pa.int32())), pa.array(at.astype(np.int32))], names=["w1", "w2", "d", "t1", "at"])

    return run


_SEGMENT = "h long, d long, t1 long, at int, n int, words binary"
_GONE = "d long, t1 long, at int, n int"


def frequent_anchors(keys: DataFrame, docs: int, width: int, gram: int) -> np.ndarray:
    """Anchors of different documents that have more than one in HOT_KEYS of a sample's: fewer than HOT_KEYS."""
    part = keys.sample(SAMPLE / docs, seed=11) if docs > SAMPLE else keys
    rows = written(part.mapInArrow(_anchors(width, gram, np.zeros(0, np.int64)), "r long, h long, d long, p long").select("r", "d"), "suffix-sample")
    total = rows.count()
    hot = rows.groupBy("r").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.count(F.lit(1)).alias("n")).filter((F.col("a") < F.col("b")) & (F.col("n") * HOT_KEYS > total))
    got = np.sort(np.array([x["r"] for x in hot.select("r").collect()], dtype=np.int64))
    removed(keys.sparkSession, rows)
    return got


def large_groups(hot: DataFrame, width: int, total: int) -> DataFrame:
    """What _matched() gives, of anchors with very many segments: equal ones by aggregation, then windows by their hashes."""
    reps = written(hot.groupBy("h", "words").agg(F.min("d").alias("d0"), F.count(F.lit(1)).alias("c")), "suffix-equal")
    rows = met(hot, reps, ["h", "words"], "c", total)
    whole = rows.filter("d > d0").select("d", "t1", "at", "n")
    windows = rows.filter("d = d0").select("d", "t1", "at", "words").mapInArrow(_windows(width), "w1 long, w2 long, d long, t1 long, at int")
    windows = written(windows, "suffix-windows")
    first = windows.groupBy("w1", "w2").agg(F.min("d").alias("d0"), F.max("d").alias("d9"), F.count(F.lit(1)).alias("c")).filter("d9 > d0").drop("d9")
    first = written(first, "suffix-first")
    total = first.agg(F.sum("c")).first()[0] or 0
    single = met(windows, first, ["w1", "w2"], "c", total).filter("d > d0").select("d", "t1", "at", F.lit(1).alias("n"))
    return whole.unionByName(single)


def gone(keys: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(d, t1, gone): windows of each document, as (at, n), that start in a smaller document too."""
    spark = keys.sparkSession
    docs, size = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    hot = frequent_anchors(keys, docs, width, gram)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // ((width - gram + 2) * FLUSH))
    anchors = keys.mapInArrow(_anchors(width, gram, hot), "r long, h long, d long, p long")
    shared = anchors.repartition(parts, "r").mapInArrow(trimmed(_shared), "h long, d long, p long")
    shared = written(shared, "suffix-places")
    places = shared.groupBy("d").agg(F.collect_set(F.struct("h", "p")).alias("places"))
    cut = keys.join(places, "d").select("d", "t1", "text", "places").mapInArrow(trimmed(_cut_out(width)), _SEGMENT)
    cut = written(cut, "suffix-segments")
    removed(spark, shared)
    large = cut.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > LARGE)
    large = written(large.select("h", "c", F.lit(True).alias("large")), "suffix-large")
    total = large.agg(F.sum("c")).first()[0]
    some = cut.join(large.drop("c"), "h", "left").filter("large IS NULL").drop("large") if total else cut
    rest = some.repartition("h").sortWithinPartitions("h", "words", "d").mapInArrow(trimmed(_matched(width)), _GONE)
    if total:
        rest = rest.unionByName(large_groups(cut.join(large.select("h"), "h"), width, total))
    out = written(rest.groupBy("d", "t1").agg(F.collect_list(F.struct("at", "n")).alias("gone")), "suffix-gone")
    removed(spark, cut)
    return out


def _kept(width: int, digest: bool):
    def run(batches):
        for b in slices(batches):
            sizes, cut, spans, kept = [], [], [], []
            for text, places in zip(b.column("text").to_pylist(), b.column("gone"), strict=True):
                data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
                lost = np.zeros(len(data), dtype=bool)
                if places.is_valid:
                    at, n = (places.values.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
                    fits = at + n + width - 1 <= len(data)
                    edge = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(edge, at[fits], 1)
                    np.add.at(edge, (at + n + width - 1)[fits], -1)
                    lost = np.cumsum(edge[:-1]) > 0
                left = data[~lost].tobytes()
                sizes.append(len(data))
                cut.append(int(lost.sum()))
                spans.append(int((lost & ~np.append(False, lost[:-1])).sum()) if len(data) else 0)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays([b.column("d"), *(pa.array(x, pa.int64()) for x in (sizes, cut, spans)), pa.array(kept, pa.string() if digest else pa.binary())], names=["d", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the bytes that are left (a cut may part a character), or their SHA-256."""
    keys = keyed(docs)
    rows = keys.join(gone(keys, width, gram), ["d", "t1"], "left").select("d", "text", "gone")
    out = rows.mapInArrow(_kept(width, digest), f"d long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.select(id_back().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
