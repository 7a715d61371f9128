"""Benchmark decontamination with BM25 and block-max WAND.

Test items are indexed by pairs of neighbouring words (an item of one word by that): a posting holds the item and the pair's
share of the item's own BM25 score, so a passage that holds all of an item scores 1. Single words would not do: a passage's
common words alone reach the bounds of short items, and nine passages in ten could not be skipped. Postings are in item
order, in blocks that keep their largest share. Every passage of every document is a query: overlapping runs of words, long enough that an item lies whole in one. All items that score
`least` or more are retrieved; retrieval skips by upper bounds only, so none is lost. First the bounds of the passage's
pairs are summed for many passages at once; what could reach `least` goes through block-max WAND.

What is retrieved is verified: question and answer (an item's last sentence; none in an item of one sentence) must each have
`overlap` of their five-word shingles in the passage, or all words in a row if they have fewer than five.

Words are runs of ASCII letters, digits and any non-ASCII characters, A-Z in lower case. Null or empty text has none and
nothing is found; items without words are left out. Items of null id can't be named in a result and are left out of it, but
the pipeline's stage searches for them like for others. Items are indexed in shards of SHARD items, so a broadcast is
bounded, one shard after the other, by statistics of all items, so shares don't depend on shards;
items longer than LONGEST words are cut into parts, which are retrieved like items. Where one is, question and answer of the
whole item are verified in its passage and as many words before and after it as the item has before and after the part: the
same rule as for a short item, which is its only part. The score is that of the best part. Repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .common import NULL_ID, id_back, unused, written

LEAST, OVERLAP, SHINGLE = 0.6, 0.8, 5
BLOCK, SHARD, LONGEST = 16, 20_000, 256
K1, B = 1.2, 0.75


def words(text: str) -> tuple[list[bytes], np.ndarray]:
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    start, end = scan.spans(data, np.zeros(1, dtype=np.int64), scan.MARKS)
    raw = data.tobytes().lower()
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)], scan.word_hashes(data, start, end, scan.LOWER_BYTES)


def grams(hashes: np.ndarray) -> np.ndarray:
    """The hash of each word and the next one."""
    return scan.gram_hashes(hashes, 2)


def single(hashes: np.ndarray) -> np.ndarray:
    """Words as terms of their own, apart from pairs."""
    return scan.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))


def parts(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer, if there is one before it."""
    found = re.fullmatch(r"(.*[.!?:])\s+(\S.*?)\s*", text, re.S)
    return (found[1], found[2]) if found else (text, "")


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words; one of at most LONGEST words is its only part."""
    if n <= LONGEST:
        return [(0, n)] if n else []
    return [(lo, min(n, lo + LONGEST)) for lo in range(0, n - LONGEST // 2, LONGEST // 2)]


def terms_of(hashes: np.ndarray) -> np.ndarray:
    """The terms of a part: its pairs, or its only word."""
    return grams(hashes) if len(hashes) > 1 else single(hashes)


@dataclass
class Stats:
    """Statistics of all items: parts, their mean length in terms, the most words of one, and in how many parts each term is."""

    n: int
    mean: float
    longest: int
    df: dict[int, int]


def _count(batches):
    """(shard, term, parts with it, parts, terms, most words): a row for each term, and one of null term for the shard's parts."""
    for b in batches:
        df: Counter = Counter()
        total: dict[int, list[int]] = {}
        for k, text in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True):
            hashes = words(text)[1]
            for lo, hi in cuts(len(hashes)):
                terms = terms_of(hashes[lo:hi])
                df.update((k, t) for t in np.unique(terms).view(np.int64).tolist())
                got = total.setdefault(k, [0, 0, 0])
                got[0] += 1
                got[1] += len(terms)
                got[2] = max(got[2], hi - lo)
        rows = [(k, t, c, 0, 0, 0) for (k, t), c in df.items()] + [(k, None, 0, *v) for k, v in total.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["shard", "term", "df", "n", "length", "longest"])


class Index:
    """Postings of up to SHARD items, by statistics of these or of all items."""

    def __init__(self, items: list[tuple[int, str]], stats: Stats | None = None):
        self.items, lists = [], []
        #: By part of a long item: the item's number, question and answer, and its words before and after the part.
        self.whole: dict[int, tuple[int, list[bytes], list[bytes], int, int]] = {}
        longs = 0
        for item, text in items:
            tokens, hashes = words(text)
            if len(tokens) > LONGEST:
                q, a = parts(text)
                whole = (longs, words(q)[0], words(a)[0])
                longs += 1
                for lo, hi in cuts(len(tokens)):
                    self.whole[len(self.items)] = (*whole, lo, len(tokens) - hi)
                    self.items.append((item, tokens[lo:hi], []))
                    lists.append(terms_of(hashes[lo:hi]))
            elif tokens:
                q, a = parts(text)
                self.items.append((item, words(q)[0], words(a)[0]))
                lists.append(terms_of(hashes))
        self.length = stats.longest if stats else max((len(q) + len(a) for _, q, a in self.items), default=1)
        self.singles = any(len(q) + len(a) == 1 for _, q, a in self.items)
        if stats:
            n, mean, df = stats.n, stats.mean, stats.df
        else:
            n, mean = len(lists), float(np.mean([len(x) for x in lists])) if lists else 1.0
            df = Counter(h for x in lists for h in set(x.tolist()))
        self.terms = {h: k for k, h in enumerate(sorted(df))}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        for i, x in enumerate(lists):
            tf = Counter(x.tolist())
            w = {h: math.log(1 + (n - df[h] + 0.5) / (df[h] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(x) / mean)) for h, c in tf.items()}
            own = sum(w.values())
            for h, v in w.items():
                at, share = self.postings[self.terms[h]]
                at.append(i)
                share.append(v / own)
        self.blocks = []  # a term's block ends (last item) and largest shares
        for at, share in self.postings:
            cutat = range(0, len(at), BLOCK)
            self.blocks.append(([at[min(k + BLOCK, len(at)) - 1] for k in cutat], [max(share[k : k + BLOCK]) for k in cutat]))
        self.bound = np.array([max(s) for _, s in self.postings] or [0.0])
        self.size = 1 << 18
        while self.size < 64 * len(self.terms):
            self.size *= 2
        self.hashes = np.array(sorted(df) or [0], dtype=np.uint64)
        # Pairs in many items count little: those whose bounds sum up to a sixth of `least` are only looked at later.
        order = np.argsort(self.bound)
        rare = np.ones(len(self.bound), dtype=bool)
        rare[order[np.cumsum(self.bound[order]) <= LEAST / 6]] = False
        self.rare = np.append(np.where(rare, self.bound, 0.0), 0.0)
        self.common = float(self.bound[~rare].sum())
        self._slots()

    def _slots(self) -> None:
        """An open table from hash to term; a slot that several hashes share is resolved by search."""
        slot = (self.hashes & np.uint64(self.size - 1)).astype(np.int64)
        self.table = np.full(self.size, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(slot), dtype=np.int32)
        shared = np.flatnonzero(np.bincount(slot, minlength=self.size)[slot] > 1)
        self.table[slot[shared]] = -2

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each hash, or the number of terms."""
        got = self.table[(hashes & np.uint64(self.size - 1)).astype(np.int64)]
        out = np.full(len(hashes), len(self.bound), dtype=np.int64)
        at = np.flatnonzero(got >= 0)
        at = at[self.hashes[got[at]] == hashes[at]]
        out[at] = got[at]
        at = np.flatnonzero(got == -2)
        k = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == hashes[at]
        out[at[hit]] = k[hit]
        return out

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items with a score of `least` or more, by block-max WAND."""
        lists = [[self.postings[t][0], self.postings[t][1], 0, float(self.bound[t]), self.blocks[t]] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            total, pivot = 0.0, -1
            for k, x in enumerate(lists):
                total += x[3]
                if total >= least - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]] == item:
                pivot += 1
            bound, nearest = 0.0, 1 << 60
            for x in lists[: pivot + 1]:
                ends, most = x[4]
                k = bisect_left(ends, item)
                if k < len(ends):
                    bound += most[k]
                    nearest = min(nearest, ends[k] + 1)
            if bound < least - 1e-9:  # no item up to the nearest block end can reach it
                to = nearest
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][2]])
                to = max(to, item + 1)
            elif lists[0][0][lists[0][2]] == item:
                score = sum(x[1][x[2]] for x in lists[: pivot + 1])
                if score >= least - 1e-9:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for x in lists[: pivot + 1]:
                x[2] = bisect_left(x[0], to, x[2])
            lists = [x for x in lists if x[2] < len(x[0])]
        return out

    def verify(self, item: int, passage: list[bytes], overlap: float) -> tuple[float, float] | None:
        """The shares of question and answer shingles that the passage holds, if both are enough."""
        return _overlaps(*self.items[item][1:], passage, overlap)


def _overlaps(question: list[bytes], answer: list[bytes], passage: list[bytes], overlap: float) -> tuple[float, float] | None:
    got = []
    for part in (question, answer):
        if not part:
            got.append(1.0)
            continue
        k = min(SHINGLE, len(part))
        want = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        first = {w[0] for w in want}
        have = {tuple(passage[i : i + k]) for i, w in enumerate(passage) if w in first} & want
        got.append(len(have) / len(want))
    return (got[0], got[1]) if min(got) >= overlap else None


def _passages(doc: np.ndarray, stride: int, length: int):
    """(start, end) of passages over words of consecutive documents; each covers `length` words, every `stride`."""
    at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(at[1:], len(doc))
    # A document's last passage is the one that reaches its end.
    number = np.maximum(1, -(-(ends - at - length) // stride) + 1)
    of = np.repeat(np.arange(len(at)), number)
    k = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    start = at[of] + k * stride
    return start, np.minimum(start + length, ends[of])


def _scan(shared, least: float, overlap: float):
    def run(batches):
        index = shared.value
        stride, length = max(32, index.length), 2 * max(32, index.length)
        none = len(index.bound)
        for b in batches:
            ids = b.column("d").to_numpy()
            rows = []
            for lo, _, data, offsets in scan.texts(b):
                start, end = scan.spans(data, offsets, scan.MARKS)
                if not len(start):
                    continue
                doc = np.searchsorted(offsets, start, "right") - 1
                hashes = scan.word_hashes(data, start, end, scan.LOWER_BYTES)
                term = np.append(index.find(grams(hashes)), none)  # the pair that starts at each word
                alone = index.find(single(hashes)) if index.singles else None
                first, last = _passages(doc, stride, length)
                total = np.append(0.0, np.cumsum(index.rare[term]))
                bound = total[last - 1] - total[first] + index.common
                if alone is not None:
                    total = np.append(0.0, np.cumsum(index.rare[alone]))
                    bound += total[last] - total[first]
                edges = np.searchsorted(doc, np.arange(len(offsets)))
                # By document, long item and where the item would start, within a stride: first and last word of the part's
                # passage with the rest of the item around it, and the best part. A copy's parts agree on where it starts.
                parted: dict = {}
                could = np.flatnonzero(bound >= least - 1e-6)
                for p in could.tolist():
                    s, e = int(first[p]), int(last[p])
                    terms = np.unique(term[s : e - 1] if alone is None else np.concatenate([term[s : e - 1], alone[s:e]]))
                    terms = terms[terms != none]
                    if index.bound[terms].sum() < least - 1e-9:
                        continue
                    hits = index.search(terms.tolist(), least)
                    if not hits:
                        continue
                    raw = data[start[s] : end[e - 1]].tobytes().lower()
                    passage = [raw[x - start[s] : y - start[s]] for x, y in zip(start[s:e].tolist(), end[s:e].tolist(), strict=True)]
                    for item, score in hits:
                        if item in index.whole:
                            number, _, _, before, after = index.whole[item]
                            key = int(doc[s]), number, (s - before) // stride
                            lo_, hi_, part = parted.get(key, (s, e, (0.0, 0)))
                            parted[key] = min(lo_, s - before), max(hi_, e + after), max(part, (score, item))
                        elif got := index.verify(item, passage, overlap):
                            rows.append((int(ids[lo + doc[s]]), lo + int(doc[s]), index.items[item][0], score, *got))
                for (d, _, _), (s, e, (score, item)) in sorted(parted.items()):
                    s, e = max(s, int(edges[d])), min(e, int(edges[d + 1]))
                    raw = data[start[s] : end[e - 1]].tobytes().lower()
                    text = [raw[x - start[s] : y - start[s]] for x, y in zip(start[s:e].tolist(), end[s:e].tolist(), strict=True)]
                    if got := _overlaps(*index.whole[item][1:3], text, overlap):
                        rows.append((int(ids[lo + d]), lo + d, index.items[item][0], score, *got))
            best: dict = {}
            for d, row, item, score, q, a in rows:
                if (row, item) not in best or best[row, item][2:] < (score, q, a):
                    best[row, item] = (d, item, score, q, a)
            cols = list(zip(*best.values(), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["d", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, overlap: float = OVERLAP, unnamed: bool = False) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): each document and each item that lies in it, with the
    passage that scores best. unnamed: items of null id are searched too, and reported with a null item_id."""
    spark = docs.sparkSession
    good = items.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col("text").cast("string").alias("text"))
    if not unnamed:
        good = good.filter(F.col("item_id") != NULL_ID)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shards = max(1, -(-good.count() // SHARD))
    out = counts = None
    if shards > 1:
        good = good.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
        counts = good.select("shard", "text").mapInArrow(_count, "shard int, term long, df long, n long, length long, longest long")
        counts = written(counts.groupBy("shard", "term").agg(*[F.sum(c).alias(c) for c in ("df", "n", "length")], F.max("longest").alias("longest")), "decontaminate-terms")
        every = counts.filter(F.col("term").isNull()).agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.max("longest").alias("longest")).first()
        df = counts.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("all"))
    for k in range(shards):  # the items are few; each shard is a pass of its own
        part, stats = good, None
        if counts is not None:
            part = good.filter(F.col("shard") == k)
            own = counts.filter(F.col("shard") == k).select("term").join(df, "term").select("term", "all").toArrow()
            keys = own.column("term").to_numpy().view(np.uint64).tolist()
            n, length, longest = every if every["n"] else (0, 1, 1)
            stats = Stats(n, length / max(1, n), longest, dict(zip(keys, own.column("all").to_pylist(), strict=True)))
        index = Index(sorted((r["item_id"], r["text"]) for r in part.select("item_id", "text").collect()), stats)
        shared = spark.sparkContext.broadcast(index)
        found = rows.mapInArrow(_scan(shared, least, overlap), "d long, item_id long, score double, question_overlap double, answer_overlap double")
        if shards > 1:  # one shard's index lives at a time
            found = written(found, "decontaminate-found")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out.select(id_back().alias("doc_id"), id_back("item_id").alias("item_id"), "score", "question_overlap", "answer_overlap")


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no item lies."""
    d = unused(docs, "_d")
    found = contaminated(docs, items, unnamed=True).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(d)).distinct()
    return docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).join(found, d, "left_anti").select(*docs.columns)
