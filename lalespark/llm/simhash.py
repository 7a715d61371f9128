"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most `most` bits link. Equal fingerprints are collapsed to one row first, by an aggregation.
Keys of a few bits deal the distinct fingerprints out: two that link agree in a whole key (always for 64 bits, by the
pigeonhole principle; for wide fingerprints with a probability that keys() documents). Keys get longer with the number of
fingerprints, so that a key's value holds about PER_KEY of them at any size. All fingerprints of a value, few or many, are
sorted by Gray rank and indexed by hamming.py, and each is searched for there; a group gives a spanning forest of the
links found, never all pairs, and components join the forests.

Null text is empty, without words, and has fingerprint zero, which links like any other. A null id sorts first. Repeated
rows share a fingerprint and so a component. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, changes, groups, id_back, removed, tiled, trimmed, unused, written
from .components import connected_components, local_labels
from .hamming import GrayIndex, distance, gray_order

SEED = 42
#: Rows of a key's value that one task takes at once; larger groups are cut into tiles that meet pairwise.
MOST_GROUP = 4096
#: Fingerprints that share a key's value, about, for narrow and wide ones.
PER_KEY, PER_WIDE_KEY = 128, 12
#: Children of a node: wide fingerprints differ in so many bits that upper nodes prune little.
FAN, WIDE_FAN = 4, 16
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z in lower case; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(b" ".join(words), SEED)], dtype=np.uint64)
    return np.array([h(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))], dtype=np.uint64)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, bit 0 first. Byte lanes add up to 255 hashes at a time."""
    at = np.arange(0, len(hashes), 255)
    out = np.zeros((8, 8), dtype=np.int64)  # byte, bit
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, at)
        out[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.ravel()


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    return int(np.bitwise_or.reduce(_BITS[ones(hashes) * 2 > len(hashes)], initial=np.uint64(0)))


WIDE = 8
_PAIRS = np.triu_indices(64, 1)
_CHOSEN = np.random.default_rng(9).permutation(len(_PAIRS[0]))[: 64 * WIDE]
_PA, _PB = _PAIRS[0][_CHOSEN], _PAIRS[1][_CHOSEN]


def wide_fingerprint(text: str | None, width: int = 5) -> np.ndarray:
    """512 bits over the set of shingles. Their hash bits are exclusive ors of two bits of XXH64, which are pairwise
    independent, so one product of the sign matrix with itself gives all votes."""
    hashes = np.unique(shingle_hashes(text, width))
    if not len(hashes):
        return np.zeros(WIDE, dtype=np.uint64)
    votes = np.zeros((64, 64), dtype=np.float64)
    for i in range(0, len(hashes), 8192):
        signs = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        signs *= 2
        signs -= 1
        votes += signs.T @ signs
    return np.packbits(votes[_PA, _PB] < 0, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, width: int, wide: bool) -> DataFrame:
    """(d, f0, ... ): the id and the words of the fingerprint of every row."""
    n = WIDE if wide else 1
    schema = "d long, " + ", ".join(f"f{k} long" for k in range(n))

    def run(batches):
        for b in batches:
            if wide:
                codes = [wide_fingerprint(t.as_py(), width) for t in b.column("text")]
            else:
                codes = [[fingerprint(t.as_py(), width)] for t in b.column("text")]
            codes = np.array(codes, dtype=np.uint64).reshape(-1, n).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("d"), *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(n))], names=["d", *(f"f{k}" for k in range(n))])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), schema)


#: The share of pairs of similarity 0.8 whose wide fingerprints agree in a key, and the probability that a bit agrees.
GOAL, AGREES = 0.977, 0.848


def keys(n: int, wide: bool, most: int) -> np.ndarray:
    """The bits (keys x bits) of each key for n distinct fingerprints.

    64 bits are cut into most + 1 parts or more; at most `most` of them hold a differing bit, so two fingerprints that link
    agree in one of the sets of the other parts. A key has the first bits of such a set, as many as n asks for. 512 bits:
    random bits, of which two of similarity 0.8 agree in a key with probability AGREES ** bits, and in one of the keys with
    GOAL; at 0.85 with 0.996 or more.
    """
    bits = max(2, round(math.log2(max(1, n) / (PER_WIDE_KEY if wide else PER_KEY))))
    if wide:
        many = math.ceil(math.log(1 - GOAL) / math.log1p(-(AGREES**bits)))
        return np.stack([np.random.default_rng([9, bits, k]).permutation(64 * WIDE)[:bits] for k in range(many)])
    for alike in range(1, 64):  # parts that make a key
        size = 64 // (most + alike)
        if alike * size >= bits or (alike + 1) * (64 // (most + alike + 1)) <= alike * size:
            break
    bits = min(bits, alike * size)
    # Bits of the parts in turn, so that a short key has some of each.
    return np.array([[part * size + k for k in range(size) for part in chosen][:bits] for chosen in combinations(range(most + alike), alike)])


def key_values(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The value (codes x keys) of each key."""
    out = np.zeros((len(codes), len(own)), dtype=np.int64)
    for k in range(own.shape[1]):
        word, bit = np.divmod(own[:, k], 64)
        out = out << 1 | (codes[:, word] >> bit.astype(np.uint64) & np.uint64(1)).astype(np.int64)
    return out


def forest(codes: np.ndarray, group: np.ndarray, reps: np.ndarray, tile: np.ndarray, cross: np.ndarray, most: int):
    """Edges (rep, smallest rep of its class) within groups. group: start rows. cross: groups that hold two tiles.

    A group of no more rows than a node has children is a single node, and all such groups are compared at once."""
    n, fan = len(codes), FAN if codes.shape[1] == 1 else WIDE_FAN
    label = np.arange(n)
    ends = np.append(group[1:], n)
    sizes = ends - group
    single = sizes <= fan
    of = np.repeat(np.arange(len(group)), sizes)
    rows = np.flatnonzero(single[of])
    a, b = [], []
    for gap in range(1, int(sizes[single].max(initial=1))):
        rows = rows[rows + gap < ends[of[rows]]]
        near = rows[distance(codes[rows] ^ codes[rows + gap]) <= most]
        a.append(near)
        b.append(near + gap)
    if a:
        label = local_labels(n, label, np.concatenate(a), np.concatenate(b))
    for g in np.flatnonzero(~single):
        order = gray_order(codes[group[g] : ends[g]]) + group[g]
        for q, c in GrayIndex(codes[order], fan).search(codes[order], most):
            q, c = order[q], order[c]
            keep = (tile[q] < tile[c]) if cross[g] else (q < c)
            label = local_labels(n, label, q[keep], c[keep])
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, label, reps)
    root = low[label]
    linked = root != reps
    return reps[linked], root[linked]


def links(distinct: DataFrame, wide: bool, most: int) -> DataFrame:
    """Edges (a, b) between representatives of distinct fingerprints: in each group a spanning forest of its links."""
    names = [c for c in distinct.columns if c.startswith("f")]
    own = keys(distinct.count(), wide, most)

    def spread(batches):
        for b in batches:
            if b.num_rows:
                codes = np.stack([b.column(c).to_numpy() for c in names], axis=1)
                values = pa.array(key_values(codes.view(np.uint64), own).ravel())
                ends = pa.array(np.arange(0, len(values) + 1, len(own), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, values)], names=["rep", *names, "values"])

    schema = "rep long, " + ", ".join(f"{c} long" for c in names)
    valued = written(distinct.select("rep", *names).mapInArrow(spread, f"{schema}, values array<long>"), "simhash-keys")  # read twice
    rows = tiled(valued.select("rep", *names, F.posexplode("values").alias("key", "value")), ["key", "value"], "rep", MOST_GROUP)
    by = ["key", "value", "ta", "tb"]

    def run(batches):
        for t in groups(batches, by):
            codes = np.stack([t.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            start = changes(t, by)
            ta, tb = t.column("ta").to_numpy()[start], t.column("tb").to_numpy()[start]
            a, b = forest(codes, start, t.column("rep").to_numpy(), t.column("tile").to_numpy(), ta != tb, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(trimmed(run), "a long, b long")


def classes(docs: DataFrame, width: int = 3, most: int = 3, wide: bool = False) -> DataFrame:
    """(d, f0, ..., component): the smallest id that can be reached over links, for every row."""
    prints = written(fingerprints(docs, width, wide), "simhash")
    names = [c for c in prints.columns if c.startswith("f")]
    distinct = written(prints.groupBy(*names).agg(F.min("d").alias("rep")), "simhash-distinct")
    found = links(distinct, wide, most)
    joined = connected_components(found)
    removed(docs.sparkSession, found)  # the keys: edges are in tables of their own by now
    reps = distinct.join(joined, distinct["rep"] == joined["node"], "left").select(*names, F.coalesce("component", "rep").alias("component"))
    return prints.join(reps, names).select("d", *names, "component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): 3-word shingles, 64 bits, links at 3 or fewer differing bits."""
    out = classes(docs)
    return out.select(id_back().alias("doc_id"), F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), id_back("component").alias("component_id"))


#: Differing bits of 512. At a Jaccard similarity of 0.8 the cosine is 2 * 0.8 / 1.8, the angle over pi 0.1514, so 77.5 bits
#: differ on average, with a deviation of 8. This much more finds 0.8 with probability 0.8 and 0.82 with 0.95; of pairs at
#: 0.75 it links a third, at 0.7 one in fifteen.
WIDE_MOST = 85


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group stays, that with the smallest id; five-word shingles, similarity of about 0.8.

    64 bits tell a similarity of 0.8 (10 differing bits) badly from chance, so this takes 512 bits and WIDE_MOST differing
    ones. The sketch decides, so 0.8 is no sharp edge: of pairs of 0.8 nine in ten link, of 0.85 all, of 0.75 half, of 0.7
    one in fifteen (figures in the README). Of repeated rows with that id all but one go.
    """
    found = classes(docs, width=5, most=WIDE_MOST, wide=True)
    d = unused(docs, "_d")
    keep = found.filter(F.col("d") == F.col("component")).select(F.col("d").alias(d)).distinct()
    base = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    return base.join(keep, d, "left_semi").dropDuplicates([d]).select(*docs.columns)
