"""Embedding near-dedup with spherical-cap filters.

There are two books of random unit directions over all dimensions; a filter is one direction of each (a product code), so
few directions give very many filters. The directions have no preferred axes, so a pair's chance to share a filter depends on
its angle only, however uneven the vectors are. Each vector is list-decoded to its FILTERS filters of highest score, whatever
the score, so none is left without. The books get as large as n allows while random pairs at the least cosine still share a
filter in GOAL of the cases, which is measured for each dimension and n; at worst all vectors share one filter. Vectors that
share a filter are compared exactly, in double precision, and a pair counts at its smallest shared filter only.

Vectors often have a common direction, which would send most of them to the same filters. So for decoding only, the mean may
be subtracted: it is fitted on a sample of about SAMPLE vectors of each dimension. On pairs made from this sample (a vector turned
to the least cosine, towards another one or anywhere) the books are fitted once more, with and without the mean, and the
way with fewest expected pair checks is taken; where filters would cost more than all pairs once, all vectors share one filter.

Equal vectors are collapsed first, by an aggregation; links are found between classes, with multiplicity. A filter of more
than MOST_GROUP vectors is cut into tiles that meet pairwise. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't either. A null id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, changes, groups, id_back, met, removed, tiled, written
from .components import connected_components, local_labels

LEAST, BLOCKS, FILTERS, BUCKET, SEED = 0.9, 2, 40, 150, 5
MOST_GROUP = 1500
#: The share of pairs at the least cosine that have to share a filter, and the pairs it is measured on.
GOAL, PAIRS = 0.97, 1000
#: Expected number of vectors of each dimension that the mean and the costs are fitted on.
SAMPLE = 2048


def codebook(dim: int, words: int) -> list[np.ndarray]:
    """Unit directions of each book."""
    out = []
    for k in range(BLOCKS):
        part = np.random.default_rng([SEED, dim, k]).standard_normal((words, dim))
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        out.append(part / np.where(norm > 0, norm, 1))
    return out


def decode(x: np.ndarray, book: list[np.ndarray], filters: int = FILTERS) -> np.ndarray:
    """The filters of highest score of each row, in order.

    The best sums are among the ranks (i, j) of the two books with (i + 1)(j + 1) <= filters: the others have that many above.
    """
    words = len(book[0])
    most = min(filters, words)
    ranked = []
    for directions in book:
        score = x @ directions.T
        top = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < words else np.tile(np.arange(words), (len(x), 1))
        order = np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
        ranked.append((top, np.take_along_axis(score, top, 1)))
    i, j = np.array([(i, j) for i in range(most) for j in range(min(most, filters // (i + 1)))]).T
    (first, a), (second, b) = ranked
    best = np.argsort(-(a[:, i] + b[:, j]), axis=1, kind="stable")[:, :filters]
    return np.sort(np.take_along_axis(first[:, i] * words + second[:, j], best, 1), axis=1)


def turned(x: np.ndarray, to: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors at cosine `least` to the unit vectors x, towards the rows of `to`."""
    to = to - (x * to).sum(axis=1, keepdims=True) * x
    norm = np.linalg.norm(to, axis=1, keepdims=True)
    return least * x + math.sqrt(max(0.0, 1 - least * least)) * to / np.where(norm > 0, norm, 1)


def sharing(x: np.ndarray, y: np.ndarray, book: list[np.ndarray]) -> float:
    """The share of pairs (x[i], y[i]) that share a filter."""
    shared = 0
    for lo in range(0, len(x), 200):
        both = np.sort(np.concatenate([decode(x[lo : lo + 200], book), decode(y[lo : lo + 200], book)], axis=1), axis=1)
        shared += int((both[:, 1:] == both[:, :-1]).any(axis=1).sum())
    return shared / len(x)


def recall(dim: int, words: int, least: float) -> float:
    """The share of random pairs at cosine `least` that share a filter."""
    if dim == 1:
        return 1.0
    x, y = np.random.default_rng([SEED, dim, BLOCKS]).standard_normal((2, PAIRS, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return sharing(x, turned(x, y, least), codebook(dim, words))


def load(x: np.ndarray, book: list[np.ndarray]) -> float:
    """Pair checks that filters of vectors like x cost, as a multiple of all pairs."""
    held = np.unique(np.concatenate([decode(x[lo : lo + 500], book).ravel() for lo in range(0, len(x), 500)]), return_counts=True)[1]
    return float((held * (held - 1.0)).sum() / (len(x) * (len(x) - 1.0)))


def plan(n: int, dim: int, least: float = LEAST) -> int:
    """Directions a book: BUCKET vectors a filter if vectors are spread evenly, more where GOAL needs fewer filters.

    So few vectors that one filter may hold them all share one.
    """
    if n <= BUCKET:
        return 1
    words = min(46_000, max(16, math.ceil((n * FILTERS / BUCKET) ** (1 / BLOCKS))))  # codes fit 32 bits
    while words > 1 and recall(dim, words, least) < GOAL:
        words = words * 4 // 5
    return words


def fitted(n: int, dim: int, sample: np.ndarray, least: float = LEAST) -> tuple[int, np.ndarray]:
    """Directions a book, and what is subtracted before decoding, for n vectors like the unit vectors of the sample."""
    none, most = np.zeros(dim), plan(n, dim, least)
    if most == 1 or dim == 1 or len(sample) < 2:
        return most, none
    r = np.random.default_rng([SEED, dim, BLOCKS, 1])
    x = sample[r.permutation(len(sample))]
    first = x[:PAIRS]
    ends = [turned(first, to, least) for to in (np.roll(x, 1, axis=0)[:PAIRS], r.standard_normal(first.shape))]
    best = (1.0, 1, none)
    for shift in (none, sample.mean(axis=0)):
        words = most
        while words > 1:
            book = codebook(dim, words)
            cost = load(x - shift, book)
            if cost >= best[0]:
                break  # smaller books only cost more
            if min(sharing(first - shift, end - shift, book) for end in ends) >= GOAL:
                best = (cost, words, shift)
                break
            words = words * 4 // 5
    return best[1], best[2]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sampled(distinct: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """About SAMPLE unit vectors of each dimension, chosen by a hash of the vector; none where one filter holds all."""
    share = {dim: min(1.0, SAMPLE / n) for dim, n in sizes.items() if n > BUCKET}
    if not share:
        return {}
    shares = distinct.sparkSession.createDataFrame(list(share.items()), "dim int, share double")
    drawn = distinct.select("v", F.size("v").alias("dim"), F.xxhash64("v", F.lit(31)).alias("h")).join(F.broadcast(shares), "dim")
    got = drawn.filter(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 < F.col("share")).select("dim", "h", "v").toArrow().sort_by([("dim", "ascending"), ("h", "ascending")])
    dims = got.column("dim").to_numpy()
    at = {dim: np.flatnonzero(dims == dim) for dim in share}
    return {dim: unit(_matrix(got.slice(int(k[0]), len(k)), "v").astype(np.float64)) for dim, k in at.items() if len(k)}


def valid(col: str):
    """Not null, no null or non-finite component, not zero."""
    v = F.col(col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def _filters(plans: dict[int, tuple[int, np.ndarray]]):
    def run(batches):
        books: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                vectors = part.column("v").to_pylist()
                lengths = np.array([len(v) for v in vectors])
                for dim in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == dim)
                    if dim not in books:
                        books[dim] = codebook(dim, plans[dim][0])
                    x = unit(np.array([vectors[i] for i in at], dtype=np.float64))
                    lists = list(decode(x - plans[dim][1], books[dim]))
                    take = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([take.column("rep"), take.column("n"), take.column("v"), pa.array(np.full(len(at), dim), pa.int32()), pa.array(lists, pa.list_(pa.int32()))], names=["rep", "n", "v", "dim", "codes"])

    return run


def smallest_shared(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray, code: int) -> np.ndarray:
    """Whether `code` is the smallest filter that rows a[i] and b[i] share."""
    small = [c[c < code] for c in codes]
    n, of, filters = len(codes), np.repeat(np.arange(len(codes)), [len(c) for c in small]), np.concatenate(small)
    _, column, count = np.unique(filters, return_inverse=True, return_counts=True)
    twice = count[column] > 1  # a filter of one row here is shared with none
    of, column = of[twice], np.unique(column[twice], return_inverse=True)[1]
    if not len(of):
        return np.ones(len(a), dtype=bool)
    if len(a) > 2 * n:  # many pairs: which rows share a filter is a product of incidence matrices
        shared = np.zeros((n, n), dtype=bool)
        for lo in range(0, int(column.max()) + 1, 1024):
            part = (column >= lo) & (column < lo + 1024)
            has = np.zeros((n, 1024), dtype=np.float32)
            has[of[part], column[part] - lo] = 1
            shared |= has @ has.T > 0.5
        return ~shared[a, b]
    held: list[set] = [set() for _ in codes]
    for i, c in zip(of.tolist(), column.tolist(), strict=True):
        held[i].add(c)
    return np.array([held[i].isdisjoint(held[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    """A column of lists of one length, without nulls."""
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _verify(least: float):
    keys = ["dim", "code", "ta", "tb"]

    def run(batches):
        for t in groups(batches, keys, 4_000):
            start = changes(t, keys)
            ends = np.append(start[1:], t.num_rows)
            reps, n, tile = (t.column(c).to_numpy() for c in ("rep", "n", "tile"))
            code, ta, tb = (t.column(c).to_numpy() for c in ("code", "ta", "tb"))
            count = np.zeros(t.num_rows, dtype=np.int64)
            label = np.arange(t.num_rows)
            for lo, hi in zip(start.tolist(), ends.tolist(), strict=True):
                if hi - lo < 2:
                    continue
                part = t.slice(lo, hi - lo)
                x = unit(_matrix(part, "v").astype(np.float64))
                found = []
                for k in range(0, len(x), 512):
                    i, j = np.nonzero(x[k : k + 512] @ x.T >= least)
                    i += k
                    keep = (i < j) if ta[lo] == tb[lo] else (tile[lo + i] < tile[lo + j])
                    found.append((i[keep], j[keep]))
                i, j = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(i):
                    continue
                label = local_labels(len(label), label, i + lo, j + lo)
                rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
                lists = list(_matrix(part, "codes")[rows])
                mine = smallest_shared(lists, back[: len(i)], back[len(i) :], int(code[lo]))
                np.add.at(count, lo + i[mine], n[lo + j[mine]])
                np.add.at(count, lo + j[mine], n[lo + i[mine]])
            low = np.full(t.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(low, label, reps)
            root = low[label]
            say = (count > 0) | (root != reps)
            if say.any():
                yield pa.RecordBatch.from_arrays([pa.array(reps[say]), pa.array(root[say]), pa.array(count[say])], names=["rep", "root", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("d"), F.when(valid("embedding"), F.col("embedding")).alias("v"))
    good = rows.filter(F.col("v").isNotNull())
    distinct = written(good.groupBy("v").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("n")), "caps-distinct")
    counts = distinct.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).collect()
    sizes, total = {r["dim"]: r["n"] for r in counts}, sum(r["rows"] for r in counts)
    samples = sampled(distinct, sizes)
    plans = {dim: fitted(n, dim, samples.get(dim, np.zeros((0, dim))), least) for dim, n in sizes.items()}
    item = vectors.schema["embedding"].dataType.elementType.simpleString()
    coded = distinct.select("rep", "n", "v").mapInArrow(_filters(plans), f"rep long, n long, v array<{item}>, dim int, codes array<int>")
    coded = written(coded, "caps-coded")
    spread = coded.select("*", F.explode("codes").alias("code"))
    keys = ["dim", "code", "ta", "tb"]
    spread = tiled(spread, ["dim", "code"], "rep", MOST_GROUP)
    found = spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(least), "rep long, root long, links long")
    found = written(found, "caps-links")
    removed(vectors.sparkSession, coded)
    joined = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = distinct.join(linked, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    classes = written(classes.select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "caps-classes")
    for done in (distinct, found):
        removed(vectors.sparkSession, done)
    out = met(rows.filter(F.col("v").isNotNull()), classes, ["v"], "n", total).select("d", "n_links", "component")
    out = out.unionByName(rows.filter(F.col("v").isNull()).select("d", F.lit(0).alias("n_links"), F.col("d").alias("component")))
    return out.select(id_back().alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), id_back("component").alias("component_id"), (F.col("d") == F.col("component")).alias("kept"))
