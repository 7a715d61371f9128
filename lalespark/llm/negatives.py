"""Hard negatives by dual-tree search for large inner products.

Targets (anchors with a range of scores) and candidates stand in trees. A node holds the ball around its vectors and the range
of its labels. The inner products of two nodes lie in an interval that their balls give; a pair of nodes whose interval lies
outside of all its targets' ranges, or below what all of them have found already, is pruned for the whole group of targets.
Pairs of leaves are scored exactly, in integers.

The top of the candidates' tree is fitted on the driver to at most SAMPLE rows and has at most LEAVES leaves, so it is small at
any size; it only deals rows out. Every row goes to a leaf; the leaf (in parts of PART rows by hash if it got more) is what one
task holds, as a tree of its own. Targets stream past it. They visit their own leaf first; what they find there prunes the
other leaves by their balls before any target is sent, and inside the tasks. Results of leaves are merged by rank.

Rows of equal vec_id, label and vector are one row. Of equal vectors with one label only the smallest ids can be returned, so
no more than these go on, and targets of equal vector and label are searched once. Rows with a null label, a null vector or a
null or non-finite component take no part. Rows of other lengths are not compared, an empty vector is. A null vec_id sorts
first and is no anchor. Scores have to fit a long. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, id_back, met, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the top of the tree is fitted on, leaves it has at most, rows a leaf is to hold, rows that a task holds at most.
SAMPLE, LEAVES, ROWS, PART = 8192, 1024, 1024, 65_536
#: Rows of a leaf of a task's tree.
SMALL = 64
_LEAST, _MOST = -(2**63), 2**63 - 1
_HITS = "t long, score long, d long, c long"
_UNEXACT = 2.0**53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles if these can't round, else in longs, else in Python's integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < _UNEXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2.0**63:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)  # raises if a score doesn't fit


class Tree:
    """Splits in the middle of the widest coordinate, labels first, until SMALL rows are left. Rows are put in order of leaves."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.order = np.arange(len(x))
        self.lo, self.hi, self.left, self.center, self.radius, self.norm, self.labels = [], [], [], [], [], [], []
        points, todo = x.astype(np.float64), [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            at = self.order[lo:hi]
            own, names = points[at], label[at]
            me = len(self.lo)
            if parent >= 0:
                self.left[parent].append(me)
            center = own.mean(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.left.append([])
            self.center.append(center)
            self.radius.append(float(np.sqrt(((own - center) ** 2).sum(axis=1)).max()))
            self.norm.append(float(np.sqrt((center**2).sum())))
            self.labels.append((int(names.min()), int(names.max())))
            wide = own.max(axis=0) - own.min(axis=0) if own.shape[1] else np.zeros(1)
            if hi - lo <= SMALL or (self.labels[-1][0] == self.labels[-1][1] and not wide.max() > 0):
                continue
            if self.labels[-1][0] < self.labels[-1][1]:
                rank = np.argsort(names, kind="stable")
                edges = np.flatnonzero(np.diff(names[rank])) + 1
                mid = int(edges[np.argmin(np.abs(edges - (hi - lo) // 2))])
            else:
                x1 = own[:, int(wide.argmax())]
                rank, mid = np.argsort(x1, kind="stable"), int((x1 <= (x1.min() + x1.max()) / 2).sum())
                mid = mid if mid < hi - lo else (hi - lo) // 2  # the middle may be rounded up
            self.order[lo:hi] = at[rank]
            todo += [(lo, lo + mid, me), (lo + mid, hi, me)]
        self.x, self.label = x[self.order], label[self.order]


def interval(center_a, norm_a, radius_a, center_b, norm_b, radius_b):
    """Bounds of the inner products of two balls, a little widened for rounding."""
    mid = center_a @ center_b
    far = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    far = far + 1e-9 * (np.abs(mid) + far) + 1e-6
    return mid - far, mid + far


class Search:
    """Targets of one batch against the tree of a leaf's candidates: the first k of each target, by score and then id."""

    def __init__(self, tree: Tree, ids: np.ndarray, classes: np.ndarray, same: bool, k: int):
        self.tree, self.ids, self.classes, self.same, self.k = tree, ids[tree.order], classes[tree.order], same, k

    def run(self, x, label, low, high, least):
        """(target, score, id, class) of what is found; least: the score below which a target needs nothing."""
        mine = Tree(x, label)
        low, high = low[mine.order], high[mine.order]
        need = np.maximum(low, least[mine.order])
        found = [np.zeros(0, np.int64)] * 4
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            if self._pruned(mine, a, b, need, high):
                continue
            # The wider node is split, so that targets meet what is near them before what is far.
            other = self.tree.left[b] and (not mine.left[a] or self.tree.radius[b] > mine.radius[a])
            sides = [(a, y) for y in self.tree.left[b]] if other else [(y, b) for y in mine.left[a]]
            if sides:  # the pair that promises most is taken last from the stack, so first
                todo += sorted(sides, key=lambda p: float(mine.center[p[0]] @ self.tree.center[p[1]]))
            else:
                found = self._leaves(mine, a, b, need, low, high, found)
        return mine.order[found[0]], *found[1:]

    def _pruned(self, mine, a, b, need, high) -> bool:
        (la, ha), (lb, hb), tree = mine.labels[a], self.tree.labels[b], self.tree
        if (ha < lb or hb < la) if self.same else (la == ha == lb == hb):
            return True
        least, most = interval(mine.center[a], mine.norm[a], mine.radius[a], tree.center[b], tree.norm[b], tree.radius[b])
        own = slice(mine.lo[a], mine.hi[a])
        return bool(((most < need[own]) | (least > high[own])).all())

    def _leaves(self, mine, a, b, need, low, high, found):
        own, other = slice(mine.lo[a], mine.hi[a]), slice(self.tree.lo[b], self.tree.hi[b])
        score = product(mine.x[own], self.tree.x[other])
        equal = mine.label[own][:, None] == self.tree.label[other][None, :]
        good = (equal if self.same else ~equal) & (score >= need[own][:, None]) & (score <= high[own][:, None])
        i, j = np.nonzero(good)
        if not len(i):
            return found
        new = (i + mine.lo[a], score[i, j], self.ids[other][j], self.classes[other][j])
        t, s, d, c = (np.concatenate(p) for p in zip(found, new, strict=True))
        order = np.lexsort((d, -s, t))
        t, s, d, c = t[order], s[order], d[order], c[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        rank = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
        full = rank == self.k - 1
        need[t[full]] = np.maximum(need[t[full]], s[full])
        keep = rank < self.k
        return t[keep], s[keep], d[keep], c[keep]


def _matrix(t, name: str) -> np.ndarray:
    col = t.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.int64)


class Top:
    """The top of the candidates' tree: splits of a sample; leaf numbers go up by dimension."""

    def __init__(self, samples: dict[int, np.ndarray], leaves: dict[int, int]):
        self.nodes: dict[int, list] = {}
        self.centers: dict[int, np.ndarray] = {}
        self.first, n = {}, 0
        for dim in sorted(samples):
            nodes, todo, ends = [], [(samples[dim].astype(np.float64), leaves[dim], -1, 0)], []
            while todo:
                own, want, parent, side = todo.pop()
                wide = own.max(axis=0) - own.min(axis=0) if dim and len(own) else np.zeros(1)
                if parent >= 0:
                    nodes[parent][2 + side] = len(nodes)
                if want <= 1 or len(own) < 2 or not wide.max() > 0:
                    nodes.append([-1, 0.0, len(ends), 0])
                    ends.append(own.mean(axis=0))
                    continue
                at = int(wide.argmax())
                cut = float(np.quantile(own[:, at], (want // 2) / want, method="higher"))
                right = own[:, at] >= cut
                if right.all():
                    cut = float(np.nextafter(own[:, at].min(), np.inf))
                    right = own[:, at] >= cut
                nodes.append([at, cut, 0, 0])
                me = len(nodes) - 1
                todo += [(own[~right], want // 2, me, 0), (own[right], want - want // 2, me, 1)]
            self.nodes[dim], self.centers[dim], self.first[dim] = nodes, np.array(ends).reshape(len(ends), dim), n
            n += len(ends)
        self.leaves = n

    def leaf(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distance from the leaf's centre."""
        at = np.zeros(len(x), dtype=np.int64)
        nodes = np.array(self.nodes[dim])
        while True:
            where = nodes[at]
            inner = where[:, 0] >= 0
            if not inner.any():
                break
            col = where[:, 0].astype(np.int64)
            right = x[np.arange(len(x)), np.maximum(col, 0)] >= where[:, 1] if dim else np.zeros(len(x), bool)
            at = np.where(inner, np.where(right, where[:, 3], where[:, 2]).astype(np.int64), at)
        end = nodes[at, 2].astype(np.int64)
        return end + self.first[dim], np.sqrt(((x - self.centers[dim][end]) ** 2).sum(axis=1))


def by_dim(batch: pa.RecordBatch):
    """(dimension, rows) of a batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def _dealt(top: Top):
    def run(batches):
        for b in batches:
            for dim, part in by_dim(b):
                leaf, far = top.leaf(dim, _matrix(part, "q"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32)), pa.array(far)], names=[*part.schema.names, "leaf", "far"])

    return run


def _routes(top: Top, radius: dict[int, float]):
    """Leaves that a target has to visit beside its own: those whose ball reaches its range and what it has found."""

    def run(batches):
        for b in batches:
            for dim, part in by_dim(b):
                x = _matrix(part, "q").astype(np.float64)
                at = np.arange(len(top.centers[dim])) + top.first[dim]
                reach = np.array([radius.get(i, -1.0) for i in at.tolist()])
                centers = top.centers[dim]
                least, most = interval(x, np.sqrt((x**2).sum(axis=1))[:, None], 0.0, centers.T, np.sqrt((centers**2).sum(axis=1))[None, :], reach[None, :])
                need = np.maximum(part.column("lo").to_numpy(), part.column("need").to_numpy())
                go = (reach >= 0)[None, :] & (most >= need[:, None]) & (least <= part.column("hi").to_numpy()[:, None])
                go &= at[None, :] != part.column("leaf").to_numpy()[:, None]
                i, j = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["leaf"]).take(pa.array(i)).columns, pa.array(at[j].astype(np.int32))], names=[*(c for c in part.schema.names if c != "leaf"), "leaf"])

    return run


def _visits(same: bool, k: int):
    """From rows sorted by leaf, part and kind: a leaf's candidates (kind 0) make a tree, past which its targets stream."""

    def run(batches):
        key, held, search = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("leaf", "part", "kind")]
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            start = np.flatnonzero(new)
            for lo, hi in zip(start.tolist(), np.append(start[1:], b.num_rows).tolist(), strict=True):
                part, (leaf, sub, kind) = b.slice(lo, hi - lo), (int(c[lo]) for c in cols)
                if (leaf, sub) != key:
                    key, held, search = (leaf, sub), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if search is None:
                    if not held:
                        continue
                    own = pa.Table.from_batches(held).combine_chunks()
                    search = Search(Tree(_matrix(own, "q"), own.column("label").to_numpy()), own.column("d").to_numpy(), own.column("c").to_numpy(), same, k)
                    held = []
                t, s, d, c = search.run(_matrix(part, "q"), *(part.column(n).to_numpy() for n in ("label", "lo", "hi", "need")))
                yield pa.RecordBatch.from_arrays([pa.array(part.column("d").to_numpy()[t]), pa.array(s), pa.array(d), pa.array(c)], names=["t", "score", "d", "c"])

    return run


def _visited(cands: DataFrame, targets: DataFrame, parts: DataFrame, same: bool, k: int) -> DataFrame:
    """What targets find in the leaves they are sent to."""
    names = ["leaf", "part", "kind", "d", "c", "label", "lo", "hi", "need", "q"]
    none = F.lit(0).cast("long")
    held = cands.select("leaf", "part", F.lit(0).alias("kind"), "d", "c", "label", none.alias("lo"), none.alias("hi"), none.alias("need"), "q")
    sent = targets.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = sent.select("leaf", "part", F.lit(1).alias("kind"), F.col("t").alias("d"), none.alias("c"), "label", "lo", "hi", "need", "q")
    rows = held.unionByName(sent).select(*names).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "kind", "label")
    return rows.mapInArrow(_visits(same, k), _HITS)


def _first(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("t").orderBy(F.col("score").desc(), "d", "c")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Forest:
    """Candidates dealt out to the leaves of the top tree."""

    def __init__(self, cands: DataFrame):
        sizes = {r["dim"]: r["n"] for r in cands.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        total = max(1, sum(sizes.values()))
        samples, leaves = {}, {}
        for dim, n in sizes.items():
            share = max(1, SAMPLE * n // total)
            got = cands.filter(F.col("dim") == dim).select("q", F.xxhash64("d", "c").alias("h"), "d").orderBy("h", "d").limit(share).select("q").toArrow()
            samples[dim] = _matrix(got, "q") if dim else np.zeros((got.num_rows, 0), np.int64)
            leaves[dim] = max(1, min(LEAVES * n // total, -(-n // ROWS)))
        self.top = Top(samples, leaves)
        self.schema = "d long, label long, c long, dim int, q array<long>"
        self.cands = written(cands.select("d", "label", "c", "dim", "q").mapInArrow(_dealt(self.top), f"{self.schema}, leaf int, far double"), "negatives-dealt")
        found = self.cands.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a leaf
        self.radius = {r["leaf"]: r["far"] * (1 + 1e-9) + 1e-6 for r in found}
        spark = cands.sparkSession
        self.parts = spark.createDataFrame([(r["leaf"], -(-r["n"] // PART)) for r in found], "leaf int, parts int")
        self.cands = self.cands.join(F.broadcast(self.parts), "leaf").withColumn("part", F.pmod(F.xxhash64("d", "c"), F.col("parts")).cast("int"))

    def search(self, targets: DataFrame, same: bool, k: int) -> DataFrame:
        """(t, rank, score, d, c): the first k candidates with score within [lo, hi] of targets (t, label, dim, q, lo, hi)."""
        schema = "t long, label long, dim int, q array<long>, lo long, hi long"
        targets = written(targets.select("t", "label", "dim", "q", "lo", "hi").mapInArrow(_dealt(self.top), f"{schema}, leaf int, far double").drop("far"), "negatives-targets")
        near = written(_visited(self.cands, targets.withColumn("need", F.col("lo")), self.parts, same, k), "negatives-near")
        kth = _first(near, k).filter(F.col("rank") == k).select("t", F.col("score").alias("need"))
        rest = targets.join(kth, "t", "left").withColumn("need", F.coalesce("need", "lo"))
        rest = rest.mapInArrow(_routes(self.top, self.radius), f"{schema}, need long, leaf int")
        return _first(near.unionByName(_visited(self.cands, rest, self.parts, same, k)), k)


def quantized(vectors: DataFrame) -> DataFrame:
    """(d, label, dim, q, c) of the rows that take part; c stands for label and vector."""
    v = F.col("embedding")
    good = F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.coalesce(vec_id, F.lit(NULL_ID)).alias("d"), label.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("q"))
    return rows.distinct().select("d", "label", F.size("q").alias("dim"), "q", F.xxhash64("label", "q").alias("c"))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (vec_id divisible by
    `every`) and each of its first rows of the same label, the first rows of other labels that score `low` to `high` percent."""
    most = max(positives + 1, negatives)
    rows = written(quantized(vectors), "negatives-rows")
    w = Window.partitionBy("label", "q").orderBy("d")
    cands = written(rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r"), "negatives-cands")
    if cands.isEmpty():
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.filter((F.col("d") != NULL_ID) & (F.col("d") % every == 0))
    classes = anchors.groupBy("label", "dim", "q").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.monotonically_increasing_id())
    classes = written(classes, "negatives-classes")
    forest = Forest(cands)
    near = forest.search(classes.withColumns({"lo": F.lit(_LEAST), "hi": F.lit(_MOST)}), True, positives + 1)
    near = written(near, "negatives-positives")
    # Scores that the class's anchors can need, each searched once; none is within the bounds of a negative one.
    whole = F.col("score").cast("decimal(25,0)")
    bounds = near.filter("score >= 0").select("t", "score").distinct().join(classes.select("t", "label", "dim", "q"), "t")
    bounds = bounds.withColumns({"lo": F.ceil(whole * low / 100).cast("long"), "hi": F.floor(whole * high / 100).cast("long")}).filter("lo <= hi")
    bounds = written(bounds.withColumn("u", F.monotonically_increasing_id()), "negatives-bounds")
    far = forest.search(bounds.select(F.col("u").alias("t"), "label", "dim", "q", "lo", "hi"), False, negatives)
    far = far.withColumnRenamed("t", "u").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("rank", "d", "score"))).alias("found"))
    both = bounds.select("u", "t", "score").join(far, "u").select("t", F.struct("score", "found").alias("f"))
    lists = near.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("rank", "d", "c", "score"))).alias("near"))
    lists = lists.join(both.groupBy("t").agg(F.collect_list("f").alias("far")), "t").join(classes.select("t", "n", "label", "q"), "t")
    lists = written(lists.select("label", "q", "n", "near", "far"), "negatives-lists")
    total = anchors.count()
    out = met(anchors.select("d", "label", "q", "c"), lists, ["label", "q"], "n", total)
    own = F.slice(F.filter("near", lambda p: ~((p["d"] == F.col("d")) & (p["c"] == F.col("c")))), 1, positives)
    out = out.select(F.col("d").alias("anchor_id"), "far", F.explode(own).alias("p"))
    out = out.select("anchor_id", "p", F.explode("far").alias("f")).filter(F.col("f.score") == F.col("p.score"))
    out = out.select("anchor_id", "p", F.explode("f.found").alias("g"))
    return out.select("anchor_id", id_back("p.d").alias("positive_id"), F.col("g.rank").alias("rank"), id_back("g.d").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("g.score").alias("negative_score"))
