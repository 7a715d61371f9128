"""Quality selection by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs: one of target text (rows labelled good and not toxic), one of
all raw text. A row's log_weight is the logarithm of the ratio of its likelihoods under the two. The target model is smoothed
with the raw one, which stands for SMOOTHING of its counts. Adding Gumbel noise to the log weights, times a power, and taking
the k largest samples k rows without replacement in proportion to their ratios to that power. The noise comes from a hash of
the id and the text, so a rerun draws the same.

By default the power is TYPICAL over the row's number of n-grams: rows are drawn by the ratio of TYPICAL n-grams like theirs.
With a power of 1 the sum over a long row drowns both the noise and the rows of usual length, whichever sign it has, and held
out labels fare worse (figures in the README).

Counts of raw text cover all rows; the target model is fitted on a sample of TARGET_ROWS labelled rows, drawn by a hash. A
model is BUCKETS numbers at any size. The k-th largest key is found by narrowing a histogram, with
no global sort. Null or empty text has weight 0. Rows without a usable label train the raw model only. Ties at the k-th key
are broken by id. Repeated rows draw the same key. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .common import NULL_ID, id_back, written

BUCKETS = 1 << 16
#: Rows of target text at most that the target model is fitted on; their ids are broadcast, so no text is shuffled.
TARGET_ROWS = 20_000
#: N-grams that a row is weighed as if it had, and the share of the target model that is the raw one.
TYPICAL, SMOOTHING = 200, 0.01


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each word and each pair of neighbours in the documents of data."""
    start, end = scan.spans(data, offsets, scan.MARKS)
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    words = scan.word_hashes(data, start, end, scan.LOWER_BYTES)
    pairs = scan.gram_hashes(words, 2)
    inside = doc[1:] == doc[:-1]
    return np.concatenate([doc, doc[1:][inside]]), (np.concatenate([words, pairs[inside]]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches):
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for b in batches:
        target = b.column("target").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in scan.texts(b):
            doc, bucket = features(data, offsets)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[target[lo:hi][doc]], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "target"])


def fit(rows: DataFrame) -> np.ndarray:
    """The log ratio of each bucket from rows (text, target)."""
    got = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in got:  # at most BUCKETS rows
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return log_ratios(raw, target)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log ratio of each bucket from its counts; raw counts get one more each. Without target rows all are zero."""
    like_raw = (raw + 1) / (raw + 1).sum()
    prior = max(1.0, SMOOTHING * target.sum())
    return np.log((target + prior * like_raw) / (target.sum() + prior)) - np.log(like_raw)


def _weigh(ratios: np.ndarray):
    def run(batches):
        for b in batches:
            out, n = np.zeros(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for lo, hi, data, offsets in scan.texts(b):
                doc, bucket = features(data, offsets)
                out[lo:hi] = np.bincount(doc, weights=ratios[bucket], minlength=hi - lo)
                n[lo:hi] = np.bincount(doc, minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t"), pa.array(out), pa.array(n)], names=["d", "t", "log_weight", "n_features"])

    return run


def top(keys: DataFrame, k: int, steps: int = 1024) -> tuple[float, int | None]:
    """(key, id): rows above them in (key, then smaller id) order are the k largest. Narrows a histogram by aggregation."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    if lo is None or k <= 0:
        return float("inf"), None
    while True:
        width = (hi - lo) / steps
        if width <= 0 or lo + width == lo:
            break
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(steps - 1)).cast("int")
        counts = {r["c"]: (r["n"], r["a"], r["z"]) for r in keys.filter(F.col("key").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()}
        for c in sorted(counts, reverse=True):
            if above + counts[c][0] >= k:
                break
            above += counts[c][0]
        else:
            return float("-inf"), None  # k or fewer rows
        n, lo, hi = counts[c]
        if above + n == k:
            return lo, None
        if lo == hi:
            break
    # All keys in [lo, hi] are equal: the smallest ids go in.
    ids = keys.filter(F.col("key").between(lo, hi))
    need, a, z = k - above, *ids.agg(F.min("d"), F.max("d")).first()
    while a < z:
        mid = (a + z) // 2
        if ids.filter(F.col("d") <= mid).count() >= need:
            z = mid
        else:
            a = mid + 1
    return lo, a


def select(docs: DataFrame, labels: DataFrame, share: float | None = None, power: float | None = None) -> DataFrame:
    """(doc_id, log_weight, n_features, gumbel_key, selected) of every row; share of the rows is selected.

    share is by default that of target rows among labelled ones, so as many rows stay as are expected to be good. power
    raises the ratios; by default TYPICAL over the row's n-grams.
    """
    if share is None:
        is_good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        share = labels.filter(F.col("quality").isNotNull()).agg(F.avg(is_good.cast("double"))).first()[0]
        share = 1.0 if share is None else share
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select(F.col("doc_id").cast("long").alias("d")).distinct()
    good = good.orderBy(F.xxhash64("d", F.lit(3)), "d").limit(TARGET_ROWS).withColumn("target", F.lit(True))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("d"), text.alias("text"))
    ratios = fit(rows.join(F.broadcast(good), "d", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))
    weighed = rows.withColumn("t", F.xxhash64("text")).mapInArrow(_weigh(ratios), "d long, t long, log_weight double, n_features long")
    u = (F.xxhash64(F.col("d"), F.col("t"), F.lit(77)).cast("double") / F.lit(2.0**64) + 0.5) * (1 - 2e-16) + 1e-16
    raised = F.col("log_weight") * (F.lit(float(TYPICAL)) / F.greatest("n_features", F.lit(1)) if power is None else F.lit(float(power)))
    keyed = written(weighed.select("d", "log_weight", "n_features", (raised - F.log(-F.log(u))).alias("key")), "importance")
    edge, last = top(keyed, round(share * keyed.count()))
    chosen = F.col("key") >= F.lit(edge) if last is None else (F.col("key") > F.lit(edge)) | ((F.col("key") == F.lit(edge)) & (F.col("d") <= F.lit(last)))
    return keyed.select(id_back().alias("doc_id"), "log_weight", "n_features", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
