"""Line dedup by overlapping windows of three lines.

Each three consecutive lines are hashed; a window whose lines also start earlier (smaller id, or the same document and an
earlier line) is found by one aggregation over all windows, and the lines it covers go. Covered positions are merged, and
windows are judged on the input.

Lines are parted by \\n and compared unchanged; documents of fewer than three lines stay. Null text is empty: one empty
line. A null id sorts first. Rows of equal id and text are one document and get equal results. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_back, keyed, slices, trimmed, unused

WINDOW = 3


def windows(keys: DataFrame, width: int = WINDOW) -> DataFrame:
    """(d, t1, t2, s, h1, h2): the 128-bit hash of each window and the line at which it starts."""
    lines = keys.select("d", "t1", "t2", F.split("text", "\n", -1).alias("lines")).filter(F.size("lines") >= width)
    parts = lambda i: [F.get("lines", i + k) for k in range(width)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("lines") - width),
        lambda i: F.struct(i.alias("s"), F.xxhash64(*parts(i)).alias("h1"), F.xxhash64(F.lit(7), *parts(i)).alias("h2")),
    )
    return lines.select("d", "t1", "t2", F.inline(each))


def repeated(win: DataFrame) -> DataFrame:
    """(d, t1, t2, starts): windows that also start earlier.

    The first place of a window is a minimum that is taken before the shuffle too; only windows that occur twice are
    joined back, and the join's large keys can be split.
    """
    first = win.groupBy("h1", "h2").agg(F.min(F.struct("d", "s")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = win.join(first, ["h1", "h2"]).filter(F.struct("d", "s") > F.col("first"))
    return later.groupBy("d", "t1", "t2").agg(F.collect_set("s").alias("starts"))


def left(lines: list[str], starts: list[int] | None, width: int = WINDOW) -> list[str]:
    """The lines that no window from starts covers."""
    if not starts:
        return lines
    edge, at = np.zeros(len(lines) + 1, dtype=np.int64), np.array(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return [x for x, c in zip(lines, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not c]


def _remove(width: int):
    def run(batches):
        for b in slices(batches):
            texts, n, gone = [], [], []
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                lines = text.split("\n")
                keep = left(lines, starts, width)
                texts.append("\n".join(keep))
                n.append(len(lines))
                gone.append(len(lines) - len(keep))
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("t1"), b.column("t2"), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["d", "t1", "t2", "text", "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, text, n_lines, n_removed): what is left of each document, its lines before and how many went."""
    keys = keyed(docs)
    starts = repeated(windows(keys, width))
    both = keys.join(starts, ["d", "t1", "t2"], "left").select("d", "t1", "t2", "text", "starts")
    out = both.mapInArrow(_remove(width), "d long, t1 long, t2 long, text string, n_lines long, n_removed long")
    return out.select(id_back().alias("doc_id"), "text", "n_lines", "n_removed")


def stage(docs: DataFrame) -> DataFrame:
    """Documents with repeated lines removed; those of which nothing but blanks is left go. n_chars follows the text."""
    names = docs.columns
    d, t1, t2, found = (unused(docs, c) for c in ("_d", "_t1", "_t2", "_starts"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), t1: F.xxhash64(text), t2: F.xxhash64(F.lit(7), text)})
    starts = repeated(windows(keyed(docs)))
    hit = base.join(starts.select(F.col("d").alias(d), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("starts").alias(found)), [d, t1, t2], "left")
    schema = hit.select(*names).schema

    def run(batches):
        for b in slices(batches):
            at, cols = b.schema.names.index("text"), [b.column(n) for n in names]
            texts = b.column(at).to_pylist()
            for k, starts_ in enumerate(b.column(found).to_pylist()):
                if starts_:
                    texts[k] = "\n".join(left(texts[k].split("\n"), starts_))
            cols[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = hit.select(*names, found).mapInArrow(trimmed(run), schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.filter(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0).select(*names)
