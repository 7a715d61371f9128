"""Shared helpers: table access, reliable lineage cuts, grouping of sorted Arrow rows, tiles for hot groups."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators: it sorts before all others and joins with itself.
NULL_ID = -(2**63)


#: Rows of an Arrow batch at most: with long texts Spark's 10,000 are much memory, twice over.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(spark.conf.get(_BATCH)))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; unset only in local tests."""
    sc = spark.sparkContext
    got = sc.getCheckpointDir()
    if got:
        return got
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lalespark-checkpoints-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    """Meanwhile a query's shuffle files go once it has ended: what it made lies in the shared folder by then."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later jobs read the shared folder, so lost executors cost nothing."""
    shared_dir(df.sparkSession)
    with _cleaned(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Like cut(), as a compressed Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table of written() that nothing reads any more."""
    make, uri = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.java.net.URI
    ours = make(shared_dir(spark)).toUri().getPath().rstrip("/") + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = make(uri(folder))
        if path.toUri().getPath().startswith(ours):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (d, t1, t2, text): the id with nulls replaced, and 128 hash bits of the text.

    Rows of equal id and text are one document; other columns can't clash as none is kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(7), text).alias("t2"),
        text.alias("text"),
    )


def id_back(c: str = "d"):
    return F.when(F.col(c) != F.lit(NULL_ID), F.col(c))


def groups(batches, keys: list[str], flush_rows: int = 50_000):
    """From batches sorted by keys: tables that hold whole groups only, of flush_rows rows or a little more."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < flush_rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        change = changes(t, keys)
        last = int(change[-1])
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, rows = t.to_batches(), t.num_rows
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def trimmed(run):
    """run, after which a task gives free memory back: workers live on and serve other steps, two beside each JVM."""

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(batches, rows: int = 256):
    """The batches in slices of a few rows, so that Python objects are made for those only."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group starts."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


#: Keys at most that are joined by broadcast: those that hold more than one in so many of all rows.
HOT_KEYS = 10_000


def met(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows.join(per_key, keys), where no task gets all rows of a frequent key.

    per_key: one row a key, with its number of rows in `count`; total: the number of all rows, at least. Fewer than HOT_KEYS
    keys hold more than total / HOT_KEYS rows; they are joined by broadcast, the others as usual.
    """
    frequent = F.col(count) * HOT_KEYS > total
    hot, rest = per_key.filter(frequent).drop(count), per_key.filter(~frequent).drop(count)
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys))


def tiled(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Adds tile, ta, tb: a group of more than `most` rows is cut into tiles, and each row goes once to each pair of its tile with another.

    Every two rows of a group meet in exactly one (ta, tb); a group of at most `most` rows stays whole at (0, 0).
    """
    big = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most))
    if big.isEmpty():
        return rows.select("*", F.lit(0).alias("tile"), F.lit(0).alias("ta"), F.lit(0).alias("tb"))
    out = rows.join(big, keys, "left").withColumn("_t", F.coalesce(F.ceil(F.col("_n") * F.lit(1.25) / most), F.lit(1)).cast("int"))
    out = out.withColumn("tile", F.pmod(F.xxhash64(F.col(order), F.lit(11)), F.col("_t")).cast("int"))
    out = out.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))
    return out.withColumn("ta", F.least("tile", "_j")).withColumn("tb", F.greatest("tile", "_j")).drop("_n", "_t", "_j")
