"""Intermediate tables that later steps read several times, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir: computed once, and lost executors cost nothing. Only local sessions
    without that setting get a folder of their own."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table there, for what is large: columns are compressed."""
    path = f"{_folder(df)}/lalespark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="lalespark-checkpoints-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()
