"""Streams of texts: the same operators, which keep no state, over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import annotate as A


def texts(spark: SparkSession, path: str, schema: str = "doc_id long, text string", files: int = 100) -> DataFrame:
    """A stream of the Parquet files that come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def annotated(docs: DataFrame, dictionary: DataFrame | None = None, parser_words: DataFrame | None = None) -> DataFrame:
    """Annotated words of a stream of documents; dictionaries are tables that are read once, at the start."""
    return A.annotate(A.sentences(docs), dictionary, parser_words)
