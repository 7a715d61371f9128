"""Tokens and sentences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, digits, underscore and apostrophes; \\w alone is ASCII in Java.
TOKEN = r"[\p{L}\p{N}_'’]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts at white space after . ! or ?"""
    return F.split(text, r"(?<=[.!?])\s+")


def comma_flags(text: Column) -> Column:
    """For each token whether a comma stands between it and the next one."""
    gaps = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_'’]+([^\p{L}\p{N}_'’]*)"), F.lit(1))
    inner = F.transform(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.contains(g, F.lit(",")))
    return F.when(F.size(gaps) > 0, F.concat(inner, F.array(F.lit(False)))).otherwise(inner)


def clean_words(text: Column) -> Column:
    """Words by white space, without punctuation marks; empty ones go."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[.,;:!?\"()\[\]…—–']", "")), lambda w: w != "")


def token_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, word), pos from 0."""
    return docs.select(id_col, F.posexplode(tokens(F.col("text"))).alias("pos", "word"))


def distinct_words(docs: DataFrame) -> DataFrame:
    """Each word once, in Turkish lower case: later operators work on this and are joined back."""
    from .phonology import turkish_lower

    return docs.select(F.explode(tokens(F.col("text"))).alias("word")).select(turkish_lower(F.col("word")).alias("word")).distinct()
