"""One step of suffix stripping as an equi-join with the suffix table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.harmony import STRICT, Checker
from ..functions.phonology import is_valid_stem
from .lexicon import root_lookup
from .tables import BUFFERED_BY_N

LONGEST = 6
#: The shortest stem that the dictionary may vouch for, whatever the suffix asks.
LEAST_KNOWN = 2


def matches(words: DataFrame, table: DataFrame, checker: Checker = STRICT, least_stem: int | None = None, valid=is_valid_stem, longest: int = LONGEST) -> DataFrame:
    """(word, stem, form, label): every suffix that word ends in and that may be stripped.

    Endings of each length are exploded and joined by equality to the broadcast table of forms (a few hundred rows), so no
    word is held against all forms.
    """
    ends = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - 1))).alias("k")).filter("length(word) > k and k > 0")
    cut = ends.select("word", F.expr("left(word, length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("form"))
    least = F.col("min_stem") if least_stem is None else F.greatest("min_stem", F.lit(least_stem))
    s, x = F.col("stem"), F.col("form")
    hit = cut.join(F.broadcast(table), "form").filter((F.length(s) >= least) & valid(s))
    return hit.filter((F.col("exempt") | checker.vowels(s, x)) & checker.consonants(s, x)).select("word", "stem", "form", "label")


def known_matches(words: DataFrame, table: DataFrame, dictionary: DataFrame, checker: Checker = STRICT) -> DataFrame:
    """(word, stem, form, label): suffixes whose stem has a root in the dictionary.

    Where a case ending begins with n and the stem with that n is a word itself, the n may be the stem's: that reading is
    given too, without further checks.
    """
    hit = matches(words, table.withColumn("min_stem", F.lit(LEAST_KNOWN)), checker)
    own = hit.join(root_lookup(dictionary).select(F.col("surface").alias("_s")), F.lower("stem") == F.col("_s"), "left_semi")
    begins = own.filter(F.startswith("form", F.lit("n")) & (F.length("form") > 1) & F.col("label").isin(*sorted(BUFFERED_BY_N)))
    with_n = begins.select("word", F.concat("stem", F.lit("n")).alias("stem"), F.expr("substring(form, 2)").alias("form"))
    with_n = with_n.join(dictionary.select(F.col("word").alias("_w")).distinct(), F.lower("stem") == F.col("_w"), "left_semi")
    with_n = with_n.join(F.broadcast(table.select("form", "label")), "form").select("word", "stem", "form", "label")
    return own.unionByName(with_n).distinct()
