"""The dictionary as a DataFrame, and finding roots by one equi-join.

A dictionary word can show up in a word's stem as it is, as a verb without -mak or -mek, with a softened last consonant,
without the vowel of its last syllable, or with a buffer consonant after it. root_lookup() makes all these surfaces from the
dictionary, each with the rank of its rule, and keeps the best for each surface; find_root is then a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phonology import CONSONANTS, VOWELS, turkish_lower

# Final consonants and what they soften to, the vowel that harmonises with the one before, narrowed vowels.
SOFTENED = {"p": ["b"], "ç": ["c"], "t": ["d"], "k": ["g", "ğ"]}
INSERTED = {"a": "ı", "ı": "ı", "e": "i", "i": "i", "o": "u", "u": "u", "ö": "ü", "ü": "ü"}
WIDENED = {"ı": "a", "i": "e", "u": "o", "ü": "ö"}
BUFFERS = "yns"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word a line; blanks go, case is lowered plainly, each word comes once."""
    return spark.read.text(path).select(F.lower(F.trim(F.col("value"), F.lit(" \t\r\x0b\x0c"))).alias("word")).filter("word <> ''").distinct()


def words_of(docs: DataFrame, least: int = 2) -> DataFrame:
    """A stand-in dictionary: words of letters only that come at least `least` times in the documents."""
    from ..functions.tokens import tokens

    w = docs.select(F.explode(tokens(F.col("text"))).alias("w")).select(turkish_lower(F.col("w")).alias("word"))
    return w.filter(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").count().filter(F.col("count") >= least).select("word")


def bare(words: DataFrame) -> DataFrame:
    """(root, is_verb): words as they are and verbs without their ending."""
    verb = words.filter(F.col("word").rlike("m[ae]k$") & (F.length("word") > 3)).select(F.expr("left(word, length(word) - 3)").alias("root"), F.lit(True).alias("is_verb"))
    return words.select(F.col("word").alias("root"), F.lit(False).alias("is_verb")).unionByName(verb)


def root_lookup(words: DataFrame) -> DataFrame:
    """(surface, root, in_dict, is_verb): the root of each surface, and whether the surface itself is a word or a verb stem."""
    roots = bare(words)
    at = F.expr("left(root, length(root) - 1)")
    last = F.right(F.col("root"), F.lit(1))
    surface = lambda s, rank: F.struct(s.alias("surface"), F.lit(rank).alias("rank"))
    soft = [F.when(last == k, surface(F.concat(at, F.lit(c)), 3)) for k, all_c in SOFTENED.items() for c in all_c]
    before = F.regexp_extract(F.expr("left(root, greatest(length(root) - 3, 0))"), f".*([{VOWELS}])", 1)
    table = F.create_map(*[F.lit(x) for p in INSERTED.items() for x in p])
    pattern = F.col("root").rlike(f"[{CONSONANTS}][{VOWELS}][{CONSONANTS}]$")
    fits = table[F.nullif(before, F.lit(""))] == F.expr("substring(root, -2, 1)")
    dropped = F.when(~F.col("is_verb") & pattern & fits, surface(F.concat(F.expr("left(root, length(root) - 2)"), last), 4))
    buffered = [F.when(last.rlike(f"[{VOWELS}]"), surface(F.concat("root", F.lit(c)), 5)) for c in BUFFERS]
    own = surface(F.col("root"), 1)
    each = roots.select("root", "is_verb", F.explode(F.filter(F.array(own, *soft, dropped, *buffered), lambda x: x.isNotNull())).alias("s")).select("s.*", "root", "is_verb")
    is_own = F.col("rank") == 1
    return each.groupBy("surface").agg(
        F.min_by("root", F.col("rank")).alias("root"),
        F.bool_or(is_own & ~F.col("is_verb")).alias("in_dict"),
        F.bool_or(is_own & F.col("is_verb")).alias("is_verb"),
    )


def find_roots(stems: DataFrame, lookup: DataFrame, stem: str = "stem") -> DataFrame:
    """stems with root, null where none is found. Case is lowered plainly, as in the dictionary."""
    return stems.join(lookup.select(F.col("surface").alias("_s"), "root"), F.lower(F.col(stem)) == F.col("_s"), "left").drop("_s")


def widened(stem: Column) -> Column:
    """The stem with its narrowed last vowel widened again; null if it ends in another letter."""
    table = F.create_map(*[F.lit(x) for p in WIDENED.items() for x in p])
    return F.concat(F.left(stem, F.length(stem) - 1), table[F.right(stem, F.lit(1))])


def find_roots_narrowed(stems: DataFrame, lookup: DataFrame, stem: str = "stem") -> DataFrame:
    """Like find_roots, and where that finds none, the root of the widened stem."""
    one = find_roots(stems, lookup, stem).withColumn("_w", widened(F.lower(F.col(stem))))
    two = lookup.select(F.col("surface").alias("_s"), F.col("root").alias("_r"))
    return one.join(two, F.col("_w") == F.col("_s"), "left").withColumn("root", F.coalesce("root", "_r")).drop("_w", "_s", "_r")
