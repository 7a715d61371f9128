"""Queries of the dictionary, suffix matching and word analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import harmony as H
from ..functions.phonology import CONSONANTS, SONORANT_SIBILANT
from ..operators import lexicon, matching, search, suffixes
from ..operators.tables import BUFFERED_BY_N
from .analysis_sql import analyses
from .base import DICTIONARY, SQL_FIRST, SQL_LAST, SQL_LOWER, TOKEN, SQL_WORDS, V, lowered, sql_consonant, sql_major, sql_minor, table, values
from .base import words as distinct_words
from .dimension import _FORMS

QUERIES, ORACLES = {}, {}


def dictionary(spark, sf_dir):
    """Words of letters that come twice in the documents, and the Turkish ones."""
    own = spark.createDataFrame([(w,) for w in DICTIONARY], "word string")
    return lexicon.words_of(table(spark, sf_dir, "documents")).unionByName(own).distinct()


def _stems(spark, sf_dir):
    """Words without their last 0 to 2 letters."""
    cut = lowered(spark, sf_dir).select(F.explode(F.array(*[F.expr(f"left(word, greatest(length(word) - {k}, 0))") for k in range(3)])).alias("stem"))
    return cut.filter("stem <> ''").distinct()


def dict_words(spark, sf_dir):
    return dictionary(spark, sf_dir)


def dict_contains(spark, sf_dir):
    known = dictionary(spark, sf_dir).withColumn("in_dict", F.lit(True))
    return lowered(spark, sf_dir).join(known, "word", "left").select("word", F.coalesce("in_dict", F.lit(False)).alias("in_dict"))


def dict_verbs(spark, sf_dir):
    """Verb stems and other words of the dictionary."""
    return lexicon.bare(dictionary(spark, sf_dir)).groupBy("root").agg(F.bool_or("is_verb").alias("is_verb"), F.bool_or(~F.col("is_verb")).alias("is_word"))


def find_root(spark, sf_dir):
    return lexicon.find_roots(_stems(spark, sf_dir), lexicon.root_lookup(dictionary(spark, sf_dir))).select("stem", "root")


def find_root_narrowing(spark, sf_dir):
    return lexicon.find_roots_narrowed(_stems(spark, sf_dir), lexicon.root_lookup(dictionary(spark, sf_dir))).select("stem", "root")


def suffix_match_strict(spark, sf_dir):
    return matching.matches(lowered(spark, sf_dir), suffixes.table(spark))


def suffix_match_relaxed(spark, sf_dir):
    return matching.matches(lowered(spark, sf_dir), suffixes.table(spark), H.RELAXED, 3)


def suffix_match_known_strict(spark, sf_dir):
    return matching.known_matches(lowered(spark, sf_dir), suffixes.table(spark), dictionary(spark, sf_dir))


def suffix_match_known_relaxed(spark, sf_dir):
    return matching.known_matches(lowered(spark, sf_dir), suffixes.table(spark), dictionary(spark, sf_dir), H.RELAXED)


def _flat(df):
    path = F.array_join(F.transform("suffixes", lambda s: F.concat(s["form"], F.lit("/"), s["label"])), "+")
    return df.select("word", "rank", "stem", "root", "lemma", path.alias("suffixes"))


def analyze_all(spark, sf_dir):
    """Up to five analyses of each distinct word, with a dictionary."""
    return _flat(search.analyze(distinct_words(spark, sf_dir), dictionary(spark, sf_dir)))


def analyze_heuristic(spark, sf_dir):
    """The same without a dictionary."""
    return _flat(search.analyze(distinct_words(spark, sf_dir)))


def analyze_top1(spark, sf_dir):
    return analyze_all(spark, sf_dir).filter("rank = 1").drop("rank")


def stem_frequency(spark, sf_dir):
    """How often each stem comes in the texts: analyses of distinct words joined back to their counts."""
    from ..functions.tokens import tokens

    counted = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(analyze_top1(spark, sf_dir).select("word", "stem"), "word").groupBy("stem").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))


def _read_words(spark, sf_dir):
    return search.analyze(distinct_words(spark, sf_dir), dictionary(spark, sf_dir)).filter("rank = 1")


def suffix_usage(spark, sf_dir):
    """How many words of the documents take each suffix of the table, by form and label as read in context of the word."""
    used = _read_words(spark, sf_dir).select(F.inline("suffixes")).groupBy("form", "label").agg(F.count(F.lit(1)).alias("n"))
    table_ = suffixes.table(spark).select("form", F.col("label").alias("listed"))
    return table_.join(used, "form", "full").select("form", "listed", "label", F.coalesce("n", F.lit(0)).alias("n"))


def fsm_words(spark, sf_dir):
    """The label sequences of the words' best analyses, and whether the automaton accepts them as they are read."""
    labels = F.reverse(F.transform("suffixes", lambda s: s["label"]))
    rows = _read_words(spark, sf_dir).select(F.array_join(labels, "+").alias("labels"), suffixes.is_valid_sequence(labels).alias("valid"))
    return rows.groupBy("labels", "valid").agg(F.count(F.lit(1)).alias("n"))


QUERIES |= {f.__name__: f for f in (suffix_usage, fsm_words, dict_words, dict_contains, dict_verbs, find_root, find_root_narrowing, suffix_match_strict, suffix_match_relaxed, suffix_match_known_strict, suffix_match_known_relaxed, analyze_all, analyze_heuristic, analyze_top1, stem_frequency)}

_DICT = (
    f"{SQL_LOWER}, tok AS (SELECT lower(translate(unnest(regexp_extract_all(text, '{TOKEN}')), 'İI', 'iı')) AS word FROM documents), "
    f"dict AS (SELECT word FROM tok WHERE regexp_full_match(word, '\\p{{L}}+') GROUP BY word HAVING count(*) >= 2 UNION SELECT w FROM (VALUES {values((w,) for w in DICTIONARY)}) AS t(w)), "
    "verbs AS (SELECT DISTINCT left(word, length(word) - 3) AS root FROM dict WHERE regexp_matches(word, 'm[ae]k$') AND length(word) > 3), roots AS (SELECT word AS root FROM dict UNION SELECT root FROM verbs), "
    "stems AS (SELECT DISTINCT left(word, greatest(length(word) - k, 0)) AS stem FROM low, unnest(range(0, 3)) AS u(k) WHERE length(word) > k)"
)


def _probes(name: str, source: str) -> str:
    hard = f"CASE WHEN contains('bcdgğ', right(s, 1)) THEN left(s, length(s) - 1) || translate(right(s, 1), 'bcdgğ', 'pçtkk') END"
    vowel = f"translate(regexp_extract(left(s, length(s) - 2), '.*([{V}])', 1), 'aıeiouöü', 'ııiiuuüü')"
    restored = f"CASE WHEN regexp_matches(s, '[{CONSONANTS}]{{2}}$') AND {vowel} <> '' AND NOT contains('âîû', {vowel}) THEN left(s, length(s) - 1) || {vowel} || right(s, 1) END"
    plain = f"CASE WHEN regexp_matches(s, '[{V}][yns]$') THEN left(s, length(s) - 1) END"
    return (
        f"{name}0 AS (SELECT s, {hard} AS h, {restored} AS r, {plain} AS b FROM {source}), "
        f"{name} AS (SELECT s, CASE WHEN s IN (SELECT root FROM roots) THEN s WHEN h IN (SELECT root FROM roots) THEN h WHEN r IN (SELECT word FROM dict) THEN r WHEN b IN (SELECT root FROM roots) THEN b END AS root FROM {name}0)"
    )


_STRIP = f"""WITH RECURSIVE {_FORMS}, {SQL_LOWER}, cut AS (SELECT word, left(word, length(word) - k) AS stem, right(word, k) AS form FROM low, unnest(range(1, 7)) AS u(k) WHERE length(word) > k),
m AS (SELECT word, stem, form, label, min_stem, exempt, {SQL_LAST.format(w='stem')} AS a, {SQL_FIRST.format(w='form')} AS b FROM cut JOIN forms USING (form)
  WHERE regexp_matches(stem, '[{V}]') AND NOT regexp_matches(stem, '[{CONSONANTS}]{{3}}$') AND (NOT regexp_matches(stem, '[{CONSONANTS}]{{2}}$') OR contains('{SONORANT_SIBILANT}', stem[-2])))
SELECT word, stem, form, label FROM m WHERE length(stem) >= @least AND (exempt OR @vowels) AND {sql_consonant('stem', 'form')}"""



def _known(vowels: str) -> str:
    """Stripping with stems that have a root, and the readings with a stem's own n."""
    strip = _STRIP.replace(f"{SQL_LOWER}, ", f"{_DICT}, ").replace("\nSELECT word", ",\nh AS (SELECT word", 1).replace("@least", "2").replace("@vowels", f"({vowels})")
    labels = ", ".join(f"'{x}'" for x in sorted(BUFFERED_BY_N))
    return (
        f"{strip}), src AS (SELECT DISTINCT stem AS s FROM h), {_probes('p', 'src')}, k AS (SELECT h.* FROM h JOIN p ON p.s = h.stem WHERE p.root IS NOT NULL) SELECT word, stem, form, label FROM k "
        f"UNION SELECT k.word, k.stem || 'n', f.form, f.label FROM k JOIN forms f ON f.form = substr(k.form, 2) WHERE k.form LIKE 'n_%' AND k.label IN ({labels}) AND k.stem || 'n' IN (SELECT word FROM dict)"
    )


ORACLES |= {
    "suffix_match_known_strict": _known(f"{sql_major('a', 'b')} AND {sql_minor('a', 'b')}"),
    "suffix_match_known_relaxed": _known(sql_minor("a", "b")),
    "dict_words": f"WITH {_DICT} SELECT word FROM dict",
    "dict_contains": f"WITH {_DICT} SELECT word, word IN (SELECT word FROM dict) AS in_dict FROM low",
    "dict_verbs": f"WITH {_DICT} SELECT root, root IN (SELECT root FROM verbs) AS is_verb, root IN (SELECT word FROM dict) AS is_word FROM roots",
    "find_root": f"WITH {_DICT}, src AS (SELECT stem AS s FROM stems), {_probes('p', 'src')} SELECT s AS stem, root FROM p",
    "find_root_narrowing": f"WITH {_DICT}, src AS (SELECT stem AS s FROM stems), {_probes('p', 'src')}, "
    f"wide AS (SELECT s AS stem, left(s, length(s) - 1) || translate(right(s, 1), 'ıiuü', 'aeoö') AS s FROM src WHERE contains('ıiuü', right(s, 1))), {_probes('q', '(SELECT DISTINCT s FROM wide)')} "
    "SELECT p.s AS stem, coalesce(p.root, q.root) AS root FROM p LEFT JOIN wide ON wide.stem = p.s LEFT JOIN q ON q.s = wide.s",
    "suffix_match_strict": _STRIP.replace("@least", "min_stem").replace("@vowels", f"({sql_major('a', 'b')} AND {sql_minor('a', 'b')})"),
    "suffix_match_relaxed": _STRIP.replace("@least", "greatest(min_stem, 3)").replace("@vowels", f"({sql_minor('a', 'b')})"),
}

_NO_DICT = f"{SQL_WORDS}, dict AS (SELECT word FROM words WHERE false), verbs AS (SELECT word AS root FROM dict), roots AS (SELECT word AS root FROM dict)"
_ALL = analyses(_DICT, _probes, True)
ORACLES |= {
    "analyze_all": f"{_ALL} SELECT word, rank, stem, root, lemma, suffixes FROM out",
    "analyze_top1": f"{_ALL} SELECT word, stem, root, lemma, suffixes FROM out WHERE rank = 1",
    "analyze_heuristic": f"{analyses(_NO_DICT, _probes, False)} SELECT word, rank, stem, root, lemma, suffixes FROM out",
    "stem_frequency": f"{_ALL}, n AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents) GROUP BY word) SELECT stem, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS words FROM out JOIN n USING (word) WHERE rank = 1 GROUP BY stem",
}

_BY_LABEL = "MAP {" + ", ".join(f"'{x}': [" + ", ".join(f"{{'fr': {suffixes.FROM[s]}, 'bit': {suffixes.BIT[s]}}}" for s in slots) + "]" for x, slots in suffixes.SLOTS_OF.items()) + "}"
_MOVE = f"struct_pack(s := CASE WHEN {_BY_LABEL}[y.l] IS NULL THEN x.s ELSE CAST(list_sum(list_transform({_BY_LABEL}[y.l], lambda m: CASE WHEN x.s & m.fr <> 0 THEN m.bit ELSE 0 END)) AS INTEGER) END, l := CAST(NULL AS VARCHAR))"
ORACLES |= {
    "suffix_usage": f"{_ALL}, used AS (SELECT f AS form, l AS label, count(*) AS n FROM (SELECT unnest(fs) AS f, unnest(ls) AS l FROM out WHERE rank = 1) GROUP BY ALL) SELECT coalesce(forms.form, used.form) AS form, forms.label AS listed, used.label, coalesce(n, 0) AS n FROM forms FULL JOIN used ON used.form = forms.form",
    "fsm_words": f"{_ALL} SELECT array_to_string(list_reverse(ls), '+') AS labels, list_reduce(list_transform(list_reverse(ls), lambda z: struct_pack(s := {suffixes.START}, l := z)), lambda x, y: {_MOVE}, struct_pack(s := {suffixes.START}, l := CAST(NULL AS VARCHAR))).s <> 0 AS valid, count(*) AS n FROM out WHERE rank = 1 GROUP BY ALL",
}
