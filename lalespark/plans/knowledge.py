"""Queries of the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as K
from ..sources import derivations as D
from .base import SQL_LOWER, lowered, values

ASKED = ["-lIk", "-çI", "-sIz", "-(D)Ir-", "-zzz", "-mAcA", "-leyIn"]


def _asked(spark):
    return spark.createDataFrame([(x,) for x in ASKED], "ek string")


def kb_search(spark, sf_dir):
    return K.search(spark, "isim").drop("place")


def kb_code(spark, sf_dir):
    return K.search(spark, "L112").drop("place")


def kb_filter(spark, sf_dir):
    return K.select(spark, tur="E→A", taban="EYLEM", least=10).drop("place")


def kb_topn(spark, sf_dir):
    return K.most_productive(spark, 20)


def kb_type_dist(spark, sf_dir):
    return K.by_kind(spark)


def kb_voice(spark, sf_dir):
    return D.voices(spark).drop("place")


def kb_upos(spark, sf_dir):
    return K.infer(spark, _asked(spark))


def kb_deprel(spark, sf_dir):
    return K.infer(spark, _asked(spark), D.DEPREL)


def kb_missing(spark, sf_dir):
    return K.lacking(spark, "Orta").drop("place")


def kb_series(spark, sf_dir):
    return K.series(spark)


def kb_json(spark, sf_dir):
    return K.as_json(spark)


def kb_statistics(spark, sf_dir):
    return D.statistics(spark)


def kb_rules(spark, sf_dir):
    return D.rules(spark)


def kb_coverage(spark, sf_dir):
    """What the first 5 and 20 suffixes and the rest cover of all entries, from the table itself."""
    return K.coverage(spark, (5, 20))


def kb_word_search(spark, sf_dir):
    """For each word of the documents the suffixes whose text holds it."""
    return K.search_words(spark, lowered(spark, sf_dir))


def _endings(spark, sf_dir):
    """The endings of two to five letters of the documents' words."""
    words = lowered(spark, sf_dir).filter("length(word) >= 4")
    return words.select(F.explode(F.array(*[F.right("word", F.lit(k)) for k in range(2, 6)])).alias("ek")).distinct()


def kb_word_upos(spark, sf_dir):
    """The part of speech that each ending of the documents' words hints at."""
    return K.infer_many(spark, _endings(spark, sf_dir))


def kb_word_deprel(spark, sf_dir):
    return K.infer_many(spark, _endings(spark, sf_dir), D.DEPREL)


QUERIES = {f.__name__: f for f in (kb_search, kb_code, kb_filter, kb_topn, kb_type_dist, kb_voice, kb_upos, kb_deprel, kb_missing, kb_series, kb_json, kb_statistics, kb_rules, kb_coverage, kb_word_search, kb_word_upos, kb_word_deprel)}

_E = f"e(place, kod, ek, taban, turev, sayi, ornekler, tur, aciklama) AS (VALUES {values(D.rows(D.SUFFIXES, (4,)))})"
_COLS = "kod, ek, taban, turev, CAST(sayi AS INTEGER) AS sayi, ornekler, tur, aciklama"
# lower('İ') is i and a combining dot in Spark, i alone in DuckDB.
_FOLD = "translate(lower(replace({}, 'İ', 'i̇')), 'ıöüçşğ', 'ioucsg')"


def _search(q: str) -> str:
    held = " OR ".join(f"contains({_FOLD.format(c)}, {_FOLD.format(repr(q))})" for c in ("ek", "ornekler", "aciklama"))
    return f"WITH {_E} SELECT {_COLS} FROM e WHERE kod = upper('{q}') OR {held}"


def _infer(table) -> str:
    flat = [(k, *x) for k, x in enumerate((v, note, ek) for v, note, eks in table for ek in eks)]
    clean = "regexp_replace(trim(lower({}), '-'), '[()/]', '', 'g')"
    return f"WITH g(place, value, note, ek) AS (VALUES {values(flat)}), q(ek) AS (VALUES {values((x,) for x in ASKED)}), h AS (SELECT q.ek, place, value, note FROM q LEFT JOIN g ON contains({clean.format('g.ek')}, {clean.format('q.ek')}) OR contains({clean.format('q.ek')}, {clean.format('g.ek')})) SELECT ek, arg_min(value, place) AS value, arg_min(note, place) AS note FROM h GROUP BY ek"


ORACLES = {
    "kb_search": _search("isim"),
    "kb_code": _search("L112"),
    "kb_filter": f"WITH {_E} SELECT {_COLS} FROM e WHERE tur = 'E→A' AND contains(upper(taban), 'EYLEM') AND sayi >= 10 ORDER BY e.sayi DESC, place LIMIT 50",
    "kb_topn": f"WITH {_E}, t AS (SELECT * FROM e ORDER BY sayi DESC, place LIMIT 20) SELECT CAST(row_number() OVER w AS INTEGER) AS sira, kod, ek, CAST(sayi AS INTEGER) AS sayi, round(CAST(sayi AS DOUBLE) * 100 / {D.ENTRIES}, 1) AS oran, round(CAST(sum(sayi) OVER w AS DOUBLE) * 100 / {D.ENTRIES}, 1) AS kapsam, tur FROM t WINDOW w AS (ORDER BY t.sayi DESC, place)",
    "kb_type_dist": f"WITH {_E} SELECT tur, CAST(sum(sayi) AS BIGINT) AS sayi, round(CAST(sum(sayi) AS DOUBLE) * 100 / (SELECT sum(sayi) FROM e), 1) AS oran FROM e GROUP BY ROLLUP (tur)",
    "kb_voice": f"SELECT cati, ek, kod, CAST(sayi AS INTEGER) AS sayi, aciklama, allomorf FROM (VALUES {values(D.rows(D.VOICES, (3,)))}) AS v(place, cati, ek, kod, sayi, aciklama, allomorf)",
    "kb_upos": _infer(D.UPOS),
    "kb_deprel": _infer(D.DEPREL),
    "kb_missing": f"SELECT ek, kod, CAST(sayi AS INTEGER) AS sayi, etki, oncelik FROM (VALUES {values(D.rows(D.MISSING, (2,)))}) AS v(place, ek, kod, sayi, etki, oncelik) WHERE oncelik = 'Orta'",
    "kb_json": f"WITH {_E} SELECT kod, CAST(to_json({{'kod': kod, 'ek': ek, 'taban': taban, 'turev': turev, 'sayi': CAST(sayi AS INTEGER), 'ornekler': ornekler, 'tur': tur, 'aciklama': aciklama}}) AS VARCHAR) AS json FROM e",
    "kb_statistics": f"SELECT CAST(place AS INTEGER) AS place, topic, item, value FROM (VALUES {values(D.rows(D.STATISTICS, ()))}) AS v(place, topic, item, value)",
    "kb_rules": "WITH v(place, line) AS (VALUES " + values(enumerate(D.RULES.splitlines())) + ") SELECT CAST(place AS INTEGER) AS place, split_part(line, '|', 1) AS topic, array_to_string(string_split(line, '|')[2:-2], '|') AS what, string_split(line, '|')[-1] AS outcome FROM v",
    "kb_coverage": f"WITH {_E}, r AS (SELECT sayi, row_number() OVER (ORDER BY e.sayi DESC, place) AS k FROM e) SELECT CAST(n AS INTEGER) AS n, round(CAST(sum(sayi) FILTER (WHERE k <= n) AS DOUBLE) * 100 / {D.ENTRIES}, 1) AS covered, CAST(sum(sayi) FILTER (WHERE k > n) AS BIGINT) AS rest FROM r, (VALUES (5), (20)) AS t(n) GROUP BY n",
    "kb_series": f"WITH {_E} SELECT left(kod, 1) AS seri, count(*) AS adet, CAST(sum(sayi) AS BIGINT) AS toplam, array_to_string(list(ek ORDER BY place)[1:5], ', ') || CASE WHEN count(*) > 5 THEN ' ... (+' || (count(*) - 5) || ')' ELSE '' END AS ekler FROM e GROUP BY 1",
}


def _infer_words(table) -> str:
    flat = [(k, *x) for k, x in enumerate((v, note, ek) for v, note, eks in table for ek in eks)]
    clean = "regexp_replace(trim(lower({}), '-'), '[()/]', '', 'g')"
    return (
        f"WITH {SQL_LOWER}, q AS (SELECT DISTINCT right(word, k) AS ek FROM low, unnest(range(2, 6)) AS u(k) WHERE length(word) >= 4), g0(place, value, note, ek) AS (VALUES {values(flat)}), "
        f"g AS (SELECT place, value, note, {clean.format('ek')} AS known FROM g0), a AS (SELECT ek, {clean.format('ek')} AS asked FROM q), h AS (SELECT a.ek, place, value, note FROM a JOIN g ON contains(known, asked) OR contains(asked, known)), "
        "b AS (SELECT ek, arg_min(value, place) AS value, arg_min(note, place) AS note FROM h GROUP BY ek) SELECT q.ek, value, note FROM q LEFT JOIN b ON b.ek = q.ek"
    )


_HELD = " OR ".join(f"contains({_FOLD.format(c)}, {_FOLD.format('low.word')})" for c in ("ek", "ornekler", "aciklama"))
ORACLES |= {
    "kb_word_search": f"WITH {_E}, {SQL_LOWER}, h AS (SELECT low.word, place, kod FROM low JOIN e ON upper(low.word) = kod OR {_HELD}) SELECT word, count(*) AS n, arg_min(kod, place) AS kod FROM h GROUP BY word",
    "kb_word_upos": _infer_words(D.UPOS),
    "kb_word_deprel": _infer_words(D.DEPREL),
}
