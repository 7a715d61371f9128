"""DuckDB SQL of word analysis: the search as a recursive query over strings, its caps by running sums afterwards."""

from __future__ import annotations

from ..functions.phonology import CONSONANTS, SONORANT_SIBILANT
from ..operators import analyzer as A
from ..operators import suffixes, tables
from ..operators import wordclasses as C
from .base import SQL_FIRST, SQL_LAST, V, sql_consonant, sql_major, sql_minor, values
from .dimension import _FORMS


def _set(labels) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(labels)) + ")"


#: What a label is read as, from the one chosen before it and the one after.
_READ = f"""CASE WHEN y.l = 'OLUMSUZ/İSİM_FİİL' THEN CASE WHEN y.a IN {_set(A._NOMINAL_AFTER_MA)} THEN 'İSİM_FİİL_-mA' WHEN y.a IN {_set(A._VERBAL_AFTER_MA)} THEN 'OLUMSUZ' ELSE y.l END
 WHEN y.l = 'ÇOĞUL' THEN CASE WHEN x.o[-1] IN {_set(A._BEFORE_PLURAL)} THEN 'KİŞİ_3Ç' ELSE y.l END
 WHEN y.l = 'EMİR/KİŞİ_2T' THEN CASE WHEN x.o[-1] IN {_set(A._BEFORE_SIN)} THEN 'KİŞİ_2T' WHEN len(x.o) = 0 OR x.o[-1] IN ('OLUMSUZ', 'OLUMSUZ/İSİM_FİİL', 'İSİM_FİİL_-mA', 'YETERLİLİK') THEN 'EMİR' ELSE y.l END
 WHEN y.l = 'BİLDİRME/ETTİRGEN' THEN CASE WHEN x.o[-1] IN {_set(A._BEFORE_DIR)} OR len(x.o) = 0 AND y.a IS NULL THEN 'BİLDİRME' WHEN len(x.o) = 0 THEN 'ETTİRGEN' ELSE y.l END
 WHEN y.l = 'İYELİK_3T/BELIRTME' THEN CASE WHEN x.o[-1] IN {_set(A._POSSESSIVES)} THEN 'BELIRTME' WHEN y.a IN {_set(A._AFTER_POSSESSIVE)} THEN 'İYELİK_3T' ELSE y.l END
 WHEN y.l = 'İYELİK_2T/TAMLAYAN' THEN CASE WHEN x.o[-1] IN {_set(A._POSSESSIVES)} THEN 'TAMLAYAN' WHEN y.a IN {_set(A._AFTER_POSSESSIVE)} THEN 'İYELİK_2T' ELSE y.l END ELSE y.l END"""

_MOVES = values((label, suffixes.FROM[s], suffixes.BIT[s]) for label, slots in suffixes.SLOTS_OF.items() for s in slots)
_VERBS = tables.inverted(tables.VERB_STEMS)
_LABEL = "list_transform(path, lambda x: x.l)"


def analyses(dictionary: str, probes, lexicon: bool, most: int = 5) -> str:
    """CTEs up to out(word, rank, stem, root, lemma, suffixes, fs, ls). dictionary: CTEs with words, dict, verbs and roots; probes: the
    function that makes CTEs with the root of each string."""
    known = "true" if lexicon else "false"
    ways = [(True, None, True), (False, None, True)] if lexicon else []
    ways += [(True, 0, False), (False, 3, False)]
    tried = []
    for w, (strict, least, by_dict) in enumerate(ways):
        fits = f"({'strict' if strict else 'soft'})" + (" AND length(stem) >= 2 AND stem IN (SELECT x FROM rooted)" if by_dict else f" AND length(stem) >= greatest(min_stem, {least})")
        tried.append(f"SELECT x, {by_dict} AS known, {w * 1000} + (6 - k) * 2 + 1 AS place, stem, form, label, label AS gate FROM hit WHERE {fits}")
        if lexicon:
            alt = f"k > 1 AND form LIKE 'n%' AND label IN {_set(tables.BUFFERED_BY_N)} AND stem || 'n' IN (SELECT word FROM dict)"
            tried.append(f"SELECT hit.x, {by_dict}, {w * 1000} + (6 - k) * 2, stem || 'n', f.form, f.label, hit.label FROM (SELECT * FROM hit WHERE {fits} AND {alt}) hit JOIN forms f ON f.form = substr(hit.form, 2)")
    verb_values = values(sorted(_VERBS.items()))
    pronouns = values(sorted(tables.inverted(tables.PRONOUNS).items()))
    return f"""WITH RECURSIVE {_FORMS}, {dictionary},
pron(low, pr) AS (VALUES {pronouns}), odd(st, base) AS (VALUES {verb_values}), moves(label, fr, bit) AS (VALUES {_MOVES}), bans(inner_, outer_) AS (VALUES {values(tables.FORBIDDEN)}),
q0 AS (SELECT word, lower(translate(word, 'İI', 'iı')) AS low, CASE WHEN contains(word, '’') THEN '’' WHEN contains(word, '''') THEN '''' END AS mark FROM words),
q1 AS (SELECT *, left(word, strpos(word, mark) - 1) AS head, substr(word, strpos(word, mark) + 1) AS tail FROM q0),
q2 AS (SELECT *, mark IS NOT NULL AND head <> '' AND tail <> '' AS parts, lower(translate(head, 'İI', 'iı')) AS base, lower(translate(tail, 'İI', 'iı')) AS ending FROM q1),
q3 AS (SELECT word, low, CASE WHEN parts THEN base || ending WHEN mark IS NOT NULL THEN replace(low, mark, '') ELSE low END AS w, parts, base, ending, regexp_matches(head, '^\\p{{Lu}}') AS big FROM q2),
q AS (SELECT q3.*, pr, pron.low IS NOT NULL AS fixed, CASE WHEN parts AND big THEN f.label END AS plabel FROM q3 LEFT JOIN pron ON pron.low = q3.low LEFT JOIN forms f ON f.form = q3.ending),
ws AS (SELECT DISTINCT w FROM q WHERE NOT fixed),
cuts AS (SELECT DISTINCT left(w, i) AS x FROM ws, unnest(range(1, length(w) + 1)) AS u(i)),
xs AS (SELECT x FROM cuts UNION SELECT left(x, length(x) - 1) || v FROM cuts, (VALUES ('ı', 'a'), ('i', 'e'), ('u', 'o'), ('u', 'a'), ('ü', 'ö'), ('ü', 'e')) AS t(c, v) WHERE length(x) > 1 AND right(x, 1) = c),
src AS (SELECT x AS s FROM xs), {probes('pr_', 'src')},
rooted AS (SELECT s AS x, root FROM pr_ WHERE root IS NOT NULL),
cut AS (SELECT x, k, left(x, length(x) - k) AS stem, right(x, k) AS form FROM xs, unnest(range(1, 7)) AS u(k) WHERE length(x) > k),
hit0 AS (SELECT cut.*, label, min_stem, exempt, {SQL_LAST.format(w='stem')} AS a, {SQL_FIRST.format(w='form')} AS b FROM cut JOIN forms USING (form)
  WHERE regexp_matches(stem, '[{V}]') AND NOT regexp_matches(stem, '[{CONSONANTS}]{{3}}$') AND (NOT regexp_matches(stem, '[{CONSONANTS}]{{2}}$') OR contains('{SONORANT_SIBILANT}', stem[-2]))),
hit AS (SELECT * FROM (SELECT *, exempt OR {sql_minor('a', 'b')} AS soft, exempt OR ({sql_minor('a', 'b')} AND {sql_major('a', 'b')}) AS strict FROM hit0 WHERE {sql_consonant('stem', 'form')}) WHERE soft),
tried AS ({' UNION ALL '.join(tried)}),
flags AS (SELECT x, x IN (SELECT x FROM rooted) AS r, x IN (SELECT word FROM dict) OR x IN (SELECT root FROM verbs) AS inside FROM xs),
judged AS (SELECT t.*, f.r, f.inside, t.label IN {_set(tables.VERBAL)} AS verbal, stem IN (SELECT st FROM odd WHERE base IN (SELECT root FROM verbs)) AS so,
  stem IN (SELECT word FROM dict) AS si, stem IN (SELECT root FROM verbs) AS sv FROM tried t JOIN flags f USING (x)),
edges AS (SELECT x, tier, place, stem, form, label, gate, (SELECT list(struct_pack(fr := fr, bit := bit)) FROM moves m WHERE m.label = e.label) AS mv FROM (
  SELECT *, 0 AS tier FROM judged WHERE NOT {known} OR NOT r OR known AND (NOT inside OR si OR verbal AND (sv OR so))
  UNION ALL SELECT *, 1 FROM judged WHERE {known} AND r AND inside AND NOT known AND verbal AND so) e),
vars AS (SELECT DISTINCT stem, label FROM edges),
variants AS (SELECT stem, label, list_concat(list_concat([stem], CASE WHEN label IN ('BULUNMA', 'AYRILMA') AND length(stem) > 2 AND right(stem, 1) = 'n' THEN [left(stem, length(stem) - 1)] ELSE [] END),
  CASE WHEN label = 'ŞİMDİKİ_ZAMAN' AND length(stem) >= 2 AND NOT (length(stem) >= 3 AND regexp_matches(stem, '[{CONSONANTS}].$') AND left(stem, length(stem) - 1) IN (SELECT root FROM verbs))
    THEN list_transform(CASE right(stem, 1) WHEN 'ı' THEN ['a'] WHEN 'i' THEN ['e'] WHEN 'u' THEN ['o', 'a'] WHEN 'ü' THEN ['ö', 'e'] ELSE [] END, lambda v: left(stem, length(stem) - 1) || v) ELSE [] END) AS vs FROM vars),
state(w, lvl, pos, up, cur, path, states) AS (SELECT w, 0, CAST(1 AS BIGINT), CAST(0 AS BIGINT), w, CAST([] AS STRUCT(f VARCHAR, l VARCHAR)[]), {suffixes.START} FROM ws
  UNION ALL SELECT w, lvl + 1, row_number() OVER (PARTITION BY w ORDER BY pos, place, vi), pos, vs[vi], list_concat([struct_pack(f := form, l := label)], path), after FROM (
    SELECT o.*, v.vs, u.vi, CASE WHEN mv IS NULL THEN states ELSE CAST(list_sum(list_transform(mv, lambda m: CASE WHEN states & m.fr <> 0 THEN m.bit ELSE 0 END)) AS INTEGER) END AS after FROM (
      SELECT w, lvl, pos, path, states, stem, form, label, mv, min(place) AS place FROM (
        SELECT p.*, e.*, min(e.tier) OVER (PARTITION BY p.w, p.pos) AS low FROM (SELECT *, row_number() OVER (PARTITION BY w, cur, path ORDER BY pos) AS nth FROM state WHERE lvl < 10) p JOIN edges e ON e.x = p.cur
        WHERE nth = 1 AND NOT (len(path) > 0 AND EXISTS (SELECT 1 FROM bans WHERE inner_ = e.gate AND outer_ = p.path[1].l)))
      WHERE tier = low GROUP BY w, lvl, pos, path, states, stem, form, label, mv) o JOIN variants v ON v.stem = o.stem AND v.label = o.label, unnest(range(1, len(v.vs) + 1)) AS u(vi)) WHERE after <> 0),
kids AS (SELECT w, lvl - 1 AS lvl, up AS pos, count(*) AS n FROM state WHERE lvl > 0 GROUP BY ALL),
run AS (SELECT s.*, coalesce(k.n, 0) AS n, row_number() OVER (PARTITION BY s.w, s.cur, s.path ORDER BY s.lvl, s.pos) > 1 AS dup FROM state s LEFT JOIN kids k USING (w, lvl, pos)),
run1 AS (SELECT *, NOT dup AND (lvl > 0 OR cur NOT IN (SELECT x FROM edges) OR cur IN (SELECT word FROM dict)) AS found, row_number() OVER b - 1 AS i, coalesce(sum(n) OVER (PARTITION BY w ORDER BY lvl, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pushed FROM run WINDOW b AS (PARTITION BY w ORDER BY lvl, pos)),
run2 AS (SELECT *, 1 + pushed - i > {A.QUEUE} OR coalesce(sum(CAST(found AS INT)) OVER (PARTITION BY w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {5 * most} AS beyond FROM run1),
got AS (SELECT w, i, cur AS stem, path FROM (SELECT *, bool_or(beyond) OVER (PARTITION BY w ORDER BY i) AS ended FROM run2) WHERE found AND NOT ended),
scored AS (SELECT *, CAST(CASE WHEN si OR sv THEN CASE WHEN sv AND len(list_filter(list_transform(path[greatest(len(path) - 1, 1):], lambda p: len(list_filter(string_split(p.l, '/'), lambda t: t IN {_set(tables.VERB_FINAL)})) > 0), lambda t: t)) > 0 THEN 25 ELSE 10 END
    WHEN root IS NOT NULL THEN CASE WHEN root IN (SELECT word FROM dict) THEN 10 ELSE 8 END ELSE 0 END AS DOUBLE)
  + length(stem) * CAST(0.5 AS DOUBLE) - CASE WHEN length(stem) < 2 THEN 10 ELSE 0 END - len(path) * CAST(0.3 AS DOUBLE) - CASE WHEN length(stem) >= 3 AND regexp_matches(stem, '[{V}]y$') AND si AND left(stem, length(stem) - 1) IN (SELECT word FROM dict) THEN 2 ELSE 0 END
  - 3 * len(list_filter(range(1, len(path)), lambda j: path[j].l = 'EMİR/KİŞİ_2T' AND path[j + 1].l IN {_set(tables.CASES)})) AS score,
  root IS NOT NULL OR stem IN (SELECT st FROM odd WHERE base IN (SELECT root FROM verbs)) AS good
  FROM (SELECT got.*, root, stem IN (SELECT word FROM dict) AS si, stem IN (SELECT root FROM verbs) AS sv FROM got LEFT JOIN rooted ON rooted.x = got.stem)),
placed AS (SELECT *, row_number() OVER (PARTITION BY w, good ORDER BY score DESC, i) AS of_kind, row_number() OVER (PARTITION BY w ORDER BY score DESC, i) AS of_all, bool_or(good) OVER (PARTITION BY w) AS any_good FROM scored),
best AS (SELECT w, {'of_kind' if lexicon else 'of_all'} AS place, stem, path FROM placed WHERE {f'good AND of_kind <= {most} OR NOT any_good AND of_all = 1' if lexicon else f'of_all <= {most}'}),
each_ AS (SELECT q.word, place, stem, path FROM q JOIN best USING (w) WHERE NOT fixed AND plabel IS NULL UNION ALL SELECT word, 1, base, [struct_pack(f := ending, l := plabel)] FROM q WHERE NOT fixed AND plabel IS NOT NULL),
yor AS (SELECT *, left(stem, length(stem) - 1) AS before, right(stem, 1) AS c, {SQL_LAST.format(w='left(stem, length(stem) - 1)')} AS a FROM each_),
yor1 AS (SELECT *, contains(coalesce(path[1].l, ''), 'ŞİMDİKİ_ZAMAN') AND stem NOT IN (SELECT root FROM verbs) AND coalesce(
  path[1].f = 'yor' AND contains('ıiuüîû', c) AND length(before) >= 2 AND a IS NOT NULL AND regexp_matches(before, '[{CONSONANTS}]$') AND {sql_major('a', 'c')} AND {sql_minor('a', 'c')}
  OR regexp_matches(path[1].f, '^[ıiuüîû]yor$') AND length(stem) >= 3 AND regexp_matches(stem, '[{CONSONANTS}]{{2}}$') AND a IS NOT NULL, false) AS moves FROM yor),
moved AS (SELECT word, place, CASE WHEN moves THEN before ELSE stem END AS stem, CASE WHEN moves THEN list_concat([struct_pack(f := c || path[1].f, l := 'ŞİMDİKİ_ZAMAN')], path[2:]) ELSE path END AS path FROM yor1),
read_ AS (SELECT word, place, stem, path, list_reduce(list_transform(range(1, len(path) + 1), lambda j: struct_pack(o := CAST([] AS VARCHAR[]), l := path[j].l, a := path[j + 1].l)),
  lambda x, y: struct_pack(o := list_append(x.o, {_READ}), l := CAST(NULL AS VARCHAR), a := CAST(NULL AS VARCHAR)), struct_pack(o := CAST([] AS VARCHAR[]), l := CAST(NULL AS VARCHAR), a := CAST(NULL AS VARCHAR))).o AS labels FROM moved),
roots1 AS (SELECT d.*, r1.root AS own, CASE WHEN contains(coalesce(path[1].f, ''), 'yor') THEN r2.root END AS wide, base FROM read_ d LEFT JOIN rooted r1 ON r1.x = stem
  LEFT JOIN rooted r2 ON r2.x = left(stem, length(stem) - 1) || translate(right(stem, 1), 'ıiuü', 'aeoö') AND contains('ıiuü', right(stem, 1)) LEFT JOIN odd ON st = stem),
roots2 AS (SELECT *, CASE WHEN {known} THEN coalesce(own, CASE WHEN wide <> stem THEN wide END, base) END AS r FROM roots1),
roots3 AS (SELECT word, place, stem, CASE WHEN r <> stem THEN r END AS root, CASE WHEN r IN (SELECT root FROM verbs) AND (r NOT IN (SELECT word FROM dict) OR base IS NOT NULL) THEN r || CASE WHEN r || 'mak' IN (SELECT word FROM dict) THEN 'mak' ELSE 'mek' END END AS lemma, path, labels FROM roots2),
once AS (SELECT *, row_number() OVER (PARTITION BY word, coalesce(root, stem), lemma, labels ORDER BY place) AS nth FROM roots3),
out_ AS (SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY place) AS INTEGER) AS rank, stem, root, lemma, array_to_string(list_transform(range(1, len(path) + 1), lambda j: path[j].f || '/' || labels[j]), '+') AS suffixes, list_transform(path, lambda x: x.f) AS fs, labels AS ls FROM once WHERE nth = 1),
out AS (SELECT * FROM out_ UNION ALL SELECT word, 1, low, pr, NULL, '', [], [] FROM q WHERE fixed
  UNION ALL SELECT word, 1, CASE WHEN parts THEN base ELSE w END, NULL, NULL, '', [], [] FROM q WHERE NOT fixed AND word NOT IN (SELECT word FROM out_))
"""


def rereading() -> str:
    """CTEs up to walk(sent_id, id, form, c, stem, suffixes, parts, fin, tail, n, applied): from left to right the candidate that
    each word of said(sent_id, id, form) takes, out of those in out."""
    near = {k: _set(C.words(v)) for k, v in (("det", C.DETERMINERS), ("adj", C.NEAR_ADJECTIVES), ("post", C.NEAR_POSTPOSITIONS), ("num", C.NEAR_NUMERALS), ("conj", C.NEAR_CONJUNCTIONS))}
    poss, conv, final = ("[" + ", ".join(f"'{x}'" for x in sorted(v)) + "]" for v in (C.words(C.POSSESSIVES), C.words(C.CONVERBS), tables.VERB_FINAL))
    split = "CAST(flatten(list_transform({}, lambda y: string_split(y, '/'))) AS VARCHAR[])"
    own = f"list_has_any(c.parts, {poss})"
    had = lambda x: f"list_contains(r.parts, '{x}')"
    rules = [  # name, condition, what is added to final verbs, to others; or to those of a test
        ("BELİRLEYİCİ→İSİM", f"before IN {near['det']}", -4, 3),
        ("SIFAT→İSİM", f"before NOT IN {near['det']} AND before IN {near['adj']}", 0, 0.5),
        ("SIFATSAL→İSİM", f"before NOT IN {near['det']} AND before NOT IN {near['adj']} AND contains(r.tail, 'SIFAT_FİİL')", 0, 0.3),
        ("ARDIŞIK_FİİL↓", f"r.fin AND before NOT IN {near['conj']}", -3, 0),
        ("TAMLAYAN→İYELİK", "contains(r.tail, 'TAMLAYAN')", own, 3),
        ("X→EDAT:İSİM", f"after IN {near['post']}", -1.5, 2),
        ("X→SORU:FİİL", "after IN ('mi', 'mı', 'mu', 'mü')", 2, 0),
        ("SAYI→İSİM", f"before IN {near['num']}", -1.5, 2),
        ("ZARF_FİİL→FİİL", f"list_has_any(r.parts, {conv})", 2, 0),
        ("İSİM_FİİL→İSİM", had("İSİM_FİİL"), 0, 1.5),
        ("YÖNELME→FİİL", had("YÖNELME"), 1, 0),
        ("DEYİM:ele_al", "cur = 'ele' AND starts_with(after, 'al')", "c.stem = 'el' AND list_contains(c.parts, 'YÖNELME')", 3),
        ("DEYİM:göz_kalıp", "cur = 'göz' AND (starts_with(after, 'önün') OR starts_with(after, 'ardı'))", 0, 2),
        ("BELİRTME→FİİL", had("BELIRTME"), 1.5, 0),
        ("İYELİK_ZİNCİR", f"list_has_any(r.parts, {poss})", f"({own} OR contains(c.tail, 'TAMLAYAN'))", 1),
        ("CÜMLE_SONU→FİİL", "last", 1, 0),
        ("CÜMLE_BAŞI→İSİM", "first", 0, 0.5),
    ]
    adds = " ".join(f"+ CASE WHEN {on} THEN CASE WHEN {a if isinstance(a, str) else 'c.fin'} THEN {b if isinstance(a, str) else a} ELSE {0 if isinstance(a, str) else b} END ELSE 0 END" for _, on, a, b in rules)
    names = ", ".join(f"CASE WHEN {on} THEN '{name}' END" for name, on, _, _ in rules)
    return f"""around AS MATERIALIZED (SELECT sent_id, id, form, lower(translate(form, 'İI', 'iı')) AS cur FROM said),
around1 AS MATERIALIZED (SELECT *, coalesce(lag(cur) OVER w, '') AS before, coalesce(lead(cur) OVER w, '') AS after, lag(id) OVER w IS NULL AS first, lead(id) OVER w IS NULL AS last FROM around WINDOW w AS (PARTITION BY sent_id ORDER BY id)),
c AS MATERIALIZED (SELECT a.*, rank - 1 AS c, stem, suffixes, {split.format('ls')} AS parts, list_has_any({split.format('ls[-2:]')}, {final}) AS fin, coalesce(ls[-1], '') AS tail, count(*) OVER (PARTITION BY sent_id, id) AS n FROM around1 a JOIN out ON out.word = a.form),
walk AS (SELECT DISTINCT sent_id, 0 AS id, '' AS form, 0 AS c, '' AS stem, '' AS suffixes, CAST([] AS VARCHAR[]) AS parts, false AS fin, '' AS tail, CAST(0 AS BIGINT) AS n, '' AS applied FROM said
  UNION ALL SELECT sent_id, id, form, c, stem, suffixes, parts, fin, tail, n, applied FROM (
    SELECT c.sent_id, c.id, c.form, c.c, c.stem, c.suffixes, c.parts, c.fin, c.tail, c.n, CASE WHEN c.n < 2 THEN '' ELSE array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ' ') END AS applied,
      row_number() OVER (PARTITION BY c.sent_id ORDER BY CASE WHEN c.n < 2 THEN 0 ELSE -c.c {adds} END DESC, c.c) AS best
    FROM walk r JOIN c ON c.sent_id = r.sent_id AND c.id = r.id + 1) WHERE best = 1)"""
