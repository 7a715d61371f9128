"""Morphological analysis of distinct words.

A word's analyses are paths in a graph: nodes are strings, edges strip one suffix from the end. Edges depend on the string
alone and are made once for each; a walk keeps a bit set of automaton states, so a step is a mask. Words are analysed once
each, partition by partition, and joined back to tokens by the caller. The search itself has caps and ties that no join
expresses, so it runs in Arrow batches; everything around it is Catalyst.

The dictionary goes to the executors as a set if it has at most MOST_WORDS words; a larger one is dealt out with the words by
their first letters (shards.py), with the same results. Without one, only the two heuristic strategies run and roots stay
null. Null words give no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phonology import BACK, CLOSE, CONSONANTS, ROUNDED, SONORANT_SIBILANT, UNROUNDED, VOICELESS, VOWELS
from . import shards, suffixes, tables
from .lexicon import BUFFERS, INSERTED, SOFTENED, WIDENED

MOST_WORDS = 5_000_000
DEPTH, QUEUE = 10, 200

# Groups of labels that decide between two readings of a suffix.
_TENSES = frozenset("GEÇMİŞ_ZAMAN DUYULAN_GEÇMİŞ GELECEK_ZAMAN ŞİMDİKİ_ZAMAN GENİŞ_ZAMAN GENİŞ_ZAMAN_OLMSZ".split())
_NOMINAL_AFTER_MA = frozenset(
    "İYELİK_1T İYELİK_2T TAMLAYAN İYELİK_3T İYELİK_3T/BELIRTME İYELİK_2T/TAMLAYAN İYELİK_1Ç İYELİK_2Ç İYELİK_3Ç ÇOĞUL KİŞİ_3Ç BULUNMA AYRILMA YÖNELME BELIRTME VASITA İLGİ_-ki YAPIM_-lI YAPIM_-sIz YAPIM_-lIk".split()
)
_VERBAL_AFTER_MA = _TENSES | frozenset(
    "SIFAT_FİİL SIFAT_FİİL_-DIk SIFAT_FİİL_-DIğ ZARF_FİİL_-ArAk ZARF_FİİL_-IncA ZARF_FİİL_-Ip EDİLGEN İŞTEŞ ETTİRGEN_-lAt YETERLİLİK DİLEK_ŞART BİLDİRME ETTİRGEN BİLDİRME/ETTİRGEN KİŞİ_2Ç KİŞİ_1Ç EMİR KİŞİ_2T EMİR/KİŞİ_2T EMİR_3Ç".split()
)
_BEFORE_PLURAL = _TENSES | frozenset("DİLEK_ŞART YETERLİLİK BİLDİRME ETTİRGEN BİLDİRME/ETTİRGEN OLUMSUZ".split())
_BEFORE_SIN = _TENSES - {"GEÇMİŞ_ZAMAN"}
_BEFORE_DIR = _TENSES | frozenset("DİLEK_ŞART YETERLİLİK ÇOĞUL KİŞİ_3Ç İYELİK_3T İYELİK_3T/BELIRTME İYELİK_1T İYELİK_2T/TAMLAYAN İYELİK_1Ç İYELİK_2Ç İYELİK_3Ç OLUMSUZ".split())
_POSSESSIVES = frozenset("İYELİK_1T İYELİK_2T İYELİK_3T İYELİK_2T/TAMLAYAN İYELİK_3T/BELIRTME İYELİK_1Ç İYELİK_2Ç İYELİK_3Ç".split())
_AFTER_POSSESSIVE = frozenset("BULUNMA AYRILMA YÖNELME BELIRTME TAMLAYAN VASITA İLGİ_-ki".split())
_NO_VERB_BONUS = frozenset("NOUN ADJ ADP CCONJ SCONJ INTJ".split())
_WIDER = {"ı": "a", "i": "e", "u": "oa", "ü": "öe"}
_HARD = {soft: hard for hard, softs in SOFTENED.items() for soft in softs}


def lower(text: str) -> str:
    """Each character in lower case by itself, so a final sigma is like any other."""
    text = text.replace("İ", "i").replace("I", "ı")
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def last_vowel(s: str) -> str | None:
    return next((c for c in reversed(s) if c in VOWELS), None)


def minor_ok(a: str | None, b: str | None) -> bool:
    if not a or not b:
        return True
    if a in UNROUNDED:
        return b in UNROUNDED
    return b in (ROUNDED if b in CLOSE else UNROUNDED)


def major_ok(a: str | None, b: str | None) -> bool:
    return not a or not b or (a in BACK) == (b in BACK)


def consonants_ok(stem: str, form: str) -> bool:
    if not stem or form[0] not in "dctç":
        return True
    return (form[0] in "tç") == (stem[-1] in VOICELESS)


def stem_ok(stem: str) -> bool:
    tail = len(stem) - len(stem.rstrip(CONSONANTS))
    return any(c in VOWELS for c in stem) and (tail < 2 or tail == 2 and stem[-2] in SONORANT_SIBILANT)


class Lexicon:
    """Membership, verbs and roots over a set of words; each root is looked up once."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(words)
        self.root = lru_cache(maxsize=500_000)(self._root)

    def __contains__(self, word: str) -> bool:
        return word.lower() in self.words

    def is_verb(self, stem: str) -> bool:
        s = stem.lower()
        return s + "mak" in self.words or s + "mek" in self.words

    def _sources(self, s: str):
        """Strings that may show up as s, in order, and whether a verb stem will do."""
        yield s, True
        if s and s[-1] in _HARD:
            yield s[:-1] + _HARD[s[-1]], True
        if len(s) > 1 and s[-1] in CONSONANTS and s[-2] in CONSONANTS and (v := INSERTED.get(last_vowel(s[:-2]))):
            yield s[:-1] + v + s[-1], False
        if len(s) > 1 and s[-1] in BUFFERS and s[-2] in VOWELS:
            yield s[:-1], True

    def _root(self, stem: str) -> str | None:
        s, words = stem.lower(), self.words
        if s in words or s + "mak" in words or s + "mek" in words:
            return s
        return next((x for x, verb in self._sources(s) if x in words or verb and self.is_verb(x)), None)

    def narrowed_root(self, stem: str) -> str | None:
        if (r := self.root(stem)) is None and stem and stem[-1] in WIDENED:
            r = self.root(stem[:-1] + WIDENED[stem[-1]])
        return r


@dataclass(frozen=True)
class Strategy:
    strict: bool
    least_stem: int | None = None
    in_dictionary: bool = False


HEURISTIC = (Strategy(True), Strategy(False, 3))
WITH_DICTIONARY = (Strategy(True, None, True), Strategy(False, 3, True), *HEURISTIC)


class Analyzer:
    """All analyses of a word, best first, as (stem, root, lemma, [(form, label)])."""

    def __init__(self, words: Iterable[str] | None = None, forms=None, strategies: tuple[Strategy, ...] | None = None):
        self.lexicon = Lexicon(words) if words is not None else None
        self.forms = {f: (label, least, exempt) for f, label, least, exempt in (suffixes.forms() if forms is None else forms)}
        self.longest = max(map(len, self.forms), default=0)
        self.vowel = {f: next((c for c in f if c in VOWELS), None) for f in self.forms}
        self.strategies = strategies or (HEURISTIC if words is None else WITH_DICTIONARY)
        self.forbidden: dict[str, set[str]] = {}
        for inner, outer in tables.FORBIDDEN:
            self.forbidden.setdefault(outer, set()).add(inner)
        self.tables = {k: tables.inverted(v) for k, v in (("pronoun", tables.PRONOUNS), ("aux", tables.AUXILIARIES), ("ordinal", tables.ORDINALS), ("post", tables.POSTPOSITIONS), ("verb", tables.VERB_STEMS))}
        self.edges = lru_cache(maxsize=200_000)(self._edges)

    # Edges: (stem, form, label, gate); an edge is closed where the label of its gate is forbidden.

    def _splits(self, cur: str) -> list[tuple]:
        """(stem, the form's least stem, whether backness agrees, edges) of each form that cur may end in, the longest first:
        what doesn't hang on a strategy is asked once for all of them."""
        out = []
        for k in range(min(self.longest, len(cur) - 1), 0, -1):
            form = cur[-k:]
            if (own := self.forms.get(form)) is None:
                continue
            stem, (label, least, exempt) = cur[:-k], own
            if not stem_ok(stem) or not consonants_ok(stem, form):
                continue
            a, b = last_vowel(stem), self.vowel[form]
            if not exempt and not minor_ok(a, b):
                continue
            edges = [(stem, form, label, label)]
            if self.lexicon and k > 1 and form[0] == "n" and label in tables.BUFFERED_BY_N and stem + "n" in self.lexicon and form[1:] in self.forms:
                edges.insert(0, (stem + "n", form[1:], self.forms[form[1:]][0], label))
            out.append((stem, least, exempt or major_ok(a, b), edges))
        return out

    def _tried(self, splits: list[tuple], way: Strategy):
        for stem, least, back, edges in splits:
            least = 2 if way.in_dictionary else max(least, way.least_stem or 0)
            if len(stem) >= least and (back or not way.strict) and not (way.in_dictionary and self.lexicon.root(stem) is None):
                yield from edges

    def _irregular_verb(self, stem: str) -> bool:
        base = self.tables["verb"].get(stem)
        return base is not None and self.lexicon.is_verb(base)

    def _edges(self, cur: str):
        """(edges, edges to take if none of the first is open)."""
        lex, splits = self.lexicon, self._splits(cur)
        if not splits:
            return [], []
        if lex is None or lex.root(cur) is None:
            return [e for way in self.strategies for e in self._tried(splits, way)], []
        first = [e for way in self.strategies if way.in_dictionary for e in self._tried(splits, way)]
        if cur not in lex and not lex.is_verb(cur):
            return first, []
        verbal = lambda e: e[2] in tables.VERBAL and (lex.is_verb(e[0]) or self._irregular_verb(e[0]))
        first = [e for e in first if verbal(e) or e[0] in lex]
        rest = [e for way in self.strategies if not way.in_dictionary for e in self._tried(splits, way) if e[2] in tables.VERBAL and self._irregular_verb(e[0])]
        return first, rest

    def _open(self, cur: str, outer: str | None):
        shut = self.forbidden.get(outer, ())
        for edges in self.edges(cur):
            if edges and (out := list(dict.fromkeys([e[:3] for e in edges if e[3] not in shut]))):
                return out
        return []

    def _variants(self, stem: str, label: str):
        """The stem, and what it may be without a buffer n or with its vowel wide again."""
        yield stem
        if label in ("BULUNMA", "AYRILMA") and len(stem) > 2 and stem[-1] == "n":
            yield stem[:-1]
        if label == "ŞİMDİKİ_ZAMAN" and len(stem) >= 2 and stem[-1] in _WIDER:
            before = stem[:-1]
            if not (len(before) >= 2 and before[-1] in CONSONANTS and self.lexicon and self.lexicon.is_verb(before)):
                yield from (before + v for v in _WIDER[stem[-1]])

    def paths(self, word: str, most: int) -> list[tuple[str, tuple]]:
        """Breadth first: (stem, suffixes from the stem out), in the order found, at most 5 * most and a bit."""
        if not self._open(word, None):  # most words of a text lose no suffix
            return [(word, ())]
        queue = deque([(word, (), suffixes.START)])
        visited, found = set(), {}
        while queue and len(found) < 5 * most and len(queue) <= QUEUE:
            state = queue.popleft()
            if state in visited:
                continue
            visited.add(state)
            cur, path, states = state
            edges = self._open(cur, path[0][1] if path else None) if len(path) < DEPTH else []
            if not edges or path or self.lexicon and cur in self.lexicon:
                found.setdefault((cur, path))
            for stem, form, label in edges:
                if after := suffixes.step(states, label):
                    for s in self._variants(stem, label):
                        queue.append((s, ((form, label), *path), after))
        return list(found)

    def score(self, stem: str, path: tuple, upos: str | None) -> float:
        s, lex = 0.0, self.lexicon
        if lex:
            word, verb = stem in lex, lex.is_verb(stem)
            if word or verb:
                s += 10
                final = any(part in tables.VERB_FINAL for _, label in path[-2:] for part in label.split("/"))
                if verb and (upos == "VERB" or upos not in _NO_VERB_BONUS and final):
                    s += 15
            elif (root := lex.root(stem)) is not None:
                s += 10 if root in lex else 8
        s += len(stem) * 0.5
        if len(stem) < 2:
            s -= 10
        s -= len(path) * 0.3
        if lex and len(stem) >= 3 and stem[-1] == "y" and stem[-2] in VOWELS and stem in lex and stem[:-1] in lex:
            s -= 2
        for (_, inner), (_, outer) in zip(path, path[1:], strict=False):
            if inner == "EMİR/KİŞİ_2T" and outer in tables.CASES:
                s -= 3
        return s

    def ranked(self, word: str, most: int, upos: str | None = None) -> list[tuple[str, tuple]]:
        found = self.paths(word, most)
        if len(found) == 1:
            return found
        order = sorted(found, key=lambda x: -self.score(*x, upos))
        if self.lexicon is None:
            return order[:most]
        good = [x for x in order if self.lexicon.root(x[0]) is not None or self._irregular_verb(x[0])]
        return good[:most] or order[:1]

    def _connected(self, stem: str, path: tuple) -> tuple[str, tuple]:
        """Moves the letter before -yor to where it belongs."""
        if not path or "ŞİMDİKİ_ZAMAN" not in path[0][1] or self.lexicon and self.lexicon.is_verb(stem):
            return stem, path
        form, before = path[0][0], stem[:-1]
        moved = None
        if form == "yor" and stem and stem[-1] in CLOSE:
            a = last_vowel(before)
            if len(before) >= 2 and a and before[-1] in CONSONANTS and major_ok(a, stem[-1]) and minor_ok(a, stem[-1]):
                moved = stem[-1]
        elif len(form) == 4 and form.endswith("yor") and form[0] in CLOSE and len(stem) >= 3 and stem[-1] in CONSONANTS and stem[-2] in CONSONANTS and last_vowel(before):
            moved = stem[-1]
        return (before, ((moved + form, "ŞİMDİKİ_ZAMAN"), *path[1:])) if moved else (stem, path)

    @staticmethod
    def _read(path: tuple) -> tuple:
        """One label for suffixes that have two, from the one chosen before and the one after."""
        out: list[tuple[str, str]] = []
        for k, (form, label) in enumerate(path):
            before, after = out[-1][1] if out else None, path[k + 1][1] if k + 1 < len(path) else None
            match label:
                case "OLUMSUZ/İSİM_FİİL":
                    label = "İSİM_FİİL_-mA" if after in _NOMINAL_AFTER_MA else "OLUMSUZ" if after in _VERBAL_AFTER_MA else label
                case "ÇOĞUL":
                    label = "KİŞİ_3Ç" if before in _BEFORE_PLURAL else label
                case "EMİR/KİŞİ_2T":
                    label = "KİŞİ_2T" if before in _BEFORE_SIN else "EMİR" if before in (None, "OLUMSUZ", "OLUMSUZ/İSİM_FİİL", "İSİM_FİİL_-mA", "YETERLİLİK") else label
                case "BİLDİRME/ETTİRGEN":
                    label = "BİLDİRME" if before in _BEFORE_DIR or before is None and after is None else "ETTİRGEN" if before is None else label
                case "İYELİK_3T/BELIRTME":
                    label = "BELIRTME" if before in _POSSESSIVES else "İYELİK_3T" if after in _AFTER_POSSESSIVE else label
                case "İYELİK_2T/TAMLAYAN":
                    label = "TAMLAYAN" if before in _POSSESSIVES else "İYELİK_2T" if after in _AFTER_POSSESSIVE else label
            out.append((form, label))
        return tuple(out)

    def underived(self, verb: str) -> str | None:
        """The verb that a derived verb comes from, through up to five endings."""
        cur = verb
        for _ in range(5):
            if cur in tables.OWN_VERBS:
                break
            ends = (e for e in tables.VERB_ENDINGS if cur.endswith(e) and len(cur) - len(e) >= 2 and not (e[-1] == "ş" and cur in tables.OWN_RECIPROCALS))
            nxt = next((r for e in ends if (r := self.lexicon.root(cur[: -len(e)])) is not None and self.lexicon.is_verb(r)), None)
            if nxt is None:
                break
            cur = nxt
        return cur if cur != verb else None

    def rooted(self, stem: str, path: tuple, upos: str | None) -> tuple[str | None, str | None]:
        """(root, lemma); what doesn't differ from the stem is null."""
        lex = self.lexicon
        if lex is None:
            return None, None
        root = lex.root(stem)
        if root is None and path and "yor" in path[0][0] and (r := lex.narrowed_root(stem)) != stem:
            root = r
        if root is None:
            root = self.tables["verb"].get(stem)
        base, lemma = root if root is not None else stem, None
        if lex.is_verb(base):
            if upos == "VERB" and (bare := self.underived(base)) is not None:
                return bare, base
            if base not in lex or stem in self.tables["verb"]:
                lemma = next(base + e for e in ("mak", "mek") if base + e in lex)
        return (root if root != stem else None), lemma

    def finished(self, paths, upos: str | None, most: int):
        out, seen = [], set()
        for stem, path in paths:
            if path:
                stem, path = self._connected(stem, path)
                path = self._read(path)
            root, lemma = self.rooted(stem, path, upos)
            if upos == "VERB":
                root = self.tables["verb"].get(root or stem, root)
            key = (root or stem, lemma, tuple(label for _, label in path))
            if key not in seen:
                seen.add(key)
                out.append((stem, root, lemma, path))
            if len(out) >= most:
                break
        return out

    def fixed(self, word: str, upos: str | None) -> tuple | None:
        """The single analysis of words that tables decide."""
        t = self.tables
        if upos == "AUX" and word in t["aux"] or upos == "VERB" and t["aux"].get(word) == "değil":
            return word, t["aux"][word], None, ()
        if upos in ("CCONJ", "INTJ"):
            return word, None, None, ()
        for name, tags in (("ordinal", ("NUM", "ADJ")), ("post", ("NOUN", "NUM"))):
            if upos in tags and word in t[name]:
                return word, t[name][word], None, ()
        return (word, t["pronoun"][word], None, ()) if word in t["pronoun"] else None

    def analyses(self, word: str, upos: str | None = None, most: int = 5):
        plain = word.strip()
        low = lower(plain)
        if one := self.fixed(low, upos):
            return [one]
        mark = next((m for m in "’'" if m in plain), None)
        if mark:
            head, _, tail = plain.partition(mark)
            if head and tail:
                base, end = lower(head), lower(tail)
                if head[0].isupper() and end in self.forms:
                    paths = [(base, ((end, self.forms[end][0]),))]
                else:
                    paths = self.ranked(base + end, most, upos)
                return self.finished(paths, upos, most) or [(base, None, None, ())]
            low = low.replace(mark, "")
        return self.finished(self.ranked(low, most, upos), upos, most) or [(low, None, None, ())]


SCHEMA = "word string, upos string, rank int, stem string, root string, lemma string, suffixes array<struct<form:string,label:string>>"
_SUFFIXES = pa.list_(pa.struct([("form", pa.string()), ("label", pa.string())]))


_HELD: dict = {}


def held(shared, make):
    """make(the broadcast value), kept by a worker process for its later tasks with the same broadcast."""
    key, value = make.__code__, shared.value
    if _HELD.get(key, (None,))[0] is not value:
        _HELD.clear()
        _HELD[key] = value, make(value)
    return _HELD[key][1]


def analyze(words: DataFrame, dictionary: DataFrame | None = None, most: int = 5, forms=None, strategies=None) -> DataFrame:
    """(word, upos, rank, stem, root, lemma, suffixes) of each distinct word; rank 1 is best. upos may be missing or null.

    dictionary: a DataFrame with the column word.
    """
    spark = words.sparkSession
    rows = words if "upos" in words.columns else words.withColumn("upos", F.lit(None).cast("string"))
    rows = rows.select("word", "upos").filter(F.col("word").isNotNull()).distinct()
    try:
        known = shards.words_of(dictionary, MOST_WORDS)
    except shards.TooManyWords:
        asked = shards.keyed(rows, lambda w: [("analyses", searched(w))])
        return shards.over_shards(asked, [dictionary], MOST_WORDS, lambda sets: Analyzer(sets[0], forms, strategies), lambda own, rows: _analysed(own, rows, most), SCHEMA)
    shared = spark.sparkContext.broadcast((known, forms, strategies))
    # Distinct words are few bytes but much work: adaptive execution would put them in one task.
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches):
        own = held(shared, lambda value: Analyzer(*value))
        for b in batches:
            yield _analysed(own, zip(b.column("word").to_pylist(), b.column("upos").to_pylist(), strict=True), most)

    return rows.repartition(many, "word", "upos").mapInArrow(run, SCHEMA)


def searched(word: str) -> str:
    """What the search begins with: the word in lower case, without its apostrophe."""
    plain = word.strip()
    mark = next((m for m in "’'" if m in plain), None)
    if mark is None:
        return lower(plain)
    head, _, tail = plain.partition(mark)
    return lower(head) + lower(tail) if head and tail else lower(plain).replace(mark, "")


def _analysed(own: Analyzer, words, most: int) -> pa.RecordBatch:
    out = {k: [] for k in ("word", "upos", "rank", "stem", "root", "lemma", "suffixes")}
    for word, upos, *_ in words:
        for rank, (stem, root, lemma, path) in enumerate(own.analyses(word, upos, most), 1):
            for k, v in zip(out, (word, upos, rank, stem, root, lemma, [{"form": f, "label": x} for f, x in path]), strict=True):
                out[k].append(v)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), _SUFFIXES]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def analyze_tokens(tokens: DataFrame, dictionary: DataFrame | None = None, most: int = 5) -> DataFrame:
    """tokens (..., word) with their analyses as an array, best first; each distinct word is analysed once."""
    per_word = analyze(tokens.select("word"), dictionary, most).groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "stem", "root", "lemma", "suffixes"))), lambda x: F.struct(x["stem"].alias("stem"), x["root"].alias("root"), x["lemma"].alias("lemma"), x["suffixes"].alias("suffixes"))).alias("analyses"))
    return tokens.join(per_word, "word", "left")
