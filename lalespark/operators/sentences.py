"""Analyses of words chosen in the context of their sentence.

Each rule looks at the neighbours and adds to the scores of a word's candidates: one amount to those that end as a finite
verb, one to the rest. The choice runs from left to right, as it reads the choice before; a stable sort keeps ties in their
order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import tables
from . import wordclasses as C
from .analyzer import Analyzer, lower

TOKEN = re.compile(r"[\w'’]+")

_DET, _ADJ, _POST, _NUM, _CONJ = (C.words(x) for x in (C.DETERMINERS, C.NEAR_ADJECTIVES, C.NEAR_POSTPOSITIONS, C.NEAR_NUMERALS, C.NEAR_CONJUNCTIONS))
_POSS, _CONVERBS = C.words(C.POSSESSIVES), C.words(C.CONVERBS)


@dataclass
class Word:
    """A token with its chosen analysis (stem, root, lemma, suffixes), the next best ones, and the rules that applied."""

    form: str
    analysis: tuple
    others: list[tuple] = field(default_factory=list)
    applied: list[str] = field(default_factory=list)


def parts(analysis: tuple) -> list[str]:
    return [p for _, label in analysis[3] for p in label.split("/")]


def is_final(analysis: tuple) -> bool:
    return any(p in tables.VERB_FINAL for _, label in analysis[3][-2:] for p in label.split("/"))


def _bonuses(left: Word | None, before: str, cur: str, after: str, first: bool, last: bool):
    """(name, to finite verbs, to others, to candidates that a test picks, the test) of each rule that applies."""
    end = left.analysis[3][-1][1] if left and left.analysis[3] else ""
    had = set(parts(left.analysis)) if left else set()
    if before in _DET:
        yield "BELİRLEYİCİ→İSİM", -4, 3
    elif before in _ADJ:
        yield "SIFAT→İSİM", 0, 0.5
    elif "SIFAT_FİİL" in end:
        yield "SIFATSAL→İSİM", 0, 0.3
    if left and is_final(left.analysis) and not (before in _CONJ and not first):
        yield "ARDIŞIK_FİİL↓", -3, 0
    if "TAMLAYAN" in end:
        yield "TAMLAYAN→İYELİK", 3, lambda a: not _POSS.isdisjoint(parts(a))
    if after in _POST:
        yield "X→EDAT:İSİM", -1.5, 2
    if after in ("mi", "mı", "mu", "mü"):
        yield "X→SORU:FİİL", 2, 0
    if before in _NUM:
        yield "SAYI→İSİM", -1.5, 2
    if not _CONVERBS.isdisjoint(had):
        yield "ZARF_FİİL→FİİL", 2, 0
    if "İSİM_FİİL" in had:
        yield "İSİM_FİİL→İSİM", 0, 1.5
    if "YÖNELME" in had:
        yield "YÖNELME→FİİL", 1, 0
    if cur == "ele" and after.startswith("al"):
        yield "DEYİM:ele_al", 3, lambda a: a[0] == "el" and "YÖNELME" in parts(a)
    if cur == "göz" and after.startswith(("önün", "ardı")):
        yield "DEYİM:göz_kalıp", 0, 2
    if "BELIRTME" in had:
        yield "BELİRTME→FİİL", 1.5, 0
    if not _POSS.isdisjoint(had):
        yield "İYELİK_ZİNCİR", 1, lambda a: not _POSS.isdisjoint(parts(a)) or bool(a[3]) and "TAMLAYAN" in a[3][-1][1]
    if last:
        yield "CÜMLE_SONU→FİİL", 1, 0
    if first:
        yield "CÜMLE_BAŞI→İSİM", 0, 0.5


def choose(candidates: list[tuple], left: Word | None, forms: list[str], k: int) -> tuple[list[tuple], list[str]]:
    """The candidates in their new order, and the names of the rules that applied."""
    if len(candidates) < 2:
        return candidates, []
    second = k >= 2
    scores, applied = [-float(j) for j in range(len(candidates))], []
    rules = _bonuses(left, forms[k - 1] if k else "", forms[k], forms[k + 1] if k + 1 < len(forms) else "", k == 0, k + 1 == len(forms))
    for name, a, b in rules:
        if name == "ARDIŞIK_FİİL↓" and second and forms[k - 1] in _CONJ:
            continue
        applied.append(name)
        for j, c in enumerate(candidates):
            scores[j] += (a if b(c) else 0.0) if callable(b) else a if is_final(c) else b
    return [candidates[j] for j in sorted(range(len(candidates)), key=lambda j: -scores[j])], applied


class SentenceReader:
    """Analyses of a sentence's words; those of each distinct word are kept, in two generations of `kept` words."""

    def __init__(self, analyzer: Analyzer, most: int = 5, kept: int = 100_000):
        self.analyzer, self.most, self.kept, self.known, self.old = analyzer, most, kept, {}, {}

    def candidates(self, word: str) -> list[tuple]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.kept:
                self.known, self.old = {}, self.known
            got = self.known[word] = self.old.get(word) or self.analyzer.analyses(word, None, 2 * self.most)
        return got

    def read(self, text: str) -> list[Word]:
        words = TOKEN.findall(text or "")
        forms, out = [lower(w) for w in words], []
        for k, w in enumerate(words):
            order, applied = choose(self.candidates(w), out[-1] if out else None, forms, k)
            out.append(Word(w, order[0], order[1 : self.most], applied))
        return out
