"""Sentences of a batch, read and parsed together.

A word is a number, given when it is first met; what is known of it by itself is a row of some arrays. So a batch is arrays of
numbers, and Python runs once for each new word, for each choice between analyses that hasn't been made before, and for each word
of sentences that need the rules one by one (syntax.py). In a sentence of nothing but plain words (nouns, names, adverbs,
interjections and de/da, without suffixes) what all rules together make is a few steps over arrays (_plain()): most rules ask
for words that aren't there, and no predicate stands before the sentence's end.
"""

from __future__ import annotations

import re

import numpy as np

from . import sentences as S
from . import syntax
from .analyzer import lower

#: Words, and the commas between them.
WORDS = re.compile(r"[\w'’]+|,")
#: Parts of speech and bits of plain words.
_PLAIN = frozenset(("NOUN", "PROPN", "ADV", "INTJ", "PART"))
_PLAIN_BITS = syntax.CAPITAL | syntax.LIGHT | syntax.EMPHASIS
_IN_PAIRS = frozenset(w for p in syntax._PAIRS for w in p)
_NO_ANALYSES: list = []


class _Column:
    """An array that grows."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1024, kind), 0

    def append(self, x) -> None:
        if self.n == len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n] = x
        self.n += 1


class _Names(dict):
    """Numbers of names, given when a name is first asked for."""

    def __missing__(self, name):
        self[name] = n = len(self)
        return n


class _Codes(dict):
    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word):
        return self.add(word)


class Batch:
    """Arrays of a batch's words: sentence, place, record, comma, head, rel and upos (numbers of names); lists of forms and of
    choices; the rules of choice that applied by the word's place in the batch."""

    __slots__ = ("applied", "choice", "codes", "comma", "first", "forms", "head", "last", "log", "place", "record", "rel", "sentence", "start", "traced", "upos")


class BatchReader:
    """Reads batches; words are kept in two generations of `kept` words."""

    def __init__(self, analyses, lex: syntax.Lexicon, most: int = 5, kept: int = 300_000):
        """analyses(word): all analyses of a word, best first."""
        self.analyses, self.lex, self.most, self.kept = analyses, lex, most, kept
        self.old: dict[str, list] = {}
        self.rels, self.tags = _Names(), _Names()
        self._begin()

    def _begin(self) -> None:
        self.codes = _Codes(self._met)
        self.words, self.found, self.near = [","], [_NO_ANALYSES], [0]
        self.codes[","] = 0
        self.many, self.own = _Column(bool), (_Column(np.int32), _Column(np.int32))
        for c in (self.many, *self.own):
            c.append(0)
        self.others: dict[tuple, int] = {}
        self.left: dict[tuple, int] = {}
        self.chosen: dict[tuple, tuple] = {}
        self.records: list[tuple] = []
        self.is_plain, self.tag, self.bits, self.low, self.stem, self.long = (_Column(k) for k in (bool, np.int16, np.int32, np.int32, np.int32, bool))
        self.ids = _Names()

    def _met(self, word: str) -> int:
        code = self.codes[word] = len(self.words)
        self.words.append(word)
        self.found.append(self.old.get(word) or self.analyses(word))
        self.near.append(-1)
        self.many.append(len(self.found[code]) > 1)
        for c in self.own:
            c.append(-1)
        return code

    def forget(self) -> None:
        """Begins anew."""
        self.old = {}
        self._begin()

    def _record(self, code: int, choice: int, first: bool) -> int:
        """The number of what a word is by itself with one of its analyses, at the beginning of a sentence or later."""
        form, analysis = self.words[code], self.found[code][choice]
        record = self.lex.fresh(form, analysis, first)
        low, _, _, _, upos, stem, _, bits = record
        n, own = len(self.records), stem or low
        self.records.append((form, analysis, record))
        self.is_plain.append(not analysis[3] and upos in _PLAIN and not bits & ~_PLAIN_BITS and (upos != "PART" or bits & syntax.EMPHASIS) and own not in _IN_PAIRS)
        for c, x in ((self.tag, self.tags[upos]), (self.bits, bits), (self.low, self.ids[low]), (self.stem, self.ids[own]), (self.long, len(own) >= 2)):
            c.append(x)
        if choice:
            self.others[code, choice, first] = n
        else:
            self.own[first].room[code] = n
        return n

    def _near(self, code: int) -> int:
        """What rules of choice ask of a neighbour's form, as bits."""
        if (got := self.near[code]) < 0:
            w = lower(self.words[code])
            asked = (w in S._DET, w in S._ADJ, w in S._CONJ, w in S._NUM, w in S._POST, w in ("mi", "mı", "mu", "mü"), w.startswith("al"), w.startswith(("önün", "ardı")))
            got = self.near[code] = sum(1 << k for k, yes in enumerate(asked) if yes)
        return got

    def _left(self, code: int, choice: int) -> int:
        """What they ask of the analysis before, as bits."""
        key = code, choice
        if (got := self.left.get(key)) is None:
            a = self.found[code][choice]
            end, had = a[3][-1][1] if a[3] else "", set(S.parts(a))
            asked = (S.is_final(a), "SIFAT_FİİL" in end, "TAMLAYAN" in end, not S._POSS.isdisjoint(had), not S._CONVERBS.isdisjoint(had), "İSİM_FİİL" in had, "YÖNELME" in had, "BELIRTME" in had)
            got = self.left[key] = sum(1 << k for k, yes in enumerate(asked) if yes)
        return got

    def _choose(self, b: Batch) -> None:
        """Which of its analyses each word takes, from left to right; words with one have no choice."""
        if len(self.chosen) > 5 * self.kept:
            self.chosen.clear()
        codes, start, last = b.codes, b.first, b.last
        b.choice, b.applied = np.zeros(len(codes), np.int32), {}
        found, choice = self.found, b.choice
        for i in np.flatnonzero(self.many.room[codes]).tolist():
            code, first, end = int(codes[i]), bool(start[i]), bool(last[i])
            before, after = None if first else int(codes[i - 1]), None if end else int(codes[i + 1])
            taken = 0 if first else int(choice[i - 1])
            key = code, -1 if first else self._left(before, taken), -1 if first else self._near(before), -1 if end else self._near(after)
            got = self.chosen.get(key)
            if got is None:
                left = None if first else S.Word(self.words[before], found[before][taken])
                forms = [lower(self.words[c]) for c in (before, code, after) if c is not None]
                order, applied = S.choose(found[code], left, forms, 0 if first else 1)
                got = self.chosen[key] = next(k for k, x in enumerate(found[code]) if x is order[0]), applied
            choice[i] = got[0]
            if got[1]:
                b.applied[i] = got[1]

    def read(self, texts) -> Batch:
        """The words of each text with their analyses."""
        if len(self.words) > self.kept:
            self.old = dict(zip(self.words, self.found, strict=True))
            self._begin()
        b = Batch()
        flat: list[str] = []
        counts = []
        for text in texts:
            own = WORDS.findall(text) if text else _NO_ANALYSES
            flat += own
            counts.append(len(own))
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int32, len(flat))
        at = np.flatnonzero(codes)
        b.codes, b.sentence = codes[at], np.repeat(np.arange(len(counts), dtype=np.int32), counts)[at]
        b.forms = flat if len(at) == len(flat) else [flat[i] for i in at.tolist()]
        n = len(at)
        b.first, b.last = np.ones(n, bool), np.ones(n, bool)
        if n:
            b.first[1:] = b.sentence[1:] != b.sentence[:-1]
            b.last[:-1] = b.first[1:]
        b.start = np.flatnonzero(b.first)
        b.place = np.arange(n, dtype=np.int32) - np.repeat(b.start, np.diff(np.append(b.start, n))).astype(np.int32)
        b.comma = np.zeros(n, bool)
        inner = np.flatnonzero(~b.last)
        b.comma[inner] = codes[at[inner] + 1] == 0
        self._choose(b)
        b.record = np.where(b.first, self.own[1].room[b.codes], self.own[0].room[b.codes])
        b.record[b.choice > 0] = -2
        for first in (False, True):
            new = (b.record == -1) & (b.first == first)
            for code in np.unique(b.codes[new]).tolist():
                self._record(code, 0, first)
            b.record[new] = self.own[first].room[b.codes[new]]
        for i in np.flatnonzero(b.record == -2).tolist():
            key = int(b.codes[i]), int(b.choice[i]), bool(b.first[i])
            got = self.others.get(key)
            b.record[i] = self._record(*key) if got is None else got
        b.upos = self.tag.room[b.record]
        return b

    def parse(self, b: Batch, rules=None, trace: bool = False) -> None:
        """Heads, relations and parts of speech; with trace also what each rule changed: arrays of plain sentences (sentence, rule,
        id, head and relation before and after) and a list of the others."""
        n = len(b.codes)
        b.head, b.rel, b.log, b.traced = np.zeros(n, np.int32), np.full(n, self.rels["_"], np.int16), [], []
        if not n:
            return
        plain = self.is_plain.room[b.record]
        light = self.bits.room[b.record] & syntax.LIGHT != 0
        plain = plain & ~(light & np.append(False, light[:-1]) & ~b.first)  # of two in a row the second asks what the first became
        sizes = np.diff(np.append(b.start, n))
        whole = np.logical_and.reduceat(plain, b.start) & (rules is None and not self.lex.adjectives)
        own = np.repeat(whole, sizes)
        if whole.any():
            self._plain(b, np.flatnonzero(own), trace)
        heads, rels, tags = [], [], []
        rel_of, tag_of, records = self.rels, self.tags, self.records
        for a, size in zip(b.start[~whole].tolist(), sizes[~whole].tolist(), strict=True):
            commas = b.comma[a : a + size].tolist()
            ts = [syntax.Token.made(k, *records[r], c) for k, (r, c) in enumerate(zip(b.record[a : a + size].tolist(), commas, strict=True))]
            log: list | None = [] if trace else None
            syntax.parse_tokens(ts, self.lex, rules, log)
            heads += [t.head for t in ts]
            rels += [rel_of[t.rel] for t in ts]
            tags += [tag_of[t.upos] for t in ts]
            if trace:
                b.log += [(int(b.sentence[a]), k, *x) for k, x in enumerate(log)]
        rest = np.flatnonzero(~own)
        b.head[rest], b.rel[rest], b.upos[rest] = heads, rels, tags

    def _plain(self, b: Batch, at: np.ndarray, trace: bool) -> None:
        """Parses sentences of plain words; at: the places of their words in the batch.

        The sentence's last word is its root, and the only predicate. A word without a relation gets that of the first rule that
        fits, so each rule is a mask over the words that are still free.
        """
        R = self.rels
        n, record = len(at), b.record[at]
        first, last, place, comma = b.first[at], b.last[at], b.place[at], b.comma[at]
        bits, low, stem, long = (c.room[record] for c in (self.bits, self.low, self.stem, self.long))
        tag = self.tag.room[record]
        noun, name, adv, part, intj = (self.tags[x] for x in ("NOUN", "PROPN", "ADV", "PART", "INTJ"))
        spot = np.arange(n)
        begin = np.maximum.accumulate(np.where(first, spot, 0))
        end = np.flatnonzero(last)[np.cumsum(first) - 1]
        head, rel = np.zeros(n, np.int32), np.full(n, R["_"], np.int16)
        free = np.ones(n, bool)
        steps = []
        before = lambda x: np.append(x[:1], x[:-1])

        def give(rule: str, who: np.ndarray, to, what: str) -> None:
            k = np.flatnonzero(who)
            if trace and len(k):
                steps.append((rule, k, head[k], rel[k], to[k] if isinstance(to, np.ndarray) else np.full(len(k), to), np.full(len(k), R[what])))
            head[k] = to[k] if isinstance(to, np.ndarray) else to
            rel[k] = R[what]
            free[k] = False

        give("nominal_predicate", last, 0, "root")
        named = (bits & syntax.CAPITAL != 0) & free & ((tag == noun) | (tag == name))
        follows = named & before(named) & ~first
        heads = np.maximum.accumulate(np.where(named & ~follows, spot, 0))  # of each run
        give("flat_name", follows, place[heads] + 1, "flat")
        tag = np.where(follows, name, tag)
        tag[heads[follows]] = name
        again = (low == before(low)) | ((stem == before(stem)) & long)
        give("reduplication", free & ~first & again, place, "compound:redup")
        # Commas: a word and the next one but de/da; a chain of conjuncts has the first as its head.
        over = tag == part
        seen = np.maximum.accumulate(np.where(over, -1, spot))
        left = before(seen)
        fits = free & ~over & (left >= begin) & ~first
        left = np.where(fits, left, 0)
        fits &= comma[left] & (tag == tag[left]) & ((tag == noun) | (tag == adv))
        chain = np.maximum.accumulate(np.where(over | fits, -1, spot))
        give("coordination", fits, place[chain] + 1, "conj")
        # A light verb hangs on the noun before it; if it was the root, that noun is now.
        root = end.copy()
        light = (bits & syntax.LIGHT != 0) & (free | last) & ~first & before((tag == noun) & free)
        moved = np.flatnonzero(light & last)
        give("light_verb", light, place, "compound:lvc")
        if len(moved):
            new = np.zeros(n, bool)
            new[moved - 1] = True
            give("light_verb", new, 0, "root")
            sized = end[moved] - begin[moved] + 1
            root[np.repeat(begin[moved], sized) + np.arange(sized.sum()) - np.repeat(np.cumsum(sized) - sized, sized)] = np.repeat(moved - 1, sized)
        top = place[root] + 1
        give("emphasis", (bits & syntax.EMPHASIS != 0) & free & ~first, place, "advmod:emph")
        to_next = (tag == adv) & ~last & np.append(tag[1:] == adv, False)
        give("adverb", free & (tag == adv), np.where(to_next, place + 2, top), "advmod")
        role = free & ((tag == noun) | (tag == name))
        count = np.cumsum(role)
        subject = role & (count - np.where(begin > 0, count[begin - 1], 0) == 1)
        if trace:  # within a rule, changes come in the order of the words
            k = np.flatnonzero(role)
            steps.append(("case_role", k, head[k], rel[k], top[k], np.where(subject[k], R["nsubj"], R["obj"])))
        head[role], rel[role], free[role] = top[role], np.where(subject, R["nsubj"], R["obj"])[role], False
        give("fallback", free & (tag == intj), top, "discourse")
        give("fallback", free & (tag == part), top, "dep")
        # Of the root's objects only the nearest, the last one, stays.
        objects = role & ~subject
        upto = np.cumsum(objects)
        other = objects & (upto < upto[end])
        give("one_object", other, top, "obl")
        b.head[at], b.rel[at], b.upos[at] = head, rel, tag
        if trace:
            b.traced = [(rule, b.sentence[at[k]], place[k] + 1, *x) for rule, k, *x in steps]
