"""Language ID by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its longest character n-grams
that are known, then to shorter ones, with a penalty for each step. A word is a letter and the letters and combining marks
after it. The model is learned from a bounded sample of labelled rows of each language, of which it reads whole texts; all
languages are learned. Of each it holds at most KEPT_WORDS words and KEPT_GRAMS n-grams of each length, or LEAST_KEPT
of them if there are many languages: so the broadcast doesn't grow with the corpus, only with the number of languages.

Null text, empty text and text without a letter give `und` and score 0. If two languages score alike, the first by name wins.
Rows of null id are never learned from and count as held out. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import removed, trimmed, unused, written

UND = "und"
#: Expected number of sampled documents a language, and kept words, and n-grams of each length, a language.
SAMPLE_DOCS, KEPT_WORDS, KEPT_GRAMS = 1500, 30_000, 8_000
LONGEST = 5
#: Entries of each kind that many languages share, and what each keeps at the least.
KEPT_ALL, LEAST_KEPT = 120_000, 2_000
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Numbers that the table of scores of known words holds at most.
_CACHE = 1 << 20


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Model:
    """Entries are words, then n-grams. An entry's scores are those of its kind in `plain`, but for the languages that have
    it: entries first[i] to first[i + 1] of `lang` and `more` say which, and how much more it scores there."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    first: np.ndarray
    lang: np.ndarray
    more: np.ndarray
    plain: np.ndarray  # a row for words, then one for n-grams of each length

    def _sums(self, rows: list[int], counts: list[int]) -> np.ndarray:
        """For each owner of counts[i] of the rows: what its rows score more in each language, in all."""
        rows = np.array(rows, dtype=np.int64)
        size = self.first[rows + 1] - self.first[rows]
        upto = np.cumsum(size)
        at = np.repeat(self.first[rows] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        owner = np.repeat(np.repeat(np.arange(len(counts)), counts), size)
        n = len(self.langs)
        return np.bincount(owner * n + self.lang[at], weights=self.more[at], minlength=len(counts) * n).reshape(-1, n)

    def scores(self, words: list[str]) -> np.ndarray:
        """The log score of each word in each language."""
        out = np.full((len(words), len(self.langs)), -20.0)  # for unknown characters
        rows = list(map(self.words.get, words))
        known = [i for i, r in enumerate(rows) if r is not None]
        if known:
            out[known] = self.plain[0] + self._sums([rows[i] for i in known], [1] * len(known))
        rest = [(i, f"^{words[i]}$") for i, r in enumerate(rows) if r is None]
        find = self.grams.get
        for n in range(LONGEST, 0, -1):
            at, counts, got, left = [], [], [], []
            for i, s in rest:
                rows = [r for k in range(len(s) - n + 1) if (r := find(s[k : k + n])) is not None]
                if rows:
                    at.append(i)
                    counts.append(len(rows))
                    got += rows
                else:
                    left.append((i, s))
            if at:
                out[at] = self.plain[n] + self._sums(got, counts) / np.array(counts)[:, None] - (LONGEST + 1 - n)
            rest = left
        return out


def sample(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A share of each language's rows, chosen by a hash of the id, that gives SAMPLE_DOCS rows at the most expected."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(id_col)).select(id_col, "lang", "text")
    known = rows.groupBy("lang").agg(F.least(F.lit(1.0), SAMPLE_DOCS / F.count(F.lit(1))).alias("share"))
    drawn = (F.xxhash64(F.col(id_col), F.lit(29)).cast("double") / F.lit(2.0**64)) + 0.5
    return rows.join(F.broadcast(known), "lang").filter(drawn < F.col("share")).select("lang", "text")


_COUNTS = "lang string, item string, n long"


def _counts(of, flush: int = 400_000):
    """Batches of (lang, item, n) from batches of which of(batch) gives (lang, items with counts)."""

    def run(batches):
        total: dict[str, dict[str, int]] = {}
        for b in batches:
            for lang, items in of(b):
                held = total.setdefault(lang, {})
                for x, n in items:
                    held[x] = held.get(x, 0) + n
            if sum(map(len, total.values())) > flush:
                yield from out(total)
                total = {}
        yield from out(total)

    def out(total):
        for lang, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "item", "n"])

    return run


def _words(b: pa.RecordBatch):
    for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
        yield lang, Counter(_WORD.findall(text.lower())).items()


def _grams(b: pa.RecordBatch):
    for lang, w, c in zip(*(b.column(k).to_pylist() for k in ("lang", "item", "n")), strict=True):
        s = f"^{w}$"
        yield lang, ((s[k : k + n], c) for n in range(1, LONGEST + 1) for k in range(len(s) - n + 1))


def _kept(counts: DataFrame, most: int, size) -> DataFrame:
    """Counts, in all languages, of the items that are among the `most` frequent ones of a language (and size, if given)."""
    by = W.partitionBy("lang", *size).orderBy(F.desc("n"), "item")
    top = counts.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most).select("item").distinct()
    return counts.join(top, "item", "left_semi").select("lang", "item", "n")


def train(docs: DataFrame, id_col: str = "doc_id") -> Model:
    """Learns from `text` and non-null `lang` of rows that aren't held out."""
    sum_up = lambda rows: rows.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = written(sum_up(sample(docs, id_col).mapInArrow(trimmed(_counts(_words)), _COUNTS)), "langid-words")
    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
    grams = written(sum_up(words.repartition(many).mapInArrow(trimmed(_counts(_grams)), _COUNTS)).withColumn("len", F.length("item")), "langid-grams")
    sums = {(r["lang"], r["len"]): r["s"] for r in words.withColumn("len", F.lit(0)).unionByName(grams).groupBy("lang", "len").agg(F.sum("n").alias("s")).collect()}
    langs = sorted({lang for lang, _ in sums})
    number = {x: k for k, x in enumerate(langs)}
    of = np.array([[sums.get((x, n), 0) + 1 for x in langs] for n in range(LONGEST + 1)], dtype=float).reshape(LONGEST + 1, len(langs))
    plain = np.log(0.1 / of)
    entries, first, lang, more = [], [np.zeros(1, dtype=np.int64)], [], []
    for counts, most, size in ((words, KEPT_WORDS, ()), (grams, KEPT_GRAMS, ("len",))):
        most = max(min(LEAST_KEPT, most), min(most, KEPT_ALL // max(1, len(langs))))
        got = _kept(counts, most, size).toArrow().sort_by([("item", "ascending"), ("lang", "ascending")])
        of_item = got.column("item").combine_chunks().dictionary_encode()
        names = of_item.dictionary.to_pylist()
        entries.append(dict(zip(names, range(sum(map(len, entries)), sum(map(len, entries)) + len(names)), strict=True)))
        first.append(np.cumsum(np.bincount(of_item.indices.to_numpy(), minlength=len(names))) + sum(map(len, lang)))
        lang.append(np.array([number[x] for x in got.column("lang").to_pylist()], dtype=np.int32))
        kind = pc.utf8_length(got.column("item")).to_numpy() if size else np.zeros(got.num_rows, dtype=np.int64)
        more.append(np.log((got.column("n").to_numpy() + 0.1) / of[kind, lang[-1]]) - plain[kind, lang[-1]])
    for counts in (words, grams):
        removed(docs.sparkSession, counts)
    return Model(langs, *entries, np.concatenate(first), np.concatenate(lang), np.concatenate(more), plain)


def predict_batches(model: Model, batches, column: int, names: list[str]):
    """Batches with two more columns, the language and its score. Whole texts are scored; each distinct word once while it is
    in the table."""
    ids: dict[str, int] = {}
    most = max(1000, _CACHE // max(1, len(model.langs)))
    table = np.zeros((0, len(model.langs)))
    for b in batches:
        preds, scores = [], []
        words = [_WORD.findall(text.lower()) if text else [] for text in b.column(column).to_pylist()]
        if model.langs:
            if len(ids) > most:
                ids.clear()
            new = list(set().union(*words).difference(ids))
            table = np.concatenate([table[: len(ids)], model.scores(new)])
            ids.update(zip(new, range(len(ids), len(table)), strict=True))
        for own in words:
            if not own or not model.langs:
                preds.append(UND)
                scores.append(0.0)
                continue
            total = table[list(map(ids.__getitem__, own))].sum(axis=0)
            best = int(total.argmax())
            preds.append(model.langs[best])
            scores.append(float(1.0 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, *names])


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two more columns: the language (a learned value or `und`) and the winner's posterior, from 0 to 1."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by KEPT_WORDS and KEPT_GRAMS a language
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index("text")
    return docs.mapInArrow(trimmed(lambda it: predict_batches(shared.value, it, at, list(names))), schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """Rows whose language is found with at least least_score; others go. Columns stay as they are, whatever their names."""
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    found = predict(docs, train(docs), (lang, score))
    return found.filter((F.col(lang) != UND) & (F.col(score) >= least_score)).select(*docs.columns)
