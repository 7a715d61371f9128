"""Sentences to annotated words, as a DataFrame operator."""

from __future__ import annotations

import gc
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import sentences as split_sentences
from . import shards, syntax
from .analyzer import MOST_WORDS, Analyzer, held, lower, searched
from .batches import Batch, BatchReader
from .context import rerank  # noqa: F401
from .sentences import TOKEN as WORD

SCHEMA = (
    "sent_id string, id int, form string, stem string, root string, lemma string, suffixes array<struct<form:string,label:string>>, applied array<string>, "
    "alternatives int, upos string, feats map<string,string>, head int, deprel string, comma boolean, head_form string"
)
#: How many analyses of a word are ranked: twice as many as are kept in the end.
DEEP = 10
#: Arrow types of the columns of both.
KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
         "array<struct<form:string,label:string>>": pa.list_(pa.struct([("form", pa.string()), ("label", pa.string())]))}
TRACE = "sent_id string, step int, rule string, id int, head_before int, deprel_before string, head_after int, deprel_after string"


def sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sent_id, text): the sentences of each document, named by its id and their place."""
    parts = docs.select(F.col(id_col).cast("string").alias("_d"), F.posexplode(split_sentences(F.col("text"))).alias("_k", "text"))
    return parts.select(F.concat_ws("-", "_d", F.col("_k").cast("string")).alias("sent_id"), "text").filter(F.trim("text") != "")


def spread(df: DataFrame) -> DataFrame:
    """At least some partitions a core, as reading a sentence is work and some partitions may be nearly empty; tables of many
    files stay as they are."""
    if df.isStreaming:
        return df
    least = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def _reader(value) -> BatchReader:
    """A reader from the words of the dictionaries, or one that waits for what is known of each word."""
    known, own, adjectives, ready = value
    if ready:
        lex, found = syntax.Facts(adjectives), {}
        reader = BatchReader(found.__getitem__, lex)
        reader.given = found
        return reader
    analyzer, lex = Analyzer(known), syntax.Lexicon(own or [], adjectives)
    gc.freeze()  # the dictionaries stay: no collection need go through them
    return BatchReader(lambda word: analyzer.analyses(word, None, DEEP), lex)


def _prepared(sents: DataFrame, dictionary: DataFrame | None, parser_words: DataFrame | None, adjectives=()):
    """Sentences (sent_id, text) in partitions worth a task, and a broadcast that _reader() takes.

    Beyond MOST_WORDS words of a dictionary, each distinct word is analysed where its part of the dictionary is, and
    sentences get what is known of their words in a third column.
    """
    rows = sents.select(F.col("sent_id").cast("string").alias("sent_id"), F.col("text").cast("string").alias("text"))
    send = rows.sparkSession.sparkContext.broadcast
    try:
        known = shards.words_of(dictionary, MOST_WORDS)
        own = known if parser_words is dictionary else shards.words_of(parser_words, MOST_WORDS)
        return spread(rows), send((known, own, list(adjectives), False))
    except shards.TooManyWords:
        if sents.isStreaming:  # gathering sentences needs them all
            raise
        words = shards.sentence_words(spread(rows), WORD.findall)
        counts = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        asked = shards.keyed(counts.select("word", F.lit(None).cast("string").alias("upos")), lambda w: [("candidates", searched(w)), ("facts", lower(w))])
        make = lambda sets: (Analyzer(sets[0]), syntax.Lexicon(sets[1] or ()))
        serve = lambda own, asked: shards.packed([(w, what, own[0].analyses(w, None, DEEP) if what == "candidates" else own[1].facts(w)) for w, _, what in asked])
        served = shards.over_shards(asked, [dictionary, parser_words], MOST_WORDS, make, serve, "word string, what string, blob binary")
        blob = lambda what: F.max(F.when(F.col("what") == what, F.col("blob"))).alias(what)
        served = served.groupBy("word").agg(blob("candidates"), blob("facts")).select("word", F.struct("candidates", "facts").alias("blob"))
        return shards.gathered(words, counts.join(served, "word")), send((None, None, list(adjectives), True))


def _read(b: pa.RecordBatch, reader: BatchReader) -> Batch:
    """The words of a batch's sentences."""
    if "words" in b.schema.names:
        if len(reader.words) > reader.kept:
            reader.forget()
            reader.given.clear()
            reader.lex.of.clear()
        for own in b.column("words"):
            for x in own:
                if (word := x["word"].as_py()) not in reader.given:
                    blob = x["blob"]
                    reader.given[word], reader.lex.of[word] = pickle.loads(blob["candidates"].as_py()), pickle.loads(blob["facts"].as_py())
    return reader.read(b.column("text").to_pylist())


def _named(numbers, names, kind=pa.string()) -> pa.Array:
    return pa.array(list(names), kind).take(pa.array(numbers, pa.int64()))


def _of_record(make):
    """A column that hangs on a word's record alone, made once for each that comes in the batch."""

    def column(b: Batch, reader: BatchReader, kind) -> pa.Array:
        own, at = np.unique(b.record, return_inverse=True)
        return pa.array([make(*reader.records[k]) for k in own.tolist()], kind).take(pa.array(at.reshape(-1)))

    return column


def _head_forms(b: Batch, reader: BatchReader, kind) -> pa.Array:
    own = np.arange(len(b.head)) - b.place + b.head - 1
    return pa.array(b.forms, kind).take(pa.array(own, pa.int64(), mask=b.head == 0))


#: How a column of SCHEMA is made of a batch of words; sent_id is the sentence's, head and deprel are null if no rules ran.
_MADE = {
    "id": lambda b, reader, kind: pa.array(b.place + 1, kind), "form": lambda b, reader, kind: pa.array(b.forms, kind),
    "stem": _of_record(lambda form, a, record: a[0]), "root": _of_record(lambda form, a, record: a[1]), "lemma": _of_record(lambda form, a, record: a[2]),
    "suffixes": _of_record(lambda form, a, record: [{"form": f, "label": x} for f, x in a[3]]), "feats": _of_record(lambda form, a, record: list(record[3].items())),
    "applied": lambda b, reader, kind: pa.array([b.applied.get(k, ()) for k in range(len(b.forms))], kind),
    "alternatives": lambda b, reader, kind: pa.array([min(len(reader.found[k]), reader.most) - 1 for k in b.codes.tolist()], kind),
    "upos": lambda b, reader, kind: _named(b.upos, reader.tags, kind), "head": lambda b, reader, kind: pa.array(b.head, kind), "deprel": lambda b, reader, kind: _named(b.rel, reader.rels, kind),
    "comma": lambda b, reader, kind: pa.array(b.comma, kind), "head_form": _head_forms,
}
_OF_RULES = ("head", "deprel", "head_form")


def _columns(b: Batch, reader: BatchReader, sent_ids: pa.Array, fields: dict[str, str], parsed: bool) -> list[pa.Array]:
    out = []
    for name, kind in fields.items():
        if name == "sent_id":
            out.append(sent_ids.take(pa.array(b.sentence)))
        elif name in _OF_RULES and not parsed:
            out.append(pa.nulls(len(b.forms), KINDS[kind]))
        else:
            out.append(_MADE[name](b, reader, KINDS[kind]))
    return out


_ORDER = {rule.__name__: k for k, rule in enumerate([*syntax.RULES, syntax.one_object, syntax.first_root])}


def _traces(b: Batch, reader: BatchReader, sent_ids: pa.Array, fields: dict[str, str]) -> list[pa.Array]:
    """What each rule changed, in the order of TRACE."""
    made = {n: [] for n in ("sentence", *list(_fields(TRACE, None))[1:])}
    if b.traced:
        rule = np.concatenate([np.full(len(x[1]), _ORDER[x[0]]) for x in b.traced])
        sentence, id_, head, rel, to, what = (np.concatenate([x[k] for x in b.traced]) for k in range(1, 7))
        order = np.lexsort((id_, rule, sentence))
        rule, sentence, id_, head, rel, to, what = (x[order] for x in (rule, sentence, id_, head, rel, to, what))
        begins = np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1]))
        step = np.arange(len(rule)) - np.repeat(begins, np.diff(np.append(begins, len(rule))))
        for name, x in zip(made, (sentence, step, _named(rule, _ORDER), id_, head, _named(rel, reader.rels), to, _named(what, reader.rels)), strict=True):
            made[name].append(x)
    for name, x in zip(made, zip(*b.log, strict=True), strict=False):
        made[name].append(x)
    at = made.pop("sentence")
    out = []
    for name, kind in fields.items():
        if name == "sent_id":
            out.append(pa.concat_arrays([sent_ids.take(pa.array(x, pa.int64())) for x in at] or [pa.array([], pa.string())]))
        else:
            out.append(pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, KINDS[kind]) for x in made[name]] or [pa.array([], KINDS[kind])]))
    return out


def _fields(schema: str, columns) -> dict[str, str]:
    """The columns' names and types, in the schema's order."""
    commas = schema.replace("form:string,label", "form:string;label").split(", ")
    all_ = {n: kind.replace(";", ",") for n, kind in (f.split(" ") for f in commas)}
    if columns is not None and (unknown := set(columns) - set(all_)):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return {n: kind for n, kind in all_.items() if columns is None or n in columns}


def annotate(sents: DataFrame, dictionary: DataFrame | None = None, parser_words: DataFrame | None = None, adjectives: list[str] = (), rules=None, trace: bool = False, parsed: bool = True, columns=None) -> DataFrame:
    """Words of sentences (sent_id, text) with analysis, part of speech, features, head and its form, and relation.

    dictionary is the analyzer's, parser_words the parser's own; either may be missing. A sentence is read by one task, and a
    worker keeps the analyses of words it has met. With trace, what each rule changed comes instead. Without parsed no rule
    runs: part of speech is what the word alone says, head and relation are null. Null text has no words. columns: those that
    are wanted; what isn't is not made, which takes as long as parsing.
    """
    rows, shared = _prepared(sents, dictionary, parser_words, adjectives)
    fields = _fields(TRACE if trace else SCHEMA, columns)

    def run(batches):
        reader = held(shared, _reader)
        for x in batches:
            b = _read(x, reader)
            if parsed or trace:
                reader.parse(b, rules, trace)
            own = _traces(b, reader, x.column("sent_id"), fields) if trace else _columns(b, reader, x.column("sent_id"), fields, parsed)
            yield pa.RecordBatch.from_arrays(own, names=list(fields))

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields.items()))


def nested(sents: DataFrame, dictionary: DataFrame | None = None, parser_words: DataFrame | None = None, columns=None) -> DataFrame:
    """(sent_id, text, words): annotate() with a sentence's words, in order, in its own row, so what is made of whole sentences
    needs no grouping. columns: those of a word."""
    rows, shared = _prepared(sents, dictionary, parser_words)
    fields = {n: kind for n, kind in _fields(SCHEMA, columns).items() if n != "sent_id"}

    def run(batches):
        reader = held(shared, _reader)
        for x in batches:
            b = _read(x, reader)
            reader.parse(b)
            ends = np.append(0, np.cumsum(np.bincount(b.sentence, minlength=len(x))))
            words = pa.StructArray.from_arrays(_columns(b, reader, x.column("sent_id"), fields, True), names=list(fields))
            yield pa.RecordBatch.from_arrays([x.column("sent_id"), x.column("text"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)], names=["sent_id", "text", "words"])

    return rows.mapInArrow(run, f"sent_id string, text string, words array<struct<{', '.join(f'{n}: {k}' for n, k in fields.items())}>>")


def trees(sents: DataFrame, dictionary: DataFrame | None = None, parser_words: DataFrame | None = None) -> DataFrame:
    """(sent_id, tree) of each sentence, as text."""
    rows, shared = _prepared(sents, dictionary, parser_words)

    def run(batches):
        reader = held(shared, _reader)
        for x in batches:
            b = _read(x, reader)
            reader.parse(b)
            names, heads, shown = list(reader.rels), b.head.tolist(), [syntax.drawn([], [], [])] * len(x)
            rels = [names[k] for k in b.rel.tolist()]
            for a, e, k in zip(b.start.tolist(), np.append(b.start, len(heads))[1:].tolist(), b.sentence[b.start].tolist(), strict=True):
                shown[k] = syntax.drawn(b.forms[a:e], heads[a:e], rels[a:e])
            yield pa.RecordBatch.from_arrays([x.column("sent_id"), pa.array(shown, pa.string())], names=["sent_id", "tree"])

    return rows.mapInArrow(run, "sent_id string, tree string")


def apply_rules(tokens: DataFrame, rules, dictionary: DataFrame | None = None) -> DataFrame:
    """(sent_id, id, upos, head, deprel, feats) after some rules, or none, over tokens that are annotated already.

    tokens: sent_id string, id from 1 in each sentence, form, lemma, suffixes (form, label), upos, head, deprel ("_" for
    none) and comma. A sentence is gathered to one row, so rules can be tried or added beside any parser.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((shards.words_of(dictionary, MOST_WORDS) or [], list(rules)))
    fields = ("id", "form", "lemma", "suffixes", "upos", "head", "deprel", "comma")
    whole = tokens.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("t"))

    def run(batches):
        words, rules = shared.value
        lex = syntax.Lexicon(words)
        for b in batches:
            out: list[tuple] = []
            for sent_id, rows in zip(b.column("sent_id").to_pylist(), b.column("t").to_pylist(), strict=True):
                own = [syntax.Token.given(k, t["form"], t["lemma"], tuple((x["form"], x["label"]) for x in t["suffixes"]), t["upos"], t["head"], t["deprel"], t["comma"]) for k, t in enumerate(rows)]
                sentence = syntax.Sentence(own, lex)
                for rule in rules:
                    rule(sentence)
                out += [(sent_id, t.id, t.upos, t.head, t.rel, list(t.feats.items())) for t in own]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["sent_id", "id", "upos", "head", "deprel", "feats"])

    return whole.mapInArrow(run, "sent_id string, id int, upos string, head int, deprel string, feats map<string,string>")


def word_tests(words: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """(word, participle, ablative, nominal_dir, ambiguous, adjective_base) of each distinct word: what the parser asks of a
    form and the dictionary alone. ambiguous is about the word as a base before -lar."""
    shared = words.sparkSession.sparkContext.broadcast((shards.words_of(dictionary, MOST_WORDS) or [], []))

    def run(batches):
        lex = held(shared, lambda value: syntax.Lexicon(*value))
        for b in batches:
            own = b.column("word").to_pylist()
            cols = [[f(w) for w in own] for f in (lex.an_participle, lex.is_ablative, lambda w: lex.nominal_dir(w, set()), lex.ambiguous, lex.adjective_base)]
            yield pa.RecordBatch.from_arrays([b.column("word"), *(pa.array(c, pa.bool_()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["word", "participle", "ablative", "nominal_dir", "ambiguous", "adjective_base"])

    rows = words.select("word").filter(F.col("word").isNotNull()).distinct()
    return rows.mapInArrow(run, "word string, participle boolean, ablative boolean, nominal_dir boolean, ambiguous boolean, adjective_base string")
