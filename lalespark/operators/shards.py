"""Words against dictionaries that are too large for one set.

All that analysis and parsing look up in a dictionary begins with the first two letters of the word asked about, unless what
is found has three letters or fewer (apart from a verb's ending). So words and entries are dealt out by their first two letters and
meet there; the few short entries go everywhere. A task holds the entries of one such key at a time.
"""

from __future__ import annotations

import pickle

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries up to this length, without a verb's ending, are short.
SHORT = 3
#: Parts into which the words of a key are dealt; its entries go to each.
SALTS = 4
#: Words at most that are joined by broadcast, those that make more than one in so many of all.
HOT_WORDS = 10_000


class TooManyWords(ValueError):
    """A dictionary has more words than may be broadcast."""


def words_of(dictionary: DataFrame | None, most: int) -> list[str] | None:
    """The dictionary's words, if they are at most so many."""
    if dictionary is None:
        return None
    got = dictionary.select("word").filter(F.col("word").isNotNull()).limit(most + 1).toArrow().column("word")
    if len(got) > most:
        raise TooManyWords(f"the dictionary has more than {most} words")
    return got.to_pylist()


def over_shards(requests: DataFrame, dictionaries: list[DataFrame | None], most: int, make, serve, schema: str, chunk: int = 1000) -> DataFrame:
    """Rows that serve(make(sets of words), requests) gives for the requests (key, word, upos, what) of each key.

    key: the first two letters of what is looked up. A dictionary that is missing gives None instead of a set.
    """
    spark = requests.sparkSession
    size = F.length(F.regexp_replace("word", "m[ae]k$", ""))
    short = [d if d is None else frozenset(words_of(d.filter(size <= SHORT), most)) for d in dictionaries]
    shared = spark.sparkContext.broadcast(short)
    none = F.lit(None).cast("string")
    rows = requests.select("key", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(-1).alias("of"), "word", "upos", "what")
    for k, d in enumerate(dictionaries):
        if d is not None:
            own = d.filter(F.col("word").isNotNull() & (size > SHORT)).select(F.left("word", F.lit(2)).alias("key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(k).alias("of"), "word", none.alias("upos"), none.alias("what"))
            rows = rows.unionByName(own)
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(many, "key", "salt").sortWithinPartitions("key", "salt", F.desc("of"))  # entries come first

    def run(batches):
        at, sets, state, asked = None, [], None, []
        for b in batches:
            for key, salt, of, word, upos, what in zip(*(b.column(c).to_pylist() for c in ("key", "salt", "of", "word", "upos", "what")), strict=True):
                if (key, salt) != at:
                    if asked:
                        yield serve(state, asked)
                    at, sets, state, asked = (key, salt), [set() for _ in shared.value], None, []
                if of >= 0:
                    sets[of].add(word)
                    continue
                if state is None:
                    state = make([None if s is None else s | own for s, own in zip(shared.value, sets, strict=True)])
                asked.append((word, upos, what))
                if len(asked) >= chunk:
                    yield serve(state, asked)
                    asked = []
        if asked:
            yield serve(state, asked)

    return rows.mapInArrow(run, schema)


def keyed(words: DataFrame, keys) -> DataFrame:
    """Requests (key, word, upos, what) for words (word, upos): keys(word) gives (what, string that is looked up)."""

    def run(batches):
        for b in batches:
            rows = [(s[:2], w, u, what) for w, u in zip(b.column("word").to_pylist(), b.column("upos").to_pylist(), strict=True) for what, s in keys(w)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], names=["key", "word", "upos", "what"])

    return words.mapInArrow(run, "key string, word string, upos string, what string")


def sentence_words(sents: DataFrame, find) -> DataFrame:
    """(s1, s2, word, sent_id, text, first): a row for each distinct word of each sentence, the first of which has the sentence
    itself; one of null word for a sentence without words. s1 and s2 are 128 hash bits of the sentence."""

    def run(batches):
        for b in batches:
            rows = []
            for s1, s2, sent_id, text in zip(*(b.column(c).to_pylist() for c in ("s1", "s2", "sent_id", "text")), strict=True):
                found = list(dict.fromkeys(find(text or ""))) or [None]
                rows += [(s1, s2, w, None if k else sent_id, None if k else text, int(not k)) for k, w in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["s1", "s2", "word", "sent_id", "text", "first"])

    rows = sents.select(F.xxhash64("sent_id", "text").alias("s1"), F.xxhash64(F.lit(7), "sent_id", "text").alias("s2"), "sent_id", "text")
    return rows.mapInArrow(run, "s1 long, s2 long, word string, sent_id string, text string, first int")


def gathered(words: DataFrame, known: DataFrame) -> DataFrame:
    """(sent_id, text, copies, words): each sentence once, with what is known (word, n, blob) of its words. n: how often a word
    comes in words; frequent ones are joined by broadcast, so that no task gets all sentences with one of them."""
    total = known.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * HOT_WORDS > total
    hot, rest = F.broadcast(known.filter(frequent).drop("n")), known.filter(~frequent).drop("n")
    named = words.filter(F.col("word").isNotNull())
    both = named.join(hot, "word").unionByName(named.join(hot.select("word"), "word", "left_anti").join(rest, "word"))
    both = both.unionByName(words.filter(F.col("word").isNull()), allowMissingColumns=True)
    known_word = F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "blob"))).alias("words")
    own = both.groupBy("s1", "s2").agg(F.max("sent_id").alias("sent_id"), F.max("text").alias("text"), F.sum("first").cast("int").alias("copies"), known_word)
    return own.select("sent_id", "text", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "words")


def packed(rows: list[tuple[str, str, object]]) -> pa.RecordBatch:
    """(word, what, blob)."""
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.string()), pa.array([pickle.dumps(x) for x in cols[2]], pa.binary())], names=["word", "what", "blob"])
