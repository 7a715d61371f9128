"""Sentences of a batch against the same sentences one by one, rule by rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lalespark.operators import annotate as A
from lalespark.operators import batches, syntax
from lalespark.operators import evaluation as E
from lalespark.operators.analyzer import Analyzer
from lalespark.operators.sentences import SentenceReader
from lalespark.plans.base import DICTIONARY
from lalespark.plans.sentence import SENTENCES
from lalespark.sources import conllu

KNOWN = [*DICTIONARY, "taş", "masa", "kalem", "Ali", "etmek", "olmak"]
#: None of these has a suffix: nouns, names, adverbs, interjections, de/da, light verbs' forms; the second list has all kinds.
PLAIN = "taş Taş masa masa, taş, kalem Kalem Kalem, de da da, çok Çok çok, az az, pek dün yine hey ha ha, et et, olk Olk olk, ol a's a A a,".split()
ALL = [*PLAIN, *(w for s in SENTENCES for w in s.rstrip(".?").split()), *"ve ama için iki 3 güzel kaba saba hem ne evin kapısı evde gelen ki mi hayır, ya da Ankara'ya sabah değil".split()]


def _made(texts, reader, rules=None):
    """(form, analysis, applied, upos, head, deprel, comma) of each text's words, what rules changed, and whether it was plain."""
    b = reader.read(texts)
    reader.parse(b, rules, True)
    rels, tags, at = list(reader.rels), list(reader.tags), [[] for _ in texts]
    for j, k in enumerate(b.sentence.tolist()):
        at[k].append((b.forms[j], reader.records[b.record[j]][1], b.applied.get(j, []), tags[b.upos[j]], int(b.head[j]), rels[b.rel[j]], bool(b.comma[j])))
    log = [[] for _ in texts]
    for rule, *x in b.traced:
        for k, i, head, rel, to, what in zip(*(y.tolist() for y in x), strict=True):
            log[k].append((rule, i, head, rels[rel], to, rels[what]))
    plain = [bool(x) for x in log]
    for k, _, *x in b.log:
        log[k].append(tuple(x))
    return at, log, plain


@pytest.mark.parametrize("words", [PLAIN, ALL])
def test_batches_are_sentences(words):
    r = random.Random(len(words))
    texts = [" ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(4000)] + ["", None, "...", " , a", ",a,, b,", "a , , b", *SENTENCES]
    lex, analyzer = syntax.Lexicon(KNOWN), Analyzer(KNOWN)
    reader, one = batches.BatchReader(lambda w: analyzer.analyses(w, None, 10), lex, kept=20), SentenceReader(analyzer)
    plain = 0
    for a in range(0, len(texts), 500):  # words are kept for a batch or two only
        part = texts[a : a + 500]
        for text, got, log, easy in zip(part, *_made(part, reader), strict=True):
            trace, read = [], one.read(text)
            want = syntax.parse(read, text or "", lex, syntax.RULES, trace)
            assert got == [(w.form, w.analysis, w.applied, t.upos, t.head, t.rel, t.comma) for w, t in zip(read, want, strict=True)], text
            assert sorted(log) == sorted(trace), text
            plain += easy
    assert words is not PLAIN or plain > 2000


def test_steps_of_rules(spark):
    """What rules changed comes in their order, plain sentences or not."""
    texts = [(str(k), s) for k, s in enumerate([*SENTENCES, "Taş masa, kalem taş taş de et", "çok çok hey masa olk"])]
    known = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    got = A.annotate(spark.createDataFrame(texts, "sent_id string, text string"), known, known, trace=True).orderBy(F.col("sent_id").cast("int"), "step").collect()
    lex, reader, want = syntax.Lexicon(KNOWN), SentenceReader(Analyzer(KNOWN)), []
    for k, text in texts:
        log = []
        syntax.parse(reader.read(text), text, lex, syntax.RULES, log)
        want += [(k, n, *x) for n, x in enumerate(log)]
    assert [tuple(x) for x in got] == want


def test_a_word_is_analysed_once(monkeypatch):
    """However often words come, Python reads and parses each plain one once."""
    asked = []
    analyzer = Analyzer(KNOWN)
    reader = batches.BatchReader(lambda w: asked.append(w) or analyzer.analyses(w, None, 10), syntax.Lexicon(KNOWN))
    monkeypatch.setattr(syntax, "parse_tokens", lambda *x: pytest.fail("a plain sentence went word by word"))
    b = reader.read(["taş masa, kalem de"] * 1000)
    reader.parse(b)
    assert len(b.forms) == 4000 and sorted(asked) == ["de", "kalem", "masa", "taş"]
    assert np.array_equal(b.head.reshape(-1, 4), np.tile([4, 4, 2, 0], (1000, 1)))


def test_benchmark_is_done_with_rows(spark):
    """Ranges, punctuation and alignment within a block's row, against the operators over rows; no token is shuffled."""
    r, texts, blocks = random.Random(7), [], []
    for k in range(60):
        words = r.choices(["taş", "masa", "kalem", "geldi", "ev", "evin", "kapısı", "de"], k=r.randint(1, 9))
        n, lines = len(words), []
        for i, w in enumerate(words, 1):
            if i % 4 == 1 and i < n and k % 2:
                lines.append(f"{i}-{i + 1}\t{w}{words[i]}\t" + "\t".join("_" * 8))
            lines.append("\t".join([str(i), w, w, r.choice(["NOUN", "PUNCT", "VERB"]), "_", r.choice(["_", "Case=Nom"]), str(r.randint(0, n + 1)), r.choice(["root", "obl", "nsubj"]), "_", "_"]))
        r.shuffle(lines)
        texts.append((f"s{k}", " ".join(words)))
        blocks.append((f"# sent_id = s{k}\n" + (f"# text = {texts[-1][1]}\n" if k % 7 else "") + "\n".join([*lines, "x", "1.1\tq\tq\tX\t_\t_\t0\troot\t_\t_"]),))
    df = spark.createDataFrame([*blocks, ("# sent_id = none",)], "block string")
    known = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    got = E.benchmark(df, known)
    gold = E.strip_punct(E.merge_ranges(conllu.tokens(df), conllu.ranges(df)))
    want = E.aligned(gold, A.annotate(conllu.texts(df), known, known).select("sent_id", "id", "form", "upos", "head", "deprel"))
    assert got.dtypes == want.dtypes
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.collect())) == rows and len(rows) > 100
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_conllu_text_shuffles_no_words(spark, sf_dir):
    plan = __spark_entry__.queries()["parse_conllu"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_nested_blocks_are_blocks(spark):
    sents = spark.createDataFrame([*((str(k), s) for k, s in enumerate(SENTENCES)), ("none", "..."), ("null", None), ("lines", "taş\r\nmasa geldi")], "sent_id string, text string")
    known = spark.createDataFrame([(w,) for w in KNOWN], "word string")
    columns = ["id", "form", "stem", "upos", "feats", "head", "deprel"]
    renamed = lambda c: "lemma" if c == "stem" else c
    want = conllu.blocks(A.annotate(sents, known, known).select("sent_id", *[F.col(c).alias(renamed(c)) for c in columns]), sents)
    got = conllu.nested_blocks(A.nested(sents, known, known, columns), lambda w: F.struct(*[w[c].alias(renamed(c)) for c in columns]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
