"""Documented examples, the automaton's cases, and properties of the functions."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lalespark.functions import harmony as H
from lalespark.functions import phonology as P
from lalespark.functions import tokens as T
from lalespark.operators import analyzer as analyzer_module
from lalespark.operators import annotate as annotate_module
from lalespark.operators import evaluation, lexicon, shards, suffixes, syntax
from lalespark.operators.analyzer import Analyzer, analyze, analyze_tokens, lower
from lalespark.operators.annotate import annotate, trees
from lalespark.operators.sentences import SentenceReader
from lalespark.sources import conllu

WORDS = "ev kitap burun su gitmek ağaç renk çocuk oğul gönül araba okul yazmak bölmek bölüşmek demek yemek okumak istemek söylemek oynamak gelmek".split()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_documented_sounds(spark):
    lit = F.lit
    r = one(
        spark, P.syllables(lit("evlerinden")), P.syllables(lit("yazdırılabileceklerdenmişsiniz")), P.nuclei(lit("öğretmen")), P.is_loanword_candidate(lit("doktor")), P.is_loanword_candidate(lit("kitap")),
        P.turkish_lower(lit("İSTANBUL")), P.last_vowel(lit("kitap")), H.major(lit("a"), lit("ı")), H.major(lit("a"), lit("i")), H.minor(lit("ö"), lit("ü")), H.minor(lit("ö"), lit("i")),
        H.vowel_harmony(lit("ev"), lit("ler")), H.vowel_harmony(lit("ev"), lit("lar")), H.consonant_harmony(lit("kitap"), lit("da")), H.consonant_harmony(lit("kitap"), lit("ta")), P.syllables(lit("trt")),
    )
    assert list(r) == [["ev", "le", "rin", "den"], "yaz dı rı la bi le cek ler den miş si niz".split(), ["ö", "e", "e"], True, False, "istanbul", "a", True, False, True, False, True, False, False, True, ["trt"]]
    r = one(spark, H.internal(F.lit("televizyon")))[0]
    assert not r["full_ok"] and [(v["pos"], v["v1"], v["v2"]) for v in r["violations"]] == [(2, "i", "o")]


def test_nulls(spark):
    null = F.lit(None).cast("string")
    r = one(spark, P.last_vowel(null), H.major(null, F.lit("a")), H.minor(F.lit("a"), null), H.consonant_harmony(F.lit(""), F.lit("da")), P.last_vowel(F.lit("")), T.tokens(null))
    assert list(r) == [None, True, True, True, None, None]


def spec_syllables(word):
    at = [i for i, c in enumerate(word) if c in P.VOWELS]
    if len(at) < 2:
        return [word]
    cuts = [0, *(b if b - a == 1 else b - 1 for a, b in zip(at, at[1:], strict=False)), len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def test_syllables_of_random_words(spark):
    r = random.Random(1)
    words = ["".join(r.choice("aeıioöuübcdrtlnş") for _ in range(r.randint(1, 14))) for _ in range(2000)]
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", P.syllables(F.col("word")).alias("s")).collect()
    assert all(x["s"] == spec_syllables(x["word"]) for x in rows)


def test_tokens(spark):
    r = one(spark, T.tokens(F.lit("Türkiye'nin başkenti, Ankara’dır; 3 kişi_x!")), T.sentences(F.lit("Bir. İki! Üç? Dört.x")), T.comma_flags(F.lit("a, b c,d ,")), T.clean_words(F.lit("«a» (b) c, ... d")))
    assert list(r) == [["Türkiye'nin", "başkenti", "Ankara’dır", "3", "kişi_x"], ["Bir.", "İki!", "Üç?", "Dört.x"], [True, False, True, False], ["«a»", "b", "c", "d"]]


def test_suffix_table(spark):
    rows = suffixes.table(spark).collect()
    assert len(rows) == 286 and len({r["form"] for r in rows}) == 286 and len({r["label"] for r in rows}) == 48 and len(suffixes.SUFFIXES) == 57
    assert sorted(r["form"] for r in rows) == sorted(f for f, *_ in suffixes.forms())
    assert len(suffixes.expand("{D}{I}r")) == 8 and len(suffixes.expand("{I}m{I}z")) == 16
    own = spark.createDataFrame([("ç{A}", "OWN", 2, False)], "template string, label string, min_stem int, exempt boolean")
    assert suffixes.table(spark, own).count() == 288


VALID = [
    ["ÇOĞUL"], ["BULUNMA"], ["AYRILMA", "İYELİK_3T"], ["BULUNMA", "İYELİK_3T", "ÇOĞUL"], ["İLGİ_-ki", "BULUNMA"], ["AYRILMA", "İLGİ_-ki", "BULUNMA"], ["YÖNELME", "YAPIM_-lIk"],
    ["GEÇMİŞ_ZAMAN"], ["KİŞİ_1T", "GEÇMİŞ_ZAMAN"], ["KİŞİ_1T", "GEÇMİŞ_ZAMAN", "OLUMSUZ"], ["GEÇMİŞ_ZAMAN", "EDİLGEN"], ["BİLDİRME", "DUYULAN_GEÇMİŞ"], ["GEÇMİŞ_ZAMAN", "GENİŞ_ZAMAN"],
    ["BELIRTME", "İYELİK_3T", "SIFAT_FİİL_-DIğ"], ["BULUNMA", "MASTAR"], ["İYELİK_3T", "İSİM_FİİL_-mA", "EDİLGEN"], ["ZARF_FİİL_-Ip", "OLUMSUZ"], ["WHATEVER", "BULUNMA"], [],
]
INVALID = [["BULUNMA", "GEÇMİŞ_ZAMAN", "BULUNMA", "YETERLİLİK", "KİŞİ_1T"], ["ÇOĞUL", "BULUNMA"], ["EDİLGEN", "GEÇMİŞ_ZAMAN"], ["YETERLİLİK", "GEÇMİŞ_ZAMAN"], ["BULUNMA", "YÖNELME"]]


def test_automaton(spark):
    rows = [(s, True) for s in VALID] + [(s, False) for s in INVALID]
    out = spark.createDataFrame(rows, "labels array<string>, want boolean").select("labels", "want", suffixes.is_valid_sequence(F.col("labels")).alias("ok")).collect()
    assert all(r["ok"] == r["want"] for r in out)
    for labels, want in rows:
        states = suffixes.START
        for x in labels:
            states = suffixes.step(states, x)
        assert (states != 0) == want
    assert suffixes.step(suffixes.START, "İYELİK_3T/BELIRTME").bit_count() == 2 and suffixes.step(suffixes.START, "İYELİK_2T/TAMLAYAN").bit_count() == 3


def test_roots(spark):
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    lookup = lexicon.root_lookup(words)
    stems = spark.createDataFrame([(s,) for s in "kitab burn suy gid gel ağac reng çocuğ oğl gönl arabas xyz di".split()], "stem string")
    got = {r["stem"]: r["root"] for r in lexicon.find_roots(stems, lookup).collect()}
    assert got == {"kitab": "kitap", "burn": "burun", "suy": "su", "gid": "git", "gel": "gel", "ağac": "ağaç", "reng": "renk", "çocuğ": "çocuk", "oğl": "oğul", "gönl": "gönül", "arabas": "araba", "xyz": None, "di": None}
    assert {r["stem"]: r["root"] for r in lexicon.find_roots_narrowed(stems, lookup).collect()}["di"] == "de"


def test_root_lookup_agrees_with_probing(spark):
    r = random.Random(5)
    letters = "aeıioubdkptğyns"
    words = {"".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(400)} | {"".join(r.choice(letters) for _ in range(r.randint(2, 4))) + "mak" for _ in range(200)}
    probes = sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 5))) for _ in range(4000)})
    lex = Analyzer(words).lexicon
    lookup = lexicon.root_lookup(spark.createDataFrame([(w,) for w in words], "word string"))
    got = lexicon.find_roots(spark.createDataFrame([(p,) for p in probes], "stem string"), lookup).collect()
    assert {x["stem"]: x["root"] for x in got} == {p: lex.root(p) for p in probes}


def test_analyses():
    a = Analyzer(WORDS)
    stem, root, lemma, path = a.analyses("evlerinden")[0]
    assert stem == "ev" and [f for f, _ in path][-1] == "nden" and path[-1][1] == "AYRILMA"
    stem, root, _, path = a.analyses("kitabından")[0]
    assert (stem, root) == ("kitab", "kitap") and path == (("ı", "İYELİK_3T"), ("ndan", "AYRILMA"))
    assert a.analyses("bana")[0][:2] == ("bana", "ben")
    assert a.analyses("mı", "AUX")[0][1] == "mi" and a.analyses("ve", "CCONJ") == [("ve", None, None, ())]
    assert a.analyses("Türkiye'den")[0] == ("türkiye", None, None, (("den", "AYRILMA"),))
    assert a.analyses("gidiyor", "VERB")[0][1] == "git"
    assert a.analyses("istiyor")[0][0] in ("iste", "isti")
    assert a.analyses("yazdırdı", "VERB")[0][0] == "yaz"
    derived = Analyzer([*WORDS, "yazdırmak"])
    assert derived.underived("yazdır") == "yaz" and ("yaz", "yazdır") in [x[1:3] for x in derived.analyses("yazdırdı", "VERB")]
    assert a.analyses("") == [("", None, None, ())] and len(a.analyses("kitapların")) <= 5
    h = Analyzer()
    assert all(root is None and lemma is None for w in ("evlerinden", "kitaplar", "geliyor") for _, root, lemma, _ in h.analyses(w))
    assert lower("IĞDIR İZMİR") == "ığdır izmir"


def test_analyze_frames(spark):
    words = spark.createDataFrame([("evde", None), ("evde", "NOUN"), (None, None), ("evde", None)], "word string, upos string")
    known = spark.createDataFrame([(w,) for w in WORDS], "word string")
    out = analyze(words, known)
    assert out.filter("rank = 1").count() == 2
    toks = spark.createDataFrame([(1, "evde"), (2, "evde"), (3, None)], "id int, word string")
    got = {r["id"]: r["analyses"] for r in analyze_tokens(toks, known).collect()}
    assert got[1] == got[2] and got[1][0]["stem"] == "ev" and got[3] is None


def _parse(text, words=WORDS):
    reader, lex = SentenceReader(Analyzer(words)), syntax.Lexicon(words)
    return syntax.parse(reader.read(text), text, lex)


@pytest.mark.parametrize(
    ("text", "form", "rel", "head"),
    [
        ("Ali eve geldi", "eve", "obl", "geldi"), ("Ali eve geldi", "geldi", "root", None), ("bu kitap", "bu", "det", "kitap"), ("okul için geldi", "için", "case", "okul"),
        ("Ali Cook Jobs geldi", "Jobs", "flat", "Ali"), ("evin kapısı", "evin", "nmod:poss", "kapısı"), ("sık sık geldi", "sık", "compound:redup", "sık"), ("Ali ve Ayşe geldi", "ve", "cc", "Ayşe"),
        ("üç kitap aldı", "üç", "nummod", "kitap"), ("Hava güzel", "güzel", "root", None), ("Ali de geldi", "de", "advmod:emph", "Ali"), ("sabah geldi", "sabah", "obl", "geldi"),
    ],
)
def test_relations(text, form, rel, head):
    tokens = _parse(text)
    t = next(t for t in reversed(tokens) if t.form == form)
    assert t.rel == rel and (head is None and t.head == 0 or tokens[t.head - 1].form == head)


def test_every_word_is_attached():
    r = random.Random(7)
    vocabulary = "Ali ve ya da bir çok eve kitabı geldi gidiyor güzel üç ama için değil mi ki hem sabah yardım etti okuyan çocuk koşarak gitmek istiyor benim evim olarak yüzde 5 Ankara'da".split()
    for _ in range(400):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", ", "]) for _ in range(r.randint(1, 12)))
        tokens = _parse(text)
        assert all(0 <= t.head <= len(tokens) and t.rel != "_" for t in tokens)
        assert sum(t.rel == "root" for t in tokens) == 1
        assert sum(1 for t in tokens if t.rel == "obj") <= len({t.head for t in tokens if t.rel == "obj"})


def test_annotate(spark, tmp_path):
    sents = spark.createDataFrame([("1", "Ali eve geldi."), ("2", None), ("3", "...")], "sent_id string, text string")
    known = spark.createDataFrame([(w,) for w in WORDS], "word string")
    out = annotate(sents, known, known)
    assert [(r["form"], r["deprel"]) for r in out.orderBy("id").collect()] == [("Ali", "nsubj"), ("eve", "obl"), ("geldi", "root")]
    shown = {r["sent_id"]: r["tree"] for r in trees(sents, known, known).collect()}
    assert shown["1"] == "└── geldi [root]\n    ├── Ali [nsubj]\n    └── eve [obl]" and shown["2"] == shown["3"] == "(boş)"
    assert annotate(sents, known, known, trace=True).filter("deprel_after = 'root'").count() == 1
    only = annotate(sents, known, known, rules=[syntax.predicate])
    assert only.filter("deprel = 'root'").count() == 1 and only.filter("deprel = '_'").count() == 2
    tokens = out.select("sent_id", "id", "form", F.col("stem").alias("lemma"), "upos", "feats", "head", "deprel")
    conllu.write(tokens, str(tmp_path / "out"), sents)
    back = conllu.tokens(conllu.read(spark, str(tmp_path / "out")))
    assert sorted(map(tuple, back.select("sent_id", "id", "form", "head", "deprel").collect())) == sorted(map(tuple, tokens.select("sent_id", "id", "form", "head", "deprel").collect()))


def test_conllu_source(spark, tmp_path):
    text = "# sent_id = a\n# text = x y\n1-2\txy\t_\t_\t_\t_\t_\t_\t_\t_\n1\tx\tx\tNOUN\t_\t_\t2\tnsubj\t_\t_\n2\ty\ty\tVERB\t_\tTense=Past\t0\troot\t_\t_\n2.1\tz\tz\tX\t_\t_\t_\t_\t_\t_\nbad\n\n# sent_id = b\n1\tq\tq\tPUNCT\t_\t_\t0\troot\t_\t_\n\n"
    (tmp_path / "f.conllu").write_text(text, encoding="utf-8")
    blocks = conllu.read(spark, str(tmp_path / "f.conllu"))
    assert [(r["sent_id"], r["id"], r["form"]) for r in conllu.tokens(blocks).orderBy("sent_id", "id").collect()] == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "q")]
    assert [tuple(r) for r in conllu.ranges(blocks).collect()] == [("a", 1, 2, "xy")]
    assert conllu.flat_tokens(spark.read.text(str(tmp_path / "f.conllu"))).count() == 3
    (tmp_path / "w.txt").write_text("Ev\n\n kitap \nev\n", encoding="utf-8")
    assert sorted(r["word"] for r in lexicon.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["ev", "kitap"]


def test_glosses(spark, capsys):
    from lalespark.functions import glosses as G

    known = spark.createDataFrame([(w,) for w in WORDS], "word string")
    rows = analyze(spark.createDataFrame([("kitabından",), ("ev",), ("evlerinden",)], "word string"), known)
    c = [F.col(x) for x in ("root", "stem", "suffixes")]
    best = {r["word"]: tuple(r)[1:] for r in rows.filter("rank = 1").select("word", G.tagged(*c), G.segmented(*c), G.gloss(*c)).collect()}
    assert best["kitabından"] == ("kitap+P3sg+Abl", "kitap-ı-ndan", "kitap-P3SG-ABL") and best["ev"] == ("ev", "ev", "ev")
    shown = {r["word"]: r["report"] for r in G.reports(rows).collect()}
    assert shown["ev"] == "  Sözcük : ev\n  Kök    : ev\n  Ekler  : (ek bulunamadı)\n  Ayrım  : ev\n  Uyum   :\n  (tek ünlülü sözcük – uyum kontrolü gerekmez)\n"
    assert "olası çözümleme" in shown["evlerinden"] and "BÜU:✓" in shown["evlerinden"]
    table = {r["word"]: tuple(r)[1:] for r in G.ambiguity(rows).collect()}
    assert table["ev"] == ("ev", "—", "—") and all(len(v) == 3 for v in table.values())
    lines = G.interlinear(annotate(spark.createDataFrame([("1", "Ali eve geldi ve kitabından yazdı.")], "sent_id string, text string"), known, known)).orderBy("chunk").collect()
    assert len(lines) == 2 and all(len(r["segments"]) == len(r["glosses"]) for r in lines)
    same = G.compared(rows, spark.createDataFrame([("kitabından", "kitap"), ("yok", "var")], "word string, lemma string")).collect()
    assert {r["word"]: r["ok"] for r in same} == {"kitabından": True, "yok": False}


def test_stream(spark, tmp_path):
    from lalespark import streaming

    spark.createDataFrame([(1, "Ali eve geldi. Gitti."), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(w,) for w in WORDS], "word string")
    stream = streaming.annotated(streaming.texts(spark, str(tmp_path / "in")), known, known)
    q = stream.writeStream.format("memory").queryName("annotated_words").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("annotated_words").count() == 4


TURKISH = "Ali eve geldi. Bu kitabı okuldan aldım, eve götürdüm. Kitapları Ankara'dan gelen çocuk okudu. Güzeldir. A'b c''d 'e kitaplarımızdan yazdırılan ağaçlı renksiz evden, evdir. Su, suyu; de ye yi di. K b x"


def test_large_dictionary(spark, monkeypatch):
    """A dictionary too large for a broadcast is dealt out with the words, and gives the same results."""
    words = spark.createDataFrame([(w,) for w in WORDS + "güzel ankara at ot bul al aç a'bcde kitapçık okutmak".split()], "word string")
    sents = spark.createDataFrame([("1", TURKISH), ("1", TURKISH), ("2", None), (None, "Okula gelen çocuk evi gördü."), ("4", "...")], "sent_id string, text string")
    rows = spark.createDataFrame([(w, u) for w in TURKISH.replace(",", " ").replace(".", " ").split() for u in (None, "VERB", "NOUN")] + [(None, None)], "word string, upos string")
    shown = lambda df: sorted(map(str, df.collect()))
    run = lambda: [shown(x) for x in (analyze(rows, words), annotate(sents, words, words), annotate(sents, words, None), annotate(sents, words, words, trace=True), annotate(sents, None, words, adjectives=["güzel"]), trees(sents, words, words))]
    want = run()
    assert all(want) and len(want[1]) > 60
    for module in (analyzer_module, annotate_module):
        monkeypatch.setattr(module, "MOST_WORDS", 20)
    monkeypatch.setattr(shards, "HOT_WORDS", 5)
    for w, h in zip(want, run(), strict=True):
        assert w == h


def test_command_line(tmp_path):
    """Words as arguments with a dictionary file, and words from the terminal."""
    root = Path(__file__).resolve().parent.parent
    (tmp_path / "words.txt").write_text("ev\n Kitap \n\nev\n", encoding="utf-8")
    run = lambda args, given=None: subprocess.run([sys.executable, "-m", "lalespark", *args], cwd=root, input=given, capture_output=True, text=True, timeout=300)
    out = run(["-d", str(tmp_path / "words.txt"), "evlerinden", "kitabı"]).stdout
    assert "Sözcük : evlerinden" in out and "Kök    : ev" in out and "Kök    : kitap" in out
    out = run(["-i"], "evde\nq\nokulda\n").stdout
    assert "Sözcük : evde" in out and "okulda" not in out


def test_word_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("ev\n Kitap \r\n\nev\n\t\n", encoding="utf-8")
    assert sorted(r["word"] for r in lexicon.read_words(spark, str(tmp_path / "words.txt")).collect()) == ["ev", "kitap"]


def test_benchmark_of_text(spark, tmp_path):
    """Gold CoNLL-U with punctuation, a range and a missing text against the parser."""
    text = (
        "# sent_id = a\n# text = Ali eve geldi.\n1\tAli\tAli\tPROPN\t_\t_\t3\tnsubj\t_\t_\n2\teve\tev\tNOUN\t_\t_\t3\tobl\t_\t_\n3\tgeldi\tgel\tVERB\t_\t_\t0\troot\t_\t_\n4\t.\t.\tPUNCT\t_\t_\t3\tpunct\t_\t_\n\n"
        "# sent_id = b\n# text = Evdeki geldi\n1-2\tEvdeki\t_\t_\t_\t_\t_\t_\t_\t_\n1\tEvde\tev\tADJ\t_\t_\t3\tamod\t_\t_\n2\tki\tki\tADP\t_\t_\t1\tcase\t_\t_\n3\tgeldi\tgel\tVERB\t_\t_\t0\troot\t_\t_\n\n"
        "# sent_id = c\n1\tGel\tgel\tVERB\t_\t_\t0\troot\t_\t_\n"
    )
    (tmp_path / "gold.conllu").write_text(text, encoding="utf-8")
    known = spark.createDataFrame([(w,) for w in WORDS], "word string")
    al = evaluation.benchmark(conllu.read(spark, str(tmp_path / "gold.conllu")), known)
    assert evaluation.scores(al).first()["total"] == 6
    by = {(r["sent_id"], r["id"]): r for r in al.collect()}
    assert all(by["a", k]["las_ok"] for k in (1, 2, 3)) and by["b", 1]["form"] == "Evdeki" and by["b", 2]["las_ok"]
    assert by["c", 1]["p_deprel"] is None and not by["c", 1]["head_ok"]
    lost = {r["deprel"]: r["loss"] for r in evaluation.losses(al).collect()}
    assert lost["root"] == 1 and sum(r["n"] for r in evaluation.mixed_up(al).collect()) == sum(lost.values())
    got = evaluation.compared(spark.createDataFrame([("kitabı", "kitap", "NOUN"), ("ama", None, "CCONJ"), ("ben", "yok", None)], "word string, lemma string, upos string"), known)
    assert {r["word"]: (r["lemma_ok"], r["upos_ok"]) for r in got.collect()} == {"kitabı": (True, True), "ama": (None, True), "ben": (False, None)}
