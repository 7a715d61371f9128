"""Clashing columns, hostile inputs, and brute-force versions of what test_operators.py checks by properties only."""

import gzip
import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lalespark.llm import caps, common, decontaminate, hamming, importance, langid, linededup, maintext, packing, queries, simhash, substring, warc
from lalespark.llm.common import removed, shared_dir, table, unused, written

TAKEN = ("_d", "_D_", "_t1", "_t2", "_starts", "score", "lang_pred", "d", "t1", "text_", "tile", "key", "value", "rep", "start", "length", "bucket")


def prose(r, n, vocabulary=200):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with columns named like the stages' own."""
    r = random.Random(2)
    langs = {"en": "the house and the sea of a river", "xx": "zul gra bohn wix kel dorum"}
    rows = []
    for k in range(60):
        lang = ("en", "xx")[k % 2]
        own = langs[lang].split()
        rows.append((k, "\n".join(" ".join(r.choice(own) for _ in range(9)) for _ in range(4)), lang))
    rows += [(60, rows[3][1], "xx"), (60, rows[3][1], "xx"), (None, "the river\nand the sea", None), (61, "12 ½ ² Ⅷ", "en"), (62, "bench mark item text of a test", "en"), (63, "", "en"), (64, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in TAKEN:
        df = df.withColumn(c, F.lit(f"mine {c}"))
    return df


@pytest.mark.parametrize("stage", ["langid", "linededup", "simhash", "decontaminate"])
def test_stage_columns(spark, clashing, stage):
    items = spark.createDataFrame([(None, "bench mark item text of a test"), (1, None)], "item_id long, text string")
    run = {"langid": langid.stage, "linededup": linededup.stage, "simhash": simhash.stage, "decontaminate": lambda d: decontaminate.stage(d, items)}[stage]
    out = run(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in TAKEN)
    ids = Counter(r["doc_id"] for r in rows)
    if stage == "langid":
        assert {61, 63, 64}.isdisjoint(ids) and ids[60] == 2 and set(range(60)) <= set(ids)
    if stage == "decontaminate":  # items of null id count too
        assert 62 not in ids and sum(ids.values()) == clashing.count() - 1
    if stage == "simhash":
        assert ids[60] == 0 and max(ids.values()) == 1


def test_packing_stage_columns(clashing):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter(tuple([*enc.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in clashing.collect())
    by = defaultdict(list)
    for r in packing.stage(clashing, queries.tokenizer_path()).collect():
        by[r["doc_id"], r["doc_tokens"]].append(r)
        assert 1 << r["bucket"] == r["length"] == len(r["ids"])
    assert sum(r["length"] for rows in by.values() for r in rows) == sum(len(k) * n for k, n in want.items())


def thue_morse(n):
    return "".join("ab"[k.bit_count() & 1] for k in range(n))


def test_packing_words_with_equal_hashes(spark, tmp_path):
    """Words whose polynomial hashes agree in every base are still told apart."""
    from tokenizers import Tokenizer

    from lalespark.llm import textscan

    enc = Tokenizer.from_file(queries.tokenizer_path())
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        one = thue_morse(n)
        two = one.translate(str.maketrans("ab", "ba"))
        data = np.frombuffer(f"{one} {two}".encode(), dtype=np.uint8)
        start, end = textscan.spans(data, np.zeros(1, dtype=np.int64), textscan.BLANKS)
        hashes = textscan.word_hashes(data, start, end)
        assert hashes[0] == hashes[1]
        rows.append((k, f"{one} and {two}, {two} {one}!"))
    rows += [(9, "x" * 30_000 + " y"), (10, "a b c　d é É ß"), (11, "<|end|> one"), (12, "\t\n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for packed in (packing.pack(docs, queries.tokenizer_path(), with_ids=True), packing.stage(docs, queries.tokenizer_path())):
        by = defaultdict(list)
        for r in packed.collect():
            by[r["doc_id"]].append(r)
        for k, text in rows:
            assert [x for p in sorted(by[k], key=lambda p: p["start"]) for x in p["ids"]] == [*enc.encode(text, add_special_tokens=False).ids, 2]
    packing.write(packing.pack(docs, queries.tokenizer_path()), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.filter("length = shiftleft(1, bucket)").count() == back.count() == sum(map(len, by.values()))


def brute_langid(rows, penalty=1.0):
    """The backoff, word by word, over the whole training texts."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 5 and lang and text:
            words[lang].update(langid._WORD.findall(text.lower()))
    for lang, c in words.items():
        for w, n in c.items():
            s = f"^{w}$"
            for size in range(1, 6):
                for k in range(len(s) - size + 1):
                    grams[lang][s[k : k + size]] += n
    langs = sorted(words)
    total = {x: sum(words[x].values()) + 1 for x in langs}
    by_size = {(x, n): sum(c for g, c in grams[x].items() if len(g) == n) + 1 for x in langs for n in range(1, 6)}
    known = set().union(*words.values())
    known_grams = set().union(*grams.values())

    def one(w):
        if w in known:
            return [math.log((words[x][w] + 0.1) / total[x]) for x in langs]
        s = f"^{w}$"
        for n in range(5, 0, -1):
            own = [s[k : k + n] for k in range(len(s) - n + 1) if s[k : k + n] in known_grams]
            if own:
                return [sum(math.log((grams[x][g] + 0.1) / by_size[x, n]) for g in own) / len(own) - penalty * (6 - n) for x in langs]
        return [-20.0] * len(langs)

    out = {}
    for i, text, _ in rows:
        found = langid._WORD.findall((text or "").lower())
        if not found or not langs:
            out[i] = ("und", 0.0)
            continue
        sums = [sum(v) for v in zip(*map(one, found), strict=True)]
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out[i] = (langs[best], 1 / sum(math.exp(max(-700, s - sums[best])) for s in sums))
    return out


def test_langid_brute(spark):
    r = random.Random(4)
    alphabets = {"de": "abcdeßü", "fr": "cdefgéà", "hi": "कखगा", "tr": "ışğabç"}
    rows = []
    for k in range(160):
        lang = sorted(alphabets)[k % 4]
        text = " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 30)))
        rows.append((k, text, lang if k % 7 else None))
    rows += [(900, "½ ² Ⅷ 12 _", "de"), (901, None, "de"), (902, "", None), (903, "Ω ж", None), (904, "cde " * 40_000, None), (None, "only here", "zz")]
    want = brute_langid(rows)
    have = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(have) == set(want)
    for i, (lang, score) in want.items():
        assert have[i][0] == lang and abs(have[i][1] - score) < 1e-6, i
    assert have[900] == ("und", 0.0) and "zz" not in {x for x, _ in have.values()}


def test_langid_ties(spark):
    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5][:2]
    rows = [(ids[0], "same words here", "b"), (ids[1], "same words here", "a"), (1000, "same words", None), (1001, "other", None)]
    out = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(out.values()) == {("a", 0.5)}


def test_langid_many_languages(spark):
    """All languages are learned, however many there are."""
    r = random.Random(6)
    rows = []
    for k in range(260):
        own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)]
        rows += [(10 * k + j, " ".join(r.choice(own) for _ in range(40)), f"l{k:03}") for j in range(6)]
    out = {x["doc_id"]: x["lang_pred"] for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5}
    assert len(learned) == 260 and all(out[i] == lang for i, _, lang in rows)


def test_importance_brute(spark):
    r = random.Random(8)
    rows = [(k, prose(r, r.randint(1, 60), 40 if k % 3 else 90)) for k in range(300)] + [(300, None), (301, ""), (302, "!? "), (5, rows_text := prose(r, 20)), (5, rows_text), (None, "w1 w2"), (303, "w1 w2 " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("d", "t", "key", "target", "log_weight", "n_features")})
    labels = spark.createDataFrame([(k, int(k % 3 > 0), int(k % 11 == 0)) for k in range(200)] + [(None, 1, 0), (7, None, None), (250, 1, None)], "doc_id long, quality int, toxic int")
    good = {k for k in range(200) if k % 3 and k % 11} | {250}

    def buckets(text):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        return importance.features(data, np.array([0, len(data)]))[1]

    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, text in rows:
        for b in buckets(text):
            raw[b] += 1
            target[b] += i in good
    like_raw = (raw + 1) / (raw + 1).sum()
    prior = max(1.0, 0.01 * target.sum())
    ratio = [math.log((t + prior * p) / (target.sum() + prior)) - math.log(p) for t, p in zip(target, like_raw, strict=True)]
    want = Counter((i, round(sum(ratio[b] for b in buckets(text)), 6), len(buckets(text))) for i, text in rows)
    out = importance.select(docs, labels, 0.4).collect()
    assert Counter((x["doc_id"], round(x["log_weight"], 6), x["n_features"]) for x in out) == want
    assert sum(x["selected"] for x in out) == round(0.4 * len(rows))
    assert min(x["gumbel_key"] for x in out if x["selected"]) >= max(x["gumbel_key"] for x in out if not x["selected"])
    # The noise is the same at any power, so keys differ by the weights alone.
    plain, half = ({(x["doc_id"], x["n_features"]): x for x in importance.select(docs, labels, 0.4, power).collect()} for power in (1.0, 0.5))
    for k, x in plain.items():
        assert abs(x["gumbel_key"] - half[k]["gumbel_key"] - 0.5 * x["log_weight"]) < 1e-6
    for x in out:
        noise = plain[x["doc_id"], x["n_features"]]["gumbel_key"] - x["log_weight"]
        assert abs(x["gumbel_key"] - noise - x["log_weight"] * 200 / max(1, x["n_features"])) < 1e-6
    none = importance.select(docs, labels.limit(0))
    assert none.filter("log_weight <> 0").count() == 0 and none.filter("selected").count() == len(rows)


@pytest.mark.parametrize("n", [10, 10_000, 3_000_000, 10**8, 2 * 10**10])
def test_simhash_keys(n):
    """Fingerprints that link agree in a key; a key's value holds a bounded number of evenly spread ones."""
    own = simhash.keys(n, False, 3)
    r = np.random.default_rng(n % 97)
    a = r.integers(0, 2**63, (400, 1), dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << r.integers(0, 64, b.shape).astype(np.uint64)
    assert (simhash.key_values(a, own) == simhash.key_values(b, own)).any(axis=1).all()
    assert n / 2 ** own.shape[1] <= 2 * simhash.PER_KEY and own.max() < 64
    wide = simhash.keys(n, True, simhash.WIDE_MOST)
    assert 1 - (1 - simhash.AGREES ** wide.shape[1]) ** len(wide) >= simhash.GOAL and n / 2 ** wide.shape[1] <= 2 * simhash.PER_WIDE_KEY


def test_simhash_goes_through_the_index(spark, monkeypatch):
    """On an ordinary table groups are larger than a node, and those are searched by the index and nothing else."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    codes = np.array([int(x["fingerprint"], 16) for x in simhash.near_duplicates(docs).select("fingerprint").distinct().collect()], dtype=np.uint64).reshape(-1, 1)
    own = simhash.keys(len(codes), False, 3)
    values = simhash.key_values(codes, own)
    _, sizes = np.unique(values[:, 0], return_counts=True)
    assert (sizes > simhash.FAN).all() and sizes.max() > 32
    asked = []

    class Watched(hamming.GrayIndex):
        def search(self, queries, most):
            asked.append(len(queries))
            return super().search(queries, most)

    order = np.argsort(values[:, 0], kind="stable")
    group = np.flatnonzero(np.append(True, np.diff(values[order, 0]) != 0))
    args = codes[order], group, np.arange(len(codes)), np.zeros(len(codes), dtype=int), np.zeros(len(group), dtype=bool), 3
    found = set(zip(*simhash.forest(*args), strict=True))
    monkeypatch.setattr(simhash, "GrayIndex", Watched)
    assert set(zip(*simhash.forest(*args), strict=True)) == found and sum(asked) == len(codes)
    monkeypatch.setattr(Watched, "search", lambda self, queries, most: iter(()))
    assert not set(zip(*simhash.forest(*args), strict=True))


def test_simhash_groups():
    """Forests of groups of any size, one of one, of a node, of many, and of two tiles."""
    r = np.random.default_rng(3)
    for words, most in ((1, 3), (8, 85)):
        sizes = [1, 2, 4, 5, 16, 17, 90]
        centre = r.integers(0, 2**63, (12, words), dtype=np.uint64)
        codes = centre[r.integers(0, 12, sum(sizes))] ^ (np.uint64(1) << r.integers(0, 64, (sum(sizes), words)).astype(np.uint64))
        start = np.cumsum([0, *sizes[:-1]])
        tile, cross = r.integers(0, 2, len(codes)), np.array([False] * 6 + [True])
        reps = r.permutation(len(codes)) + 5
        a, b = simhash.forest(codes, start, reps, tile, cross, most)
        label = dict(zip(a.tolist(), b.tolist(), strict=True))
        for lo, n, two in zip(start, sizes, cross, strict=True):
            root = {k: k for k in range(lo, lo + n)}
            for _ in range(n):
                for i in range(lo, lo + n):
                    for j in range(lo, i):
                        if int(np.bitwise_count(codes[i] ^ codes[j]).sum()) <= most and (not two or tile[i] != tile[j]):
                            root[i] = root[j] = min(root[i], root[j])
            for k in range(lo, lo + n):
                own = min(int(reps[x]) for x in root if root[x] == root[k])
                assert label.get(int(reps[k]), int(reps[k])) == own


LONG = "A long sentence, with commas, that tells the reader what happened; and another one, which says why it did. And then some more, of course."


@pytest.mark.parametrize("page", ["<a " * 350_000, "<div>" * 200_000, "<div>x" * 100_000, "<title " * 150_000, "<svg>" * 200_000, "<b>" * 100_000 + "<p>x" * 100_000, "<div>" * 100_000 + "</p>" * 250_000, '<a href="' * 100_000, "<!--" * 250_000, "<" * 10**6, "<li>x" * 200_000])
def test_maintext_hostile_pages(page):
    """About a megabyte of markup that never closes is read in linear time."""
    began = time.process_time()
    maintext.main_text(page)
    assert time.process_time() - began < 4


def test_maintext_markup():
    text = maintext.main_text
    assert text(f"<a href=it's>x</a><article><p>{LONG} It's late.</p></article>") == f"{LONG} It's late."
    assert text('<p title="1 > 0">a 1 < 2, and 3 > 2</p>') == "a 1 < 2, and 3 > 2"
    assert text(f"<article><p>{LONG}</p><p>cut off <b cla") == f"{LONG} cut off"
    assert text(f"<article><p>{LONG}</p><button>Go<p>{LONG}</p></article>") == LONG
    assert text(f"<article><p>{LONG}</p><SCRIPT>if (a < b) '</p>'</SCRIPT ><p>{LONG}</p></article>") == f"{LONG} {LONG}"
    assert text(f"<!DOCTYPE html><?x y?><article><!-- no > no --><p>{LONG}</p></article>") == LONG


def test_maintext_ratios_decide(monkeypatch):
    """Without the threshold on path ratios other text comes out, with and without an article."""
    short = '<div class="q1"><i>Share</i></div><div class="q2">Cheap shoes</div>'
    for tag in ("article", "div", "section"):
        page = f"<body><{tag}><p>{LONG}</p>{short}<p>{LONG}</p></{tag}><div><div>Hot now</div></div></body>"
        assert maintext.main_text(page) == f"{LONG} {LONG}"
        with monkeypatch.context() as m:
            m.setattr(maintext, "_ratios", lambda page: (np.ones(len(page.texts), dtype=bool), np.ones(len(page.texts), dtype=bool)))
            assert "Cheap shoes" in maintext.main_text(page)


def test_maintext_columns(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None)], "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "t")})
    out = maintext.extract(rows).collect()
    assert sorted((x["page_id"] or 0, x["text"], x["n_chars"]) for x in out) == [(0, "", 0), (1, LONG, len(LONG)), (1, LONG, len(LONG))]


def record(kind, name, body, extra=b"", eol=b"\r\n"):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, *([extra] if extra else []), b"Content-Length: %d" % len(body)]
    return eol.join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_warc_foreign(spark, tmp_path):
    """Archives of another origin: a member a record, no compression, several members of several records."""
    bodies = [b"software: x\r\n", b"HTTP/1.1 200 OK\r\n\r\n<p>one</p>\r\n\r\nWARC/1.0", b"", bytes(range(256)) * 9000]
    all_ = [record(b"warcinfo", b"<urn:uuid:1>", bodies[0]), record(b"response", b"<urn:uuid:2>", bodies[1], b"warc-payload-digest: sha1:ABC"), record(b"request", b"<urn:uuid:3>", bodies[2]), record(b"response", b"<urn:uuid:4>", bodies[3], b"WARC-Target-URI: http://x/\xff")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(map(gzip.compress, all_)))
    (tmp_path / "in/b.warc").write_bytes(b"".join(all_))
    (tmp_path / "in/c.warc.gz").write_bytes(gzip.compress(b"".join(all_[:3])) + gzip.compress(all_[3]))
    rows = warc.read(spark, str(tmp_path / "in")).collect()
    want = Counter((k, len(b), hashlib.sha256(b).hexdigest()) for k, b in zip(("warcinfo", "response", "request", "response"), bodies, strict=True))
    assert Counter((x["record_type"], x["body_bytes"], x["body_digest"]) for x in rows) == Counter({k: 3 * n for k, n in want.items()})
    assert all(x["p"] is None for x in rows) and {x["said"] for x in rows} == {None, "sha1:ABC"}
    whole = b"".join(map(gzip.compress, all_))
    for bad in (whole[:-20], b"".join(all_)[:-9], b"".join(all_) + b"junk", b"HTTP/1.1 200 OK\r\n\r\n"):
        with pytest.raises((ValueError, KeyError, zlib.error)):
            list(warc.parse(warc.pieces(bad)))
    assert list(warc.parse(warc.pieces(b""))) == []


def test_warc_large_pages(spark, tmp_path):
    """Pages of megabytes go to files of about the wanted size, beside many small ones, and come back whole."""
    r = random.Random(3)
    rows = [(k, "u", f"{k} " + "".join(r.choice("abcdefgh é") for _ in range(1000)) * 3000) for k in range(6)] + [(k, "v", "s" * 120 + str(k % 50)) for k in range(6, 400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("p", "digest", "payload", "refers", "value")}).coalesce(1)
    path = str(tmp_path / "w")
    warc.write(pages, path, file_bytes=8 << 20)
    sizes = [sum(len(p) for p in warc.pieces(f.read_bytes())) for f in (tmp_path / "w").glob("*.gz")]
    assert len(sizes) > 2 and max(sizes) < 20 << 20
    out = {x["page_id"]: x for x in warc.round_trip(pages).collect()}
    first: dict = {}
    for k, _, html in rows:
        body = html.encode()
        assert (out[k]["payload_bytes"], out[k]["payload_digest"], out[k]["refers_to"]) == (len(body), hashlib.sha256(body).hexdigest(), first.get(body))
        first.setdefault(body, k)


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_substring_copies(spark, monkeypatch, hot):
    """Copies are found alike by broadcast and by join."""
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    rows = [(k, f"text {k % 7}") for k in range(40)] + [(k, f"own {k}") for k in range(40, 60)] + [(None, "text 3"), (None, "text 3"), (70, None), (71, ""), (2, "text 5")]
    keys = substring.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    low = {}
    for k, t in rows:
        low.setdefault(t, []).append(-(2**63) if k is None else k)
    want = {(k, t) for k, t in rows if t and k is not None and k > min(low[t])}
    text = {(x["t1"], x["t2"]): x["text"] for x in keys.collect()}
    assert {(x["d"], text[x["t1"], x["t2"]]) for x in substring.copies(keys).collect()} == want


def test_warc_hot_payload(spark):
    """One payload on most pages, of null and repeated ids too."""
    hot = "<html>" + "not found " * 30
    rows = [(k, f"u{k}", hot if k % 3 else f"{hot}{k % 30}") for k in range(3000)] + [(None, None, hot), (7, "u7", hot), (5000, "x", "short")]
    want, first = Counter(), {}
    for p, _, html in rows:
        first[html] = min(first.get(html, 10**9), -1 if p is None else p)
    for p, _, html in rows:
        raw, own = html.encode(), -1 if p is None else p
        old = len(raw) >= 100 and own > first[html]
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if old else "response", None if not old or first[html] < 0 else first[html]] += 1
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in out.collect()) == want


def test_caps_columns(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("d", "v", "rep", "n", "code", "dim", "codes", "tile", "component", "label")})
    out = sorted(((x["vec_id"] or 0, x["n_links"], x["component_id"], x["kept"]) for x in caps.near_duplicates(df).collect()), key=str)
    assert out == sorted([(0, 2, None, True), (0, 2, None, True), (1, 2, None, False), (2, 1, 2, True), (2, 1, 2, True)], key=str)


def leaning(r, n, dim, mean):
    """Unit vectors with a common direction: two of them have the cosine `mean` on average."""
    m = r.standard_normal(dim)
    x = math.sqrt(mean) * m / np.linalg.norm(m) + math.sqrt((1 - mean) / dim) * r.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("mean", [0.0, 0.2, 0.5, 0.8])
def test_caps_load(mean):
    """A common direction costs no more pair checks than all pairs, and up to 0.5 not more than none does."""
    r = np.random.default_rng(31)
    x = leaning(r, 2048, 64, mean)
    words, shift = caps.fitted(20_000, 64, x)
    book = caps.codebook(64, words)
    cost = caps.load(x - shift, book)
    assert cost <= (0.4 if mean <= 0.5 else 1.0)
    a = leaning(np.random.default_rng(31), 4096, 64, mean)[2048:]  # other rows of the same kind
    for to in (np.roll(a, 1, axis=0), r.standard_normal(a.shape)):
        assert caps.sharing(a[:1000] - shift, caps.turned(a, to, 0.9)[:1000] - shift, book) >= 0.96


@pytest.mark.parametrize("mean", [0.5, 0.8])
def test_caps_leaning(spark, mean):
    """Against all pairs, on vectors with a common direction, near copies among them."""
    r = np.random.default_rng(32)
    x = leaning(r, 1500, 64, mean)
    x = np.concatenate([x, x[:500] + 0.4 * r.standard_normal((500, 64)) / 8, x[:100]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    have = {r["vec_id"]: r["n_links"] for r in caps.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert len(have) == len(x) and all(have[i] <= want[i] for i in have)
    assert sum(have.values()) >= 0.97 * want.sum() > 400


def test_tables_go(spark):
    df = written(spark.range(10), "gone")
    other = spark.range(3)
    assert unused(df, "ID") == "ID_" and unused(df, "x") == "x"
    removed(spark, other)  # nothing of ours
    files = df.inputFiles()
    removed(spark, df)
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0])
    assert shared_dir(spark).split(":")[-1] in files[0] and not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before kept, against the operator it calls."""
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, sf_dir)
    found = {x["doc_id"]: x for x in langid.identify(docs).collect()}
    assert {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, x in found.items() if x["lang_pred"] != "und" and x["score"] >= 0.5}
    left = stages["line_dedup"](spark, kept, sf_dir)
    lines = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(kept).collect()}
    assert {x["doc_id"]: x["text"] for x in left.collect()} == {i: t for i, t in lines.items() if t.strip()}
    near = stages["near_dedup"](spark, left, sf_dir)
    assert near.columns == docs.columns and near.select("text").distinct().count() == near.count()
    clean = stages["decontamination"](spark, near, sf_dir)
    leaks = {x["doc_id"] for x in decontaminate.contaminated(near, table(spark, sf_dir, "benchmark")).collect()}
    assert {x["doc_id"] for x in clean.collect()} == {x["doc_id"] for x in near.collect()} - leaks
    packed = stages["packing"](spark, clean, sf_dir)
    assert {x["doc_id"] for x in packed.select("doc_id").collect()} == {x["doc_id"] for x in clean.collect()}


def test_decontaminate_brute(spark, sf_dir):
    """Against all pairs of documents and items: nothing is found that a passage doesn't hold, and what holds 0.8 of the
    shingles of question and answer is found, be it edited."""
    r = random.Random(15)
    items = [(x["item_id"], x["text"]) for x in table(spark, sf_dir, "benchmark").collect()]
    rows = [(x["doc_id"], x["text"]) for x in table(spark, sf_dir, "documents").collect()]
    for k in range(300):  # items with some words changed, among others
        own = r.choice(items)[1].split()
        for _ in range(r.randint(0, max(1, len(own) // 12))):
            own[r.randrange(len(own))] = "changed"
        rows.append((10**6 + k, f"{prose(r, 60)} {' '.join(own)} {prose(r, 90)}"))

    def shares(text, words):
        out = []
        for part in decontaminate.parts(text):
            own = decontaminate.words(part)[0]
            n = min(5, len(own))
            want = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            have = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if own else set()
            out.append(len(want & have) / len(want) if want else 1.0)
        return min(out)

    split = {i: decontaminate.words(t or "")[0] for i, t in rows}
    want = {(i, j) for i, w in split.items() for j, t in items if decontaminate.words(t)[0] and shares(t, w) >= 0.8}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    have = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert have <= want and len(have) >= 0.98 * len(want) and len(want) > 150


def test_decontaminate_hostile(spark):
    """A very long text, ties between items, repeated rows and clashing columns."""
    r = random.Random(16)
    long = prose(r, 200_000, 10**5)
    items = [(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (3, "eta theta iota kappa lambda mu nu")]
    rows = [(1, f"{long} {items[2][1]} {long}"), (1, "x alpha beta gamma delta epsilon zeta y"), (2, "x alpha beta gamma delta epsilon zeta y"), (2, "x alpha beta gamma delta epsilon zeta y"), (None, items[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("d", "item_id", "score", "term", "_d")})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("shard", "term", "df", "d")})
    out = Counter((x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, tests).collect())
    assert out == Counter({(1, 3): 1, (1, 1): 1, (1, 2): 1, (2, 1): 2, (2, 2): 2, (None, 3): 1})
    assert decontaminate.stage(docs, tests).count() == 0
