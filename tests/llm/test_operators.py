"""Each operator against a brute-force version on small tables with nulls, ties, repeated rows and hot groups."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

import corpus_pipeline
from lalespark.llm import caps, decontaminate, hamming, importance, langid, linededup, maintext, packing, queries, simhash, substring, warc
from lalespark.llm.automaton import SuffixAutomaton
from lalespark.llm.common import table, tiled
from lalespark.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(r, n, vocabulary=300):
    return " ".join(f"w{int(r.paretovariate(0.6)) % vocabulary}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    base = [words(r, r.choice([0, 1, 3, 19, 20, 21, 40, 80, 200])) for _ in range(60)]
    shared = words(r, 30, 10**6)
    out = [*base, *base[:8], None, "", "   ", "x", "tek başına söz"]
    for t in base[10:40]:  # near copies
        w = t.split()
        for _ in range(r.randint(1, 3)):
            if w:
                w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{words(r, 30)} {shared}\n{words(r, 30)}" for _ in range(40)]
    out += [" ".join(["same"] * 70), "a b c\n" * 30, "l1\nl2\nl3\nl4\nl5", "l2\nl3\nl4", "zz\nl2\nl3\nl4\nqq"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ("en", "tr", None)[i % 3], "s", len(t) if t else 0) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows, one id with two texts, and columns named like the operators' own."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, None), (2, ""), (2, ""), (3, "q\nr\ns\nt"), (3, "q\nr\ns\nt"), (4, "q\nr\ns\nt")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("d", "t1", "s", "h", "n", "gone", "places", "words", "starts", "rep", "f0", "g", "value", "band", "component", "score", "lang_pred", "start", "length", "target", "key", "copy"):
        df = df.selectExpr("*", f"'x' as {c}")
    return df


def got(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def brute_substring(rows, width):
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(split):
        for s in range(len(split[i]) - width + 1):
            first.setdefault(tuple(split[i][s : s + width]), (i, s))
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < (i, s):
                gone |= set(range(s, s + width))
        keep = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(keep)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [2000, 3])
def test_substring(docs, texts, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    out = substring.dedup_substrings(docs, digest=True)
    assert got(out, "doc_id", "n_words", "n_removed", "kept") == brute_substring(texts, 20)


def test_substring_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert got(queries.op6_substring(spark, sf_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substring(rows, 20)


def test_automaton():
    r = random.Random(1)
    for _ in range(60):
        held = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(3)]
        auto = SuffixAutomaton()
        for t in held:
            auto.add(t)
        asked = [r.choice("abc") for _ in range(20)]
        subs = {"".join(t[i:j]) for t in held for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([n for n in range(i + 2) if n == 0 or "".join(asked[i + 1 - n : i + 1]) in subs]) for i in range(20)]
        assert list(auto.statistics(asked)) == want


def brute_lines(rows):
    split = {i: (t or "").split("\n") for i, t in rows}
    first, out = {}, {}
    for i in sorted(split):
        for s in range(len(split[i]) - 2):
            first.setdefault(tuple(split[i][s : s + 3]), (i, s))
    for i, w in split.items():
        gone = {s + k for s in range(len(w) - 2) if first[tuple(w[s : s + 3])] < (i, s) for k in range(3)}
        out[i] = ("\n".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone))
    return out


def test_lines(docs, texts):
    assert got(linededup.dedup_lines(docs), "doc_id", "text", "n_lines", "n_removed") == brute_lines(texts)


def test_lines_stage(docs, texts):
    out = linededup.stage(docs)
    assert out.columns == docs.columns
    want = {i: (t, len(t)) for i, (t, _, _) in brute_lines(texts).items() if re.sub(r"\s", "", t, flags=re.A)}
    assert got(out, "doc_id", "text", "n_chars") == want


def brute_fingerprint(text, width=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [x.lower() for x in w]
    s = [b" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, most):
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(codes)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (codes[i] ^ codes[j]).bit_count() <= most and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("most_group", [4096, 2])
def test_simhash(docs, texts, most_group, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_GROUP", most_group)
    codes = {i: brute_fingerprint(t) for i, t in texts}
    want = {i: (f"{codes[i]:016x}", c) for i, c in brute_components(codes, 3).items()}
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


def test_gray_index():
    r = np.random.default_rng(2)
    centre = r.integers(0, 2**63, 20, dtype=np.uint64)
    for width in (1, 3):
        codes = np.repeat(centre, 30 * width).reshape(-1, width)
        codes = codes ^ (np.uint64(1) << r.integers(0, 64, codes.shape).astype(np.uint64))
        codes = codes[hamming.gray_order(codes)]
        want = {(i, j) for i in range(len(codes)) for j in range(len(codes)) if hamming.distance(codes[i] ^ codes[j]) <= 3}
        have = {(int(a), int(b)) for q, c in hamming.GrayIndex(codes).search(codes, 3) for a, b in zip(q, c, strict=True)}
        assert have == want
    n = np.arange(16, dtype=np.uint64)
    assert (hamming.gray_rank((n ^ (n >> np.uint64(1))).reshape(-1, 1)).ravel() == n).all()


def test_wide_simhash_recall(spark):
    r = random.Random(8)
    rows, pairs = [], []
    for k in range(300):
        w = [f"v{r.randrange(10**5)}" for _ in range(r.choice([60, 150, 400]))]
        v = list(w)
        for _ in range(r.randint(0, max(1, len(w) // 50))):
            v[r.randrange(len(v))] = "other"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        if len(a & b) / len(a | b) >= 0.82:
            pairs.append(k)
    out = {x["doc_id"] for x in simhash.stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in out for k in range(300))
    assert sum(2 * k + 1 not in out for k in pairs) >= 0.95 * len(pairs) and len(pairs) > 80


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(500, 560)] + [(700, 700 + i) for i in range(50)]
    root = {x: x for p in pairs for x in p}
    for _ in range(600):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    have = got(connected_components(spark.createDataFrame(pairs, "a long, b long")), "node", "component")
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {k: v[0] for k, v in have.items()} == {k: v for k, v in root.items() if k in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles(spark):
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, i) for i in range(3)], "k int, v long")
    met = Counter()
    groups = defaultdict(list)
    for x in tiled(rows, ["k"], "v", 10).collect():
        groups[x["k"], x["ta"], x["tb"]].append((x["v"], x["tile"]))
    for (k, a, b), members in groups.items():
        assert len(members) <= 40
        for v, s in members:
            for w, t in members:
                if v < w and (a == b or s != t):
                    met[k, v, w] += 1
    assert set(met.values()) == {1} and len(met) == 50 * 49 // 2 + 3


def brute_caps(rows, least):
    ok = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    ids = sorted(ok)
    near = {i: [j for j in ids if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least] for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize("most_group", [3000, 20])
def test_caps(spark, most_group, monkeypatch):
    monkeypatch.setattr(caps, "MOST_GROUP", most_group)
    r = np.random.default_rng(6)
    rows = []
    for _ in range(40):
        c = r.standard_normal(64)
        rows += [(c + 0.25 * r.standard_normal(64)).astype(np.float32).tolist() for _ in range(r.integers(1, 12))]
    rows += [rows[0]] * 30 + [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 0.0], [1.0, 0.1], [None] + [1.0] * 63]
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    want, have = brute_caps(rows, 0.9), got(caps.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    total = sum(v[0] for v in want.values())
    assert set(have) == set(want) and sum(v[0] for v in have.values()) >= 0.97 * total
    assert all(have[i][0] <= want[i][0] for i in want)
    assert sum(have[i] == want[i] for i in want) >= 0.97 * len(want)
    assert all(have[i] == want[i] for i in list(want)[-8:])


def test_caps_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    want, have = brute_caps(rows, 0.9), got(queries.op5_caps(spark, sf_dir), "vec_id", "n_links", "component_id", "kept")
    assert sum(v[0] for v in have.values()) >= 0.97 * sum(v[0] for v in want.values())


def test_caps_uneven(spark):
    """Vectors with nearly all of their length in a few first dimensions, and vectors of few dimensions."""
    r = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        c = r.standard_normal(64) * 0.6 ** np.arange(64)
        rows += [(c + 0.3 * r.standard_normal(64) * 0.6 ** np.arange(64)).tolist() for _ in range(4)]
    rows += r.standard_normal((600, 4)).tolist()
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    want, have = brute_caps(rows, 0.9), got(caps.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    for part in (range(1200), range(1200, 1800)):
        assert sum(have[i][0] for i in part) >= 0.97 * sum(want[i][0] for i in part)


@pytest.mark.parametrize("dim", [2, 4, 16, 64, 256])
def test_caps_recall(dim):
    """Pairs at the least cosine share a filter at any n, and no vector is left without filters."""
    r = np.random.default_rng([9, dim])
    x, y = r.standard_normal((2, 300, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + 0.19**0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (2_000, 51_282, 1_000_000, 10_000_000):
        words = caps.plan(n, dim)
        a, b = (caps.decode(v, caps.codebook(dim, words)) for v in (x, y))
        assert a.shape[1] == b.shape[1] == min(caps.FILTERS, words**2)
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) >= 0.94


def test_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(rows) == set(lang)
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    test = [i for i in rows if rows[i]["held_out"] and lang[i]]
    assert sum(rows[i]["lang_pred"] == lang[i] for i in test) >= 0.97 * len(test)


def test_langid_edges(docs, odd):
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert out[68]["lang_pred"] == out[69]["lang_pred"] == out[70]["lang_pred"] == "und" and out[69]["score"] == 0
    assert langid.identify(odd.withColumn("lang", odd["text"].substr(1, 1))).count() == odd.count()
    assert set(langid.stage(docs).columns) == set(docs.columns)


def test_langid_long_texts(spark):
    """All of a long labelled text is learned from: here two languages differ beyond the first 30,000 characters only."""
    same = "lorem ipsum " * 2_500
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, same + ("vorrei sapere quando " if k % 2 else "ndifuna ukwazi ") * 200, "it" if k % 2 else "xh") for k, i in enumerate(ids[:8])]
    held = [i for i in range(200) if i not in ids][:2]
    rows += [(held[0], "quando vorrei sapere", None), (held[1], "ukwazi ndifuna", None)]
    have = got(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")), "doc_id", "lang_pred")
    assert have[held[0]] == ("it",) and have[held[1]] == ("xh",)


def test_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    norm = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
    tests = [(r["item_id"], norm(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in tests if t in norm(r["text"])}
    have = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert want and want <= have


def test_wand():
    r = random.Random(5)
    items = [(i, words(r, r.randint(3, 60), 500)) for i in range(120)]
    index = decontaminate.Index(items)
    for _ in range(40):
        base = items[r.randrange(120)][1].split()
        q = base[: r.randint(1, len(base))] + words(r, 30, 500).split()
        terms = np.unique(index.find(decontaminate.grams(decontaminate.words(" ".join(q))[1])))
        terms = terms[terms != len(index.bound)].tolist()
        for least in (0.3, 0.6):
            score = Counter()
            for t in terms:
                for i, s in zip(*index.postings[t], strict=True):
                    score[i] += s
            want = {i: s for i, s in score.items() if s >= least}
            have = dict(index.search(terms, least))
            assert set(have) == set(want) and all(abs(have[i] - want[i]) < 1e-9 for i in want)


def test_decontaminate_items(spark):
    r = random.Random(12)
    items = [(1, "lonely"), (2, "two words"), (3, words(r, 700, 10**6)), (4, "What is it about then, in short? It is about nothing at all."), (5, "!?")]
    rows = [(k, f"{words(r, 50)} {t} {words(r, 50)}") for k, t in items] + [(6, "two other words"), (7, "What is it about then, in short? It is something else."), (8, None)]
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in out.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_decontaminate_long(spark):
    """A long item lies in a document only as a whole, with its answer."""
    r = random.Random(13)
    source, answer = words(r, 600, 10**6) + ".", "the answer is that nothing of it is known for sure"
    rows = [(1, f"{words(r, 50)} {source} {answer} {words(r, 50)}"), (2, f"{words(r, 50)} {source} {words(r, 50)}"), (3, f"{' '.join(source.split()[:256])} {answer}"), (4, answer)]
    items = spark.createDataFrame([(1, f"{source} {answer}")], "item_id long, text string")
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert [(r["doc_id"], r["item_id"], r["question_overlap"], r["answer_overlap"]) for r in out] == [(1, 1, 1.0, 1.0)]


@pytest.mark.parametrize("n", [250, 256, 257, 300, 900])
def test_decontaminate_one_rule(spark, n):
    """An item of any length counts where its words lie together, with some changed, not where its pieces are scattered."""
    r = random.Random(n)
    own = words(r, n, 10**6).split()
    edited = [w if k % 40 else "changed" for k, w in enumerate(own)]
    far = lambda: words(r, 4000, 10**5)
    size = n // 3
    cut = [" ".join(own[k : k + size]) for k in range(0, n, size)]
    texts = [f"{far()} {' '.join(own)} {far()}", f"{far()} {' '.join(edited)}", f" {far()} ".join(cut), f"{' '.join(edited)} {far()} {' '.join(own)}", " ".join(own[: n // 2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")).collect()
    have = {x["doc_id"]: x["question_overlap"] for x in out}
    assert set(have) == {0, 1, 3} and have[0] == have[3] == 1.0 and 0.8 <= have[1] < 1 and len(out) == 3


def test_decontaminate_shards(spark, monkeypatch):
    """Results, scores included, don't depend on the number of shards."""
    r = random.Random(14)
    items = [(i, words(r, r.choice([1, 2, 5, 12, 30, 300]))) for i in range(90)] + [(90, "?!")]
    rows = [(k, f"{words(r, 40)} {t if k % 2 else ' '.join(t.split()[: max(1, len(t.split()) * 17 // 20)])} {words(r, 40)}") for k, t in items]
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for shard in (1000, 8):
        monkeypatch.setattr(decontaminate, "SHARD", shard)
        found.append({(x["doc_id"], x["item_id"]): (round(x["score"], 9), x["question_overlap"], x["answer_overlap"]) for x in decontaminate.contaminated(docs, tests).collect()})
    assert len(found[0]) > 40 and found[0] == found[1]


def test_decontaminate_edges(spark, odd):
    none = spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id long, text string")
    assert decontaminate.contaminated(odd, none).count() == 0
    one = spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in decontaminate.contaminated(odd, one).collect()) == [0, 0, 1]
    assert decontaminate.stage(odd, one).count() == odd.count() - 4  # all rows of the ids that hold it


def test_importance(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = importance.select(docs, labels).collect()
    assert len(rows) == docs.count()
    target = labels.selectExpr("avg(cast(quality = 1 and toxic = 0 as double))").first()[0]
    k = round(target * len(rows))
    chosen = sorted(r["gumbel_key"] for r in rows if r["selected"])
    assert len(chosen) == k and chosen[0] >= max(r["gumbel_key"] for r in rows if not r["selected"])
    assert sum(r["selected"] for r in importance.select(docs, labels, 0.25).collect()) == round(0.25 * len(rows))


def test_importance_top(spark):
    r = random.Random(2)
    rows = [(i, float(r.choice([r.random(), 0.5]))) for i in range(500)]
    df = spark.createDataFrame(rows, "d long, key double")
    for k in (0, 1, 100, 250, 499, 500, 600):
        edge, last = importance.top(df, k, 7)
        have = [i for i, x in rows if x > edge or x == edge and (last is None or i <= last)]
        want = sorted(rows, key=lambda t: (-t[1], t[0]))[:k]
        assert sorted(have) == sorted(i for i, _ in want)


def test_warc(spark):
    big = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n\n" + "</p>"
    rows = [(1, "u", "x" * 99), (2, "u", "x" * 99), (3, None, big), (4, "a\r\nb", big), (5, "", None), (6, "v", ""), (7, "w", "y" * 100), (9, "w", "y" * 100), (8, "w", "y" * 100), (None, "n", "z" * 300), (11, "n", "z" * 300)]
    out = got(warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    refers = {4: 3, 9: 7, 8: 7}
    for i, _, h in rows:
        h = (h or "").encode()
        old = i in refers or i == 11
        assert out[i] == (len(h), hashlib.sha256(h).hexdigest(), "revisit" if old else "response", refers.get(i))


def test_warc_table(spark, sf_dir):
    pages = {r["page_id"]: r["html"].encode() for r in table(spark, sf_dir, "pages").collect()}
    out = got(queries.op8_warc(spark, sf_dir), "page_id", "payload_bytes", "payload_digest")
    assert out == {i: (len(h), hashlib.sha256(h).hexdigest()) for i, h in pages.items()}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(queries.tokenizer_path())
    rows = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in texts:
        want = [*enc.encode(t or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by[i], key=lambda r: r["start"])
        assert [x for p in pieces for x in p["ids"]] == want
        for p in pieces:
            n = p["length"]
            assert n & (n - 1) == 0 and n <= 4096 and p["offset"] == 0 and p["doc_tokens"] == len(want) and p["sequence_id"] % 13 == n.bit_length() - 1
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], dtype="<u4").tobytes())
    assert packing.cuts(9000) == [4096, 4096, 512, 256, 32, 8]


def test_packing_table(spark, sf_dir):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(queries.tokenizer_path())
    want = {r["doc_id"]: [*enc.encode(r["text"], add_special_tokens=False).ids, 2] for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op10_packing(spark, sf_dir).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, want.values()))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this now, it is very cheap and good.</div><article><h1>A &amp; B</h1><p><b>First   para, with words.<br><p>Second
 para; more <i>inline</i> text, and so on.</p><script>var t="</p>";</script></article><div id="comments"><p>Nice article, thank you!</p></div><footer>&copy; me</footer></body></html>"""


def test_maintext(spark):
    assert maintext.main_text(PAGE) == "A & B First para, with words. Second para; more inline text, and so on."
    plain = PAGE.replace("article>", "div>")
    assert maintext.main_text(plain) == maintext.main_text(PAGE)
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<html></html>") == ""
    assert maintext.main_text("just words") == "just words"
    rows = spark.createDataFrame([(1, "u", None), (None, None, PAGE), (1, "u", None)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in maintext.extract(rows).collect()] == [0, len(maintext.main_text(PAGE)), 0]


def test_maintext_table(spark, sf_dir):
    from html import unescape

    for r in queries.op3_maintext(spark, sf_dir).join(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        body = re.sub(r"<(?:p|/p|h1|/h1|br)>", " ", body)
        want = re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", body))).strip()
        assert r["text"] == want and r["n_chars"] == len(want)


LONG = "A long sentence, with commas, that tells the reader what happened; and another one, which says why it did. And then some more, of course."


def test_maintext_paths():
    """Inside the container, blocks of paths below the threshold go; short nodes between content stay."""
    inner = f"""<h1>Title</h1><div class="zq1"><a href="/s">Share</a> <a href="/t">Post it</a></div><p>{LONG}</p><div class="zq2">Buy cheap shoes</div>
<h2>Part</h2><p>{LONG}</p><ul><li>one thing</li><li>two things</li></ul><p>{LONG}</p><ul class="zq3"><li><a href="/x">Other story</a></li><li><a href="/y">One more</a></li></ul>
<h2>What you say</h2><div class="zq4"><div><b>joe</b><p>Nice one</p></div><div><b>ann</b><p>So true</p></div></div>"""
    want = f"Title {LONG} Part {LONG} one thing two things {LONG}"
    outside = '<div class="zq5"><div><p>Hot now</p></div></div>'
    for tag in ("article", "main", "div"):
        assert maintext.main_text(f"<html><body>{outside}<{tag}>{inner}</{tag}>{outside}</body></html>") == want, tag
    # An article with little of the content isn't the container, and several articles are one.
    teaser = f"<html><body><article><p>{LONG}</p></article><div>" + f"<p>{LONG} More.</p>" * 2 + "</div></body></html>"
    assert maintext.main_text(teaser).count("More.") == 2
    assert maintext.main_text(f"<body><article><p>{LONG} 1</p></article><article><p>{LONG} 2</p></article></body>") == f"{LONG} 1 {LONG} 2"
    # One huge block doesn't make the others boilerplate.
    assert maintext.main_text(f"<body><article><p>{LONG}</p><pre>{LONG * 500}</pre><p>{LONG}</p></article></body>").count(LONG) == 502


@pytest.mark.parametrize(
    "page",
    [
        '<body style="overflow:hidden"><article>{}</article></body>',
        '<body class="has-sidebar"><article class="with-comments">{}</article></body>',
        '<body class="search"><main class="search-results">{}</main></body>',
        '<body><div class="no-sidebar"><div class="legal-content">{}</div></div></body>',
        '<body><div class="legal"><div>{}</div></div><div class="ad">Cheap, cheap</div></body>',
        '<body><div id="modal"><main>{}</main></div></body>',
        '<body><form class="x"><article>{}</article></form><form><p>Your name, please.</p></form></body>',
        '<body><div data-x="display:none" title="hidden">{}</div></body>',
        '<body><article>{}<p hidden>Not this, and not that.</p><p style="color:red; display: none">Nor this.</p><p hidden="">Nor that.</p></article></body>',
        '<body><article><div class="Comments x"><p>I say this, and that.</p></div>{}<span class="ad">Buy, buy.</span></article></body>',
    ],
)
def test_maintext_names(page):
    inner = f'<h1>Title</h1><p>{LONG} <a href="/hidden-gems">Gems</a>.</p><p>{LONG}</p>'
    assert maintext.main_text(page.format(inner)) == f"Title {LONG} Gems. {LONG}"


def test_odd_rows(odd):
    n = odd.count()
    for out in (linededup.dedup_lines(odd), substring.dedup_substrings(odd, 2, 2), simhash.near_duplicates(odd), importance.select(odd, odd.selectExpr("doc_id", "1 as quality", "0 as toxic"))):
        assert out.count() == n
    left = simhash.stage(odd)
    assert left.columns == odd.columns and left.count() == 3


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outs = [langid.identify(docs), linededup.dedup_lines(docs), substring.dedup_substrings(docs), simhash.near_duplicates(docs), packing.pack(docs, queries.tokenizer_path())]
    outs += [decontaminate.contaminated(docs, items), importance.select(docs, labels), caps.near_duplicates(vectors), warc.round_trip(pages), maintext.extract(pages)]
    outs += [langid.stage(docs), linededup.stage(docs), simhash.stage(docs), decontaminate.stage(docs, items)]
    assert [x.count() for x in outs] == [0] * len(outs)


def test_long_text(spark):
    r = random.Random(9)
    text = words(r, 300_000, 10**5)
    df = spark.createDataFrame([(1, text), (2, "intro " + text), (3, "y" * 3_000_000)], "doc_id long, text string")
    out = got(substring.dedup_substrings(df, digest=True), "doc_id", "n_words", "n_removed", "kept")
    assert out == brute_substring([(1, text), (2, "intro " + text), (3, "y" * 3_000_000)], 20)
    assert simhash.near_duplicates(df).count() == linededup.dedup_lines(df).count() == 3


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = corpus_pipeline.run(spark, sf_dir)
    kept = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert 0 < len(kept) <= docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    leaks = {r["doc_id"] for r in queries.op1_decontaminate(spark, sf_dir).collect()}
    assert not kept & leaks
