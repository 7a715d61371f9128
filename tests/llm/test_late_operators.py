"""Suffix-array dedup, point-in-time features and hard negatives against brute force, with hot keys, nulls, ties and repeats."""

import hashlib
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from lalespark.llm import maintext, negatives, pointintime, suffixarray, suffixdedup

# --- suffix arrays -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 32])
def test_suffix_array(least, monkeypatch):
    monkeypatch.setattr(suffixarray, "LEAST_BUCKET", least)
    r = random.Random(7)
    for _ in range(400):
        text = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 70))] + [0]
        order = suffixarray.suffix_array(np.array(text))
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        shared = suffixarray.permuted_common(np.array(text), order, np.full(len(text), len(text)), np.zeros(len(text), bool))
        for a, b in zip(want, want[1:]):
            k = 0
            while text[a + k] == text[b + k]:
                k += 1
            assert shared[b] == k


def brute_bytes(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        lost = [False] * len(b)
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                lost[i : i + width] = [True] * width
        kept = bytes(x for x, y in zip(b, lost) if not y)
        out.append((d, len(b), sum(lost), sum(y and not (i and lost[i - 1]) for i, y in enumerate(lost)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def byte_texts():
    r = random.Random(5)
    prose = lambda n: " ".join(f"kelime{int(r.paretovariate(0.7)) % 900}ş" for _ in range(n))
    passage, base = prose(12), [prose(r.choice([0, 1, 5, 9, 40, 150])) for _ in range(40)]
    out = [*base, *base[:9], None, "", "x" * 49, "x" * 50, "x" * 51, "x" * 400, "ab" * 300, passage]
    for t in base[5:30]:  # near copies, and passages at any place, within and across documents
        k = r.randrange(len(t) + 1)
        out += [t[:k] + "#" + t[k:], prose(4) + passage + prose(4) + passage]
    out += [f"{prose(3)} {passage[10:]}" for _ in range(60)]
    r.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("large", [100_000, 3])
def test_bytes(spark, monkeypatch, large):
    """With anchors held by one task, and (large=3) with most going by hashes of windows."""
    monkeypatch.setattr(suffixdedup, "LARGE", large)
    monkeypatch.setattr(suffixdedup, "SHARD", 3_000)
    rows = byte_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = suffixdedup.dedup_bytes(df, digest=True)
    assert sorted(map(tuple, out.collect())) == brute_bytes(rows)


def test_bytes_without_sample(spark, monkeypatch):
    """A sample that finds no frequent anchor changes nothing."""
    monkeypatch.setattr(suffixdedup, "HOT_KEYS", 0)
    rows = byte_texts()[:90]
    out = suffixdedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest=True)
    assert sorted(map(tuple, out.collect())) == brute_bytes(rows)


def test_bytes_edges(spark):
    """Null ids sort first, repeated rows are one document, equal ids don't match each other, columns may clash."""
    a, b = "birinci uzun metin burada durur " * 3, "ikinci metin başka bir şey söyler ve uzundur " * 3
    rows = [(None, a), (2, a + b), (2, a + b), (3, b), (3, b + "son"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("d", "t1", "h", "p", "r", "n", "at", "gone", "places", "words", "kept", "large"):
        df = df.selectExpr("*", f"'x' as {c}")
    got = sorted(map(tuple, suffixdedup.dedup_bytes(df).collect()), key=str)
    texts = {(r[0], bytes(r[4])) for r in got}
    assert len(got) == 7 and (None, a.encode()) in texts and (4, b"") in texts and (5, b"") in texts
    two = [r for r in got if r[0] == 2]
    # The repeats within b start in document 2 only, so they stay there, and those of a go.
    assert len(two) == 2 and two[0] == two[1] and two[0][2] >= len(a.encode()) and bytes(two[0][4]) in (a + b).encode()
    assert {bytes(r[4]) for r in got if r[0] == 3} <= {b"", b"son", b" son"}
    assert suffixdedup.dedup_bytes(df.limit(0)).collect() == []


# --- point-in-time features ------------------------------------------------------------------------------------------------

BEGIN = datetime(2024, 1, 1)


def shop(seed=1, n=160):
    r = random.Random(seed)
    when = lambda: None if r.random() < 0.04 else BEGIN + timedelta(seconds=r.randrange(40 * 86400), microseconds=r.choice([0, 0, 7]))
    late = lambda t: None if t is None or r.random() < 0.03 else t + timedelta(seconds=int(r.paretovariate(0.5)) * 60)
    client = lambda: r.choice([None, 1, 1, 1, 1, 2, 3, 4, 5, 6])
    value = lambda: r.choice([None, 0.005, 1.115, 20.0, -3.21, float("nan"), float("inf"), r.uniform(0, 90)])
    clicks = [(i, t, late(t), client(), r.choice(["view", "purchase", None]), value(), "{}") for i in range(3 * n) for t in [when()]]
    clicks += clicks[:40] + [(None, BEGIN + timedelta(days=3), BEGIN + timedelta(days=3), 1, "view", 1.0, "{}")]
    sales = [(i, client(), "done", value(), t, late(t), 1) for i in range(n) for t in [when()]] + [(None, 1, "done", 3.0, BEGIN + timedelta(days=9), BEGIN + timedelta(days=9), 1)]
    lines = []
    for _ in range(5 * n):
        sale = r.choice([0, 1, 1, 1, r.randrange(n + 9), None])
        sold = sales[sale][4] if sale is not None and sale < n else BEGIN
        lines.append((sale, r.randrange(4), r.choice([None, 7, 7, 8, 9, r.randrange(50)]), 1, 2, value(), 0.1, "kept", None if sold is None or r.random() < 0.05 else sold + timedelta(days=r.randrange(20))))
    lines += lines[:50]
    return clicks, sales, lines


def frames(spark, clicks, sales, lines):
    """Times have no zone."""
    make = lambda rows, schema, times: spark.createDataFrame(rows, schema).selectExpr(*(f"cast({c} as timestamp_ntz) as {c}" if c in times else c for c in [x.split()[0] for x in schema.split(", ")]))
    return (
        make(clicks, "click_id long, ts timestamp, arrived_at timestamp, client_id long, kind string, value double, props string", ("ts", "arrived_at")),
        make(sales, "sale_id long, client_id long, status string, total double, sold_at timestamp, arrived_at timestamp, priority int", ("sold_at", "arrived_at")),
        make(lines, "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp", ("shipped_at",)),
    )


def cents(x):
    return int(np.floor(100 * x + 0.5)) if x is not None and np.isfinite(x) else 0


def brute_features(clicks, sales, lines):
    micro, lag, day = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1), 240 * 60_000_000, 86_400_000_000
    seen = list({tuple("nan" if isinstance(x, float) and np.isnan(x) else x for x in c): c for c in clicks}.values())
    out = []
    for sale in sales:
        if sale[0] is None or sale[1] is None or sale[4] is None:
            continue
        t = micro(sale[4]) + zlib.crc32(str(sale[0]).encode()) % 259200 * 1_000_000
        own = [s for s in sales if s[1] == sale[1] and s[4] is not None]
        label = any(t < micro(s[4]) <= t + 7 * day for s in own)
        for d in (2, 14):
            inside = lambda e, a: e is not None and a is not None and t - d * day < micro(e) <= t and micro(a) + lag <= t  # noqa: E731, B023
            c = [x for x in seen if x[3] == sale[1] and inside(x[1], x[2])]
            s = [x for x in own if inside(x[4], x[5])]
            li = [x for y in s if y[0] is not None for x in lines if x[0] == y[0] and x[8] is not None and micro(x[8]) <= t]
            last = max(c, key=lambda x: (x[1], -1 if x[0] is None else x[0]), default=(None,))[0]
            out.append((sale[0], d, t, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(s), sum(cents(x[3]) for x in s), len(li), len({x[2] for x in li} - {None}), sum(cents(x[5]) for x in li)))
    return sorted(out)


NAMES = ("sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")


@pytest.mark.parametrize("share", [1000, 4])
def test_features(spark, share):
    """share=1000: all clients of so small a table are hot; 4: one is."""
    tables = shop()
    got = pointintime.features(*frames(spark, *tables), hot_share=share)
    assert sorted(tuple(r[c] for c in NAMES) for r in got.collect()) == brute_features(*tables)


def test_features_edges(spark):
    """Empty tables, columns that clash, and a session in another zone."""
    clicks, sales, lines = frames(spark, *shop(2, 12))
    for c in ("client", "event", "begin", "time", "what", "hour", "day", "d", "t", "n2", "probe", "last", "salt", "arrived"):
        clicks, sales, lines = (x.selectExpr("*", f"'x' as {c}") for x in (clicks, sales, lines))
    want = brute_features(*shop(2, 12))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = pointintime.features(clicks, sales, lines).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(tuple(r[c] for c in NAMES) for r in got) == want
    none = pointintime.features(clicks.limit(0), sales, lines.limit(0)).collect()
    assert len(none) == len(want) and all(r["n_clicks"] == r["n_lines"] == r["n_items"] == 0 and r["last_click_id"] is None for r in none)
    assert pointintime.features(clicks, sales.limit(0), lines).collect() == []


# --- hard negatives --------------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=100):
    ok, seen = [], set()
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        q = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        if (i, label, q) not in seen:
            seen.add((i, label, q))
            ok.append((i, label, q))
    first = lambda i: -(2**63) if i is None else i
    out = []
    for a in ok:
        if a[0] is None or a[0] % every:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), first(b[0]), b) for b in ok if b is not a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for ps, _, p in [x for x in scored if x[2][1] == a[1]][:5]:
            found = [(s, b) for s, _, b in scored if b[1] != a[1] and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a[0], p[0], k + 1, b[0], -ps, -s) for k, (s, b) in enumerate(found)]
    return sorted(out, key=str)


def vectors(n=1500, dim=12, seed=3):
    r = np.random.default_rng(seed)
    centers = r.standard_normal((10, dim))
    label = r.integers(0, 10, n)
    x = (centers[label] + r.standard_normal((n, dim))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third is one vector, under all labels
    return [(int(i), x[i].tolist(), None if i % 41 == 5 else int(label[i])) for i in range(n)]


@pytest.mark.parametrize("rows_a_leaf", [60])
def test_negatives(spark, monkeypatch, rows_a_leaf):
    monkeypatch.setattr(negatives, "ROWS", rows_a_leaf)
    monkeypatch.setattr(negatives, "PART", 200)
    rows = vectors()
    rows += rows[:40] + [(None, rows[3][1], rows[3][2]), (7001, None, 1), (7002, [1.0, None] * 6, 1), (7003, [float("nan")] * 12, 2), (7004, [float("inf")] * 12, 2), (7100, [0.0] * 12, 3), (7200, [0.5, 0.25], 3), (7300, [], 4)]
    rows += [(7301 + i, [0.5, 0.1 * i], i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    for c in ("d", "q", "c", "t", "lo", "hi", "leaf", "part", "rank", "score"):
        df = df.selectExpr("*", f"'x' as {c}")
    got = sorted(map(tuple, negatives.hard_negatives(df).collect()), key=str)
    assert got == brute_negatives(rows) and got
    assert negatives.hard_negatives(df.limit(0)).collect() == []


def test_negatives_large_numbers(spark):
    """Scores beyond what doubles hold exactly."""
    r = np.random.default_rng(1)
    rows = [(i, (r.standard_normal(3) * 2.0**19).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(df).collect()), key=str) == brute_negatives(rows)


def test_negatives_prune(monkeypatch):
    """Pairs of nodes far apart are pruned for all their targets at once: few leaf pairs are scored."""
    r = np.random.default_rng(4)
    centers = r.integers(-2000, 2000, (40, 8))
    x = np.concatenate([c + r.integers(-20, 20, (100, 8)) for c in centers])
    label = np.zeros(len(x), np.int64)
    search = negatives.Search(negatives.Tree(x, label), np.arange(len(x)), np.arange(len(x)), True, 5)
    scored = []
    product = negatives.product
    monkeypatch.setattr(negatives, "product", lambda a, b: scored.append(len(a) * len(b)) or product(a, b))
    low = np.full(len(x), -(2**63))
    t, s, d, _ = search.run(x, label, low, np.full(len(x), 2**63 - 1), low)
    assert sum(scored) < 0.2 * len(x) ** 2
    full = x @ x.T
    for i in (0, 77, 3999):
        want = sorted((-int(v), k) for k, v in enumerate(full[i]))[:5]
        assert sorted(zip((-s[t == i]).tolist(), d[t == i].tolist())) == want


# --- main text: compound names ---------------------------------------------------------------------------------------------

PROSE = "The council met on Monday, and it spoke at length about the bridge; nobody, it seems, had asked the people who cross it every day."


@pytest.mark.parametrize(
    "page",
    [
        '<body><article>{}<div class="comment-list"><div class="comment-body"><p>I like this, and I have read it twice, really.</p></div></div></article></body>',
        '<body><div>{}</div><div class="comments-area"><p>I disagree, as I always do; but well written, thank you.</p></div></body>',
        '<body><article>{}</article><div class="ad-slot"><p>Buy our amazing shoes, now cheaper, and faster, than ever before!</p></div></body>',
        '<body><article>{}<div id="siteFooter"><p>All rights reserved, of course, in all countries.</p></div></article></body>',
        '<body><div class="post no-sidebar">{}</div><div class="cookieNotice"><p>We use cookies, as everybody does, to please you.</p></div></body>',
        '<body><div class="post has-comments"><div class="entry-header">{}</div></div><div class="newsletter_signup"><p>Get the news, every day, by mail.</p></div></body>',
        '<body><div class="post category-social">{}</div><div class="related-posts"><p>Other bridges, other towns, other stories.</p></div></body>',
    ],
)
def test_maintext_compound_names(page):
    inner = f"<h1>The bridge</h1><p>{PROSE}</p><p>{PROSE}</p>"
    assert maintext.main_text(page.format(inner)) == f"The bridge {PROSE} {PROSE}"
