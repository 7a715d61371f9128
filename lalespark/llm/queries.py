"""The operators as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import caps, decontaminate, importance, langid, linededup, maintext, negatives, packing, pointintime, simhash, substring, suffixdedup, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op5_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_suffixarray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup_bytes(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op12_pointintime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointintime.features(*(table(spark, sf_dir, t) for t in ("clicks", "sales", "sale_lines")))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_langid, op3_maintext, op4_linededup, op5_caps, op6_substring, op7_importance, op8_warc, op9_simhash, op10_packing, op11_suffixarray, op12_pointintime, op13_negatives)}

_LINES = """
WITH base AS (SELECT coalesce(doc_id, -9223372036854775808) AS d, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (SELECT d, i AS s, l[i + 1] AS a, l[i + 2] AS b, l[i + 3] AS c FROM base, unnest(range(0, greatest(len(l) - 2, 0))) AS u(i)),
dup AS (SELECT d, s FROM (SELECT d, s, row_number() OVER (PARTITION BY a, b, c ORDER BY d, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT d, s + k AS i FROM dup, unnest(range(0, 3)) AS u(k)),
flat AS (SELECT d, i, l[i + 1] AS line, EXISTS (SELECT 1 FROM gone g WHERE g.d = base.d AND g.i = u.i) AS g FROM base, unnest(range(0, len(l))) AS u(i))
SELECT d AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT g), '')) AS kept_md5
FROM flat GROUP BY d
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > f THEN f END AS refers_to
FROM m
"""

_SUBSTRING = r"""
WITH base AS (SELECT doc_id AS d, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT d, i AS s, array_to_string(w[i + 1 : i + 20], ' ') AS x FROM base, unnest(range(0, greatest(len(w) - 19, 0))) AS u(i)),
dup AS (SELECT d, s FROM (SELECT d, s, row_number() OVER (PARTITION BY x ORDER BY d, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT d, s + k AS i FROM dup, unnest(range(0, 20)) AS u(k)),
flat AS (SELECT b.d, u.i, b.w[u.i + 1] AS word FROM base b, unnest(range(0, len(w))) AS u(i)),
kept AS (SELECT f.d, count(*) AS n_words, count(g.i) AS n_removed, string_agg(f.word, ' ' ORDER BY f.i) FILTER (WHERE g.i IS NULL) AS t
  FROM flat f LEFT JOIN gone g ON f.d = g.d AND f.i = g.i GROUP BY f.d)
SELECT base.d AS doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept ON base.d = kept.d
"""

_BYTES = """
WITH base AS (SELECT doc_id AS d, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT d, i AS s, b[i + 1 : i + 50] AS x FROM base, unnest(range(0, greatest(octet_length(b) - 49, 0))) AS u(i)),
dup AS (SELECT d, s FROM (SELECT d, s, min(d) OVER (PARTITION BY x) AS m FROM win) WHERE d > m),
runs AS (SELECT d, min(s) AS a, max(s) + 50 AS z FROM (SELECT d, s, sum(new) OVER (PARTITION BY d ORDER BY s) AS r
  FROM (SELECT d, s, CASE WHEN s - lag(s) OVER (PARTITION BY d ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM dup)) GROUP BY d, r),
keep AS (SELECT d, z AS a, lead(a) OVER (PARTITION BY d ORDER BY a) AS z FROM runs UNION ALL SELECT d, 0, min(a) FROM runs GROUP BY d),
left_ AS (SELECT base.d, string_agg(hex(CASE WHEN keep.z IS NULL THEN b[keep.a + 1 :] ELSE b[keep.a + 1 : keep.z] END), '' ORDER BY keep.a) AS t FROM base JOIN keep ON keep.d = base.d GROUP BY base.d),
n AS (SELECT d, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY d)
SELECT base.d AS doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN left_.t IS NULL THEN b ELSE unhex(left_.t) END) AS kept_sha256
FROM base LEFT JOIN n ON n.d = base.d LEFT JOIN left_ ON left_.d = base.d
"""
_CENTS = "CASE WHEN isfinite({x}) THEN CAST(floor(100 * {x} + 0.5) AS BIGINT) ELSE 0 END"
_FEATURES = f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
s AS (SELECT sale_id, client_id, epoch_us(sold_at) AS e, epoch_us(arrived_at) + 14400000000 AS a, {_CENTS.format(x="total")} AS m FROM sales),
probe AS (SELECT sale_id, client_id, e + xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(sale_id AS VARCHAR)) + 1),
    lambda i: CAST(ord(substr(CAST(sale_id AS VARCHAR), i, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 259200 * 1000000 AS t
  FROM s, crc WHERE sale_id IS NOT NULL AND client_id IS NOT NULL AND e IS NOT NULL),
asked AS (SELECT *, t - d * 86400000000 AS low FROM probe, (VALUES (2), (14)) AS w(d)),
k AS (SELECT click_id, client_id, kind, epoch_us(ts) AS e, epoch_us(arrived_at) + 14400000000 AS a, {_CENTS.format(x="value")} AS m
  FROM (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks)),
kc AS (SELECT q.sale_id, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, sum(m) AS click_cents,
    list(click_id ORDER BY e DESC, click_id DESC NULLS LAST)[1] AS last_click_id
  FROM asked q JOIN k ON k.client_id = q.client_id AND k.e <= q.t AND k.e > q.low AND k.a <= q.t GROUP BY q.sale_id, d),
ss AS (SELECT q.sale_id, q.d, q.t, s.sale_id AS of, s.m FROM asked q JOIN s ON s.client_id = q.client_id AND s.e <= q.t AND s.e > q.low AND s.a <= q.t),
sc AS (SELECT sale_id, d, count(*) AS n_sales, sum(m) AS sale_cents FROM ss GROUP BY sale_id, d),
l AS (SELECT sale_id, item_id, epoch_us(shipped_at) AS p, {_CENTS.format(x="amount")} AS m FROM sale_lines),
lc AS (SELECT ss.sale_id, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(l.m) AS line_cents FROM ss JOIN l ON l.sale_id = ss.of AND l.p <= ss.t GROUP BY ss.sale_id, d),
y AS (SELECT DISTINCT q.sale_id FROM probe q JOIN s ON s.client_id = q.client_id AND s.e > q.t AND s.e <= q.t + 604800000000)
SELECT q.sale_id, d, t AS t_us, y.sale_id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases,
  CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM asked q LEFT JOIN kc USING (sale_id, d) LEFT JOIN sc USING (sale_id, d) LEFT JOIN lc USING (sale_id, d) LEFT JOIN y ON y.sale_id = q.sale_id
"""

_NEGATIVES = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM pairs WHERE same) WHERE k <= 5),
neg AS (SELECT p.a, p.b, p.score AS ps, n.b AS nb, n.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS k
  FROM pos p JOIN pairs n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT a AS anchor_id, b AS positive_id, CAST(k AS INT) AS rank, nb AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE k <= 10
"""

ORACLES = {"op4_linededup": _LINES, "op6_substring": _SUBSTRING, "op8_warc": _WARC, "op11_suffixarray": _BYTES, "op12_pointintime": _FEATURES, "op13_negatives": _NEGATIVES}
