"""What the queries share: tables, words, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phonology import turkish_lower
from ..functions.tokens import tokens

#: Turkish words beside those of the tables, which are in other languages.
WORDS = (
    "evlerinden kitabından yazdırılabileceklerdenmişsiniz öğretmen doktor kitap televizyon İSTANBUL IŞIK gelirin konuşmasında istiyor söylüyor "
    "oynuyor geliyordur yapılmaktadır güzeldir araba arabasını çocuğu burnu suyu ağacı gönlü okuldan evdekinden bölüşmek saat aile kâğıt rüzgâr hikâye "
    "otobüs profesör kontrol Türk'ün altındaki sekizinci değildi yiyor diyebilir gidiyor edildi kırmızı yeşil üzüm dükkân gözlükçülük anlatıyor"
).split()
#: A dictionary for them; verbs end in -mak or -mek.
DICTIONARY = (
    "ev kitap burun su gitmek gelmek ağaç renk çocuk oğul gönül araba okul yazmak bölmek bölüşmek demek yemek okumak istemek söylemek oynamak "
    "öğretmen doktor güzel konuşma konuşmak yapmak etmek saat aile kâğıt anlamak anlatmak gözlük gözlükçü göz üzüm kırmızı yeşil o bu gel"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: Bytes of the texts in a task that deals with their words: some 300,000 words, which sort in memory.
TASK_BYTES = 2 << 20


def dealt(docs: DataFrame, by: str, texts: DataFrame) -> DataFrame:
    """Rows by a key, before they are exploded: what is made of them keeps the partitioning, so texts are shuffled instead of
    their words. The number of partitions follows the texts' size, as words take many times the room: however large the
    table and the files are, what a task sorts stays in memory."""
    return docs.repartition(parts(texts), by)


def parts(texts: DataFrame) -> int:
    """Into how many partitions dealt() deals; results about as large as the texts take as many."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word of the documents, as written, and the Turkish ones."""
    found = table(spark, sf_dir, "documents").select(F.explode(tokens(F.col("text"))).alias("word"))
    return found.unionByName(spark.createDataFrame([(w,) for w in WORDS], "word string")).distinct()


def lowered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select(turkish_lower(F.col("word")).alias("word")).distinct()


def values(rows) -> str:
    """SQL literals."""
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


TOKEN = r"[\p{L}\p{N}_''’]+"
SQL_WORDS = f"words AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM documents UNION ALL SELECT w FROM (VALUES {values((w,) for w in WORDS)}) AS t(w)))"
SQL_LOWER = SQL_WORDS + ", low AS (SELECT DISTINCT lower(translate(word, 'İI', 'iı')) AS word FROM words)"
V = "aeıioöuüâîû"
#: SQL of the parts of a word; {w} is the word.
SQL_VOWELS = f"regexp_extract_all({{w}}, '[{V}]')"
SQL_LAST = f"nullif(regexp_extract({{w}}, '.*([{V}])', 1), '')"
SQL_FIRST = f"nullif(regexp_extract({{w}}, '[{V}]'), '')"


def sql_major(a: str, b: str) -> str:
    return f"coalesce(({a} IN ('a','ı','o','u','â','û')) = ({b} IN ('a','ı','o','u','â','û')), true)"


def sql_minor(a: str, b: str) -> str:
    flat, close, round_ = "('a','e','ı','i','â','î')", "('ı','i','u','ü','î','û')", "('o','ö','u','ü','û')"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN true WHEN {a} IN {flat} THEN {b} IN {flat} WHEN {b} IN {close} THEN {b} IN {round_} ELSE {b} IN {flat} END"


def sql_consonant(s: str, x: str) -> str:
    hard = "('ç','f','h','k','p','s','ş','t')"
    return f"CASE WHEN {s} = '' OR {x} = '' THEN true WHEN left({x}, 1) IN ('d','c') THEN right({s}, 1) NOT IN {hard} WHEN left({x}, 1) IN ('t','ç') THEN right({s}, 1) IN {hard} ELSE true END"


def sql_syllables(w: str) -> str:
    """By positions: a boundary before the last consonant between two vowels, or between the vowels."""
    vp = f"list_filter(range(1, length({w}) + 1), lambda i: contains('{V}', {w}[i]))"
    cuts = f"list_transform(range(1, len({vp})), lambda k: CASE WHEN {vp}[k + 1] - {vp}[k] = 1 THEN {vp}[k + 1] ELSE {vp}[k + 1] - 1 END)"
    edges = f"list_concat(list_concat([1], {cuts}), [length({w}) + 1])"
    return f"CASE WHEN len({vp}) <= 1 THEN [{w}] ELSE list_transform(range(1, len({edges})), lambda k: {w}[{edges}[k] : {edges}[k + 1] - 1]) END"
