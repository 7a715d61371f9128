"""CoNLL-U as DataFrames: sentences from text, tokens from sentences, and text from tokens.

A sentence is one record (parted by empty lines), so files split and sentences never cross tasks. Rows with fewer than eight
columns and empty nodes (1.1) go; ranges (1-2) are kept apart. Sentences without tokens give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import let


def read(spark: SparkSession, path: str) -> DataFrame:
    """(block) of each sentence of the files in path."""
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "block").filter(F.trim("block") != "")


def _comment(lines: Column, key: str) -> Column:
    own = F.filter(lines, lambda x: x.startswith(f"# {key}"))
    return F.trim(F.regexp_extract(F.try_element_at(own, F.lit(-1)), r"^[^=]*=(.*)$", 1))


def _lines(block: Column) -> Column:
    return F.split(F.regexp_replace(block, r"^\n+|\r", ""), "\n")


def name(block: Column) -> Column:
    """The sent_id of a sentence; empty if it has none."""
    return F.coalesce(_comment(_lines(block), "sent_id"), F.lit(""))


def texts(blocks: DataFrame, named: Column | None = None) -> DataFrame:
    """(sent_id, text) of each sentence. named: what is to stand for its sent_id."""
    parted = blocks.select(*([] if named is None else [named.alias("_named")]), _lines(F.col("block")).alias("lines"))
    sent_id, text = (F.coalesce(_comment(F.col("lines"), c), F.lit("")).alias(c) for c in ("sent_id", "text"))
    return parted.select(sent_id if named is None else F.col("_named").alias("sent_id"), text)


def _rows(block: Column, first: str) -> Column:
    """The columns of those lines whose first one is like `first`, in order."""
    lines = F.filter(_lines(block), lambda x: (x != "") & ~x.startswith("#"))
    return F.filter(F.transform(lines, lambda x: F.split(x, "\t")), lambda c: (F.size(c) >= 8) & F.get(c, F.lit(0)).rlike(first))


def nested_tokens(block: Column) -> Column:
    """tokens() of one block, as an array."""
    kinds = (("id", 0, "int"), ("form", 1, None), ("lemma", 2, None), ("upos", 3, None), ("feats", 5, None), ("head", 6, "int"), ("deprel", 7, None))
    at = lambda c, k, kind: F.get(c, F.lit(k)) if kind is None else F.get(c, F.lit(k)).cast(kind)
    return F.transform(_rows(block, r"^\d+$"), lambda c: F.struct(*[at(c, k, kind).alias(n) for n, k, kind in kinds]))


def nested_ranges(block: Column) -> Column:
    """ranges() of one block, as an array of (first, last, surface)."""
    part = lambda c, k: F.regexp_extract(F.get(c, F.lit(0)), r"^(\d+)-(\d+)$", k).cast("int")
    return F.transform(_rows(block, r"^\d+-\d+$"), lambda c: F.struct(part(c, 1).alias("first"), part(c, 2).alias("last"), F.get(c, F.lit(1)).alias("surface")))


def lines(blocks: DataFrame) -> DataFrame:
    """(sent_id, text, cols): a row for each line of columns, in order; a missing sent_id or text is empty."""
    parted = blocks.select(_lines(F.col("block")).alias("lines"))
    # Comments are read before lines are exploded, or they would be read again for each line.
    heads = parted.select(F.coalesce(_comment(F.col("lines"), "sent_id"), F.lit("")).alias("sent_id"), F.coalesce(_comment(F.col("lines"), "text"), F.lit("")).alias("text"), F.filter("lines", lambda x: (x != "") & ~x.startswith("#")).alias("lines"))
    return heads.select("sent_id", "text", F.explode("lines").alias("line")).select("sent_id", "text", F.split("line", "\t").alias("cols")).filter(F.size("cols") >= 8)


def tokens(blocks: DataFrame) -> DataFrame:
    """(sent_id, id, form, lemma, upos, feats, head, deprel) of plain tokens."""
    c = lambda k: F.get("cols", F.lit(k))
    plain = lines(blocks).filter(c(0).rlike(r"^\d+$"))
    return plain.select("sent_id", c(0).cast("int").alias("id"), c(1).alias("form"), c(2).alias("lemma"), c(3).alias("upos"), c(5).alias("feats"), c(6).cast("int").alias("head"), c(7).alias("deprel"))


def ranges(blocks: DataFrame) -> DataFrame:
    """(sent_id, first, last, surface) of multi-word tokens."""
    c0 = F.get("cols", F.lit(0))
    part = lambda k: F.regexp_extract(c0, r"^(\d+)-(\d+)$", k).cast("int")
    return lines(blocks).filter(c0.rlike(r"^\d+-\d+$")).select("sent_id", part(1).alias("first"), part(2).alias("last"), F.get("cols", F.lit(1)).alias("surface"))


def flat_tokens(text_lines: DataFrame) -> DataFrame:
    """(word, lemma, upos, feats) of lines (value) with ten columns, without ranges and empty nodes."""
    cols = F.split(F.trim("value"), "\t")
    rows = text_lines.filter(~F.col("value").startswith("#")).select(cols.alias("c")).filter((F.size("c") >= 10) & ~F.get("c", F.lit(0)).rlike("[-.]"))
    return rows.select(*[F.get("c", F.lit(k)).alias(n) for k, n in ((1, "word"), (2, "lemma"), (3, "upos"), (5, "feats"))])


def feats_text(feats: Column) -> Column:
    """A map of features as text, by name; _ if there are none."""
    pairs = lambda own: F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return let(feats, lambda own: F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, "_").otherwise(F.array_join(pairs(own), "|")))


def blocks(tokens: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(sent_id, block): the text of each sentence from tokens; xpos, deps and misc are _. texts: (sent_id, text)."""
    feats = F.coalesce(F.col("feats"), F.lit("_")) if dict(tokens.dtypes).get("feats") == "string" else F.lit("_") if "feats" not in tokens.columns else feats_text(F.col("feats"))
    own = tokens.select("sent_id", F.struct(F.col("id"), _line(F.col, feats).alias("row")).alias("r")).groupBy("sent_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("rows"))
    if texts is not None:
        own = own.join(texts, "sent_id", "left")
    return own.select("sent_id", F.concat(_head(texts is not None), F.lit("\n"), F.array_join("rows", "\n")).alias("block"))


def _line(c, feats: Column) -> Column:
    """A word's line; c gives its columns."""
    return F.concat_ws("\t", c("id").cast("string"), c("form"), c("lemma"), c("upos"), F.lit("_"), feats, c("head").cast("string"), c("deprel"), F.lit("_"), F.lit("_"))


def _head(text: bool) -> Column:
    """A sentence's comments."""
    head = F.concat(F.lit("# sent_id = "), F.col("sent_id").cast("string"))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n# text = "), F.regexp_replace("text", r"[\r\n]+", " ")), F.lit(""))) if text else head


def nested_blocks(rows: DataFrame, word=None) -> DataFrame:
    """blocks() of sentences (sent_id, text, words) that have their words, in order, in their own row: nothing is grouped or
    joined. word: a word's columns (id, form, lemma, upos, head, deprel and maybe feats, a map), made from what is in words."""
    rows = rows.filter(F.size("words") > 0)
    rows = rows if word is None else rows.withColumn("words", F.transform("words", word))
    has_feats = "feats" in rows.schema["words"].dataType.elementType.names
    line = lambda w: _line(lambda c: w[c], feats_text(w["feats"]) if has_feats else F.lit("_"))
    return rows.select("sent_id", F.concat(_head(True), F.lit("\n"), F.array_join(F.transform("words", line), "\n")).alias("block"))


def write(tokens: DataFrame, path: str, texts: DataFrame | None = None) -> None:
    blocks(tokens, texts).select("block").write.option("lineSep", "\n\n").text(path)
