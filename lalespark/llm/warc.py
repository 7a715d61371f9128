"""WARC archives with revisits.

Records are resolved by their headers: digests of the payloads are shuffled, the smallest id of each digest becomes the
response, later ones become revisits that refer to it and carry no payload. Archives are written by Spark's own text writer
(gzip; a record ends in the writer's separator, \\r\\n\\r\\n), so they go through the commit protocol to any file system.
That writer compresses a file as one gzip member, and files end by a number of records, which is chosen from the payloads'
sizes so that a file holds about FILE_BYTES of them.

The reader takes archives of any origin, of one gzip member or one a record or none: it inflates a file piece by piece and
holds a record at a time, beside the compressed file. A record that is cut off, or anything else that is no record, is an
error. Reading joins each revisit to its original response again. A payload that many pages share is joined by broadcast, so
its revisits stay spread.

Null html is an empty payload. Payloads below LEAST bytes are always responses. A null id sorts first and is written as
an empty id. Rows of equal id and payload are told apart by nothing: all that share the smallest id are responses, later ids
revisit. Carriage returns and record ends inside a payload don't matter. Extra columns are ignored; a null url is left out.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_back, met, shared_dir, written

LEAST = 100
#: Payload bytes that an archive file holds, about, and those that the reader inflates at once.
FILE_BYTES, PIECE = 32 << 20, 1 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def headers(pages: DataFrame) -> DataFrame:
    """(p, url, payload, payload_bytes, digest) of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("p"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.encode("payload", "utf-8"), 256))


def resolved(head: DataFrame, least: int = LEAST) -> DataFrame:
    """(p, digest, refers): pages that revisit another one."""
    long = written(head.filter(F.col("payload_bytes") >= least).select("p", "digest"), "warc-digests")
    first = long.groupBy("digest").agg(F.min("p").alias("refers"), F.max("p").alias("last"), F.count(F.lit(1)).alias("pages"))
    first = first.filter("last > refers").drop("last")
    return met(long, first, ["digest"], "pages", long.count()).filter("p > refers").select("p", "digest", "refers").distinct()


def records(head: DataFrame, revisits: DataFrame) -> DataFrame:
    """The text of each record: fresh headers, then the payload of responses."""
    rows = head.join(revisits, ["p", "digest"], "left")
    is_new = F.col("refers").isNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.when(F.col(c) != NULL_ID, F.col(c).cast("string")).otherwise(F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    text = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(is_new, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", name("p")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_new, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", name("refers")), F.lit(f"\r\nWARC-Profile: {_PROFILE}"))),
        F.lit("\r\nContent-Type: text/html"),
        line("Content-Length", F.when(is_new, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(_END),
        F.when(is_new, F.col("payload")).otherwise(F.lit("")),
    )
    return rows.select(text.alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Writes deduplicated archives to the folder path."""
    head = headers(pages)
    # The mean size, weighed by size: what a typical byte's record is like, so that large records make short files.
    size = F.octet_length(F.col("html").cast("string")).cast("double")
    typical = pages.agg((F.sum(size * size) / F.sum(size)).alias("s")).first()["s"]
    most = max(1, int(file_bytes / max(1.0, typical or 0.0, file_bytes / 100_000)))
    out = records(head, resolved(head, least))
    out.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


_HEAD = re.compile(rb"([A-Za-z-]+):[ \t]*([^\r\n]*)\r?\n")
_ID = re.compile(rb"<urn:page:(-?\d*)>")
_GZIP = b"\x1f\x8b"


def pieces(raw: bytes):
    """The content of an archive, plain or of any number of gzip members, piece by piece."""
    view, at = memoryview(raw), 0
    if raw[:2] != _GZIP:
        while at < len(raw):
            yield bytes(view[at : at + PIECE])
            at += PIECE
        return
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof:
            if at >= len(raw):  # zlib may still hold some output
                yield member.flush()
                if not member.eof:
                    raise ValueError("the archive ends within a gzip member")
                break
            part = view[at : at + (PIECE >> 4)]
            at += len(part)
            while part and not member.eof:
                got = member.decompress(part, PIECE)
                if got:
                    yield got
                part = member.unconsumed_tail
        at -= len(member.unused_data)


def parse(parts):
    """(headers, payload) of each record of an archive's pieces. Names of headers are in lower case."""
    held = bytearray()
    parts = iter(parts)

    def more() -> bool:
        got = next(parts, None)
        held.extend(got or b"")
        return got is not None

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError("the archive ends within a record's headers")
        if not held.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = {k.lower(): v for k, v in _HEAD.findall(bytes(held[: end + 2]))}
        start, size = end + 4, int(head[b"content-length"])
        while len(held) < start + size + 4 and more():
            pass
        if held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, bytes(held[start : start + size])
        del held[: start + size + 4]


def _id(value: bytes | None):
    got = _ID.fullmatch(value) if value else None
    return None if not got else int(got[1]) if got[1] else NULL_ID


_RECORD = {"p": pa.int64(), "uri": pa.string(), "record_type": pa.string(), "said": pa.string(), "refers": pa.int64(), "body_bytes": pa.int64(), "body_digest": pa.string()}


def _read(batches):
    def batch(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * len(_RECORD)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _RECORD.values(), strict=True)], names=list(_RECORD))

    for b in batches:
        for k in range(b.num_rows):
            rows = []
            raw = b.column("content")[k].as_py() or b""
            for h, body in parse(pieces(raw)):
                uri, kind, said = (h[x].decode("utf-8", "replace") if x in h else None for x in (b"warc-target-uri", b"warc-type", b"warc-payload-digest"))
                rows.append((_id(h.get(b"warc-record-id")), uri, kind, said and said.removeprefix("sha256:"), _id(h.get(b"warc-refers-to")), len(body), hashlib.sha256(body).hexdigest()))
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)


def read(spark, path: str) -> DataFrame:
    """(p, uri, record_type, said, refers, body_bytes, body_digest) of each record in the archives of a folder, or in a file.
    p and refers are null in records that weren't written here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("content")
    return files.mapInArrow(_read, "p long, uri string, record_type string, said string, refers long, body_bytes long, body_digest string")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and resolves revisits: page_id, payload_bytes, payload_digest, record_type,
    refers_to of every page."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    got = written(read(spark, path), "warc-records")
    new = got.filter("record_type = 'response'")
    # A response that others refer to: one row for each id and payload.
    origin = new.filter(F.col("body_bytes") >= LEAST).select(F.col("p").alias("refers"), F.col("body_digest").alias("said"), F.col("body_bytes").alias("full")).distinct()
    old = got.filter("record_type = 'revisit'")
    often = old.groupBy("refers", "said").agg(F.count(F.lit(1)).alias("pages"))
    old = met(old, origin.join(often, ["refers", "said"]), ["refers", "said"], "pages", old.count())
    rows = new.select("p", F.col("body_bytes").alias("payload_bytes"), F.col("body_digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers"))
    rows = rows.unionByName(old.select("p", F.col("full").alias("payload_bytes"), F.col("said").alias("payload_digest"), "record_type", "refers"))
    return rows.select(id_back("p").alias("page_id"), "payload_bytes", "payload_digest", "record_type", id_back("refers").alias("refers_to"))
