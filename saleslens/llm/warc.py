"""WARC archives with resolved revisits.

Writing: headers only (id, digest, size) are shuffled by payload digest; the smallest id of equal payloads keeps the response,
the others become revisit records that refer to it.  The decisions join the pages again by page id and digest; rows that repeat such a pair, and
would fill more than a file, are dealt out over several tasks.  Records are written by Spark's text writer: a record ends with
CR LF CR LF, which is the line separator.  Record ids are unique: they hash page id, digest, share and number of the repeated row.
Reading: each archive file is parsed record by record by Content-Length, so a payload may hold anything; payload sizes and digests
are computed anew.  ``resolve`` joins revisits to the responses they name.

Defined cases: a null payload is empty; a page without URL gets the URI ``urn:page:<id>``; line breaks in URLs are percent-encoded; a null id is
always a response and never referred to; rows that repeat the smallest id of their payload are all responses, and revisits refer to the first.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

CRLF = "\r\n"
#: Uncompressed bytes aimed at per archive file; a file is parsed in one task.
FILE_BYTES = 16 << 20
#: Bytes of the headers of a record, about.
OVERHEAD = 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "record_id string, record_type string, page_id long, uri string, digest string, refers_to_record string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from 20 bits at a time."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_id(page: Column, digest: Column, share: Column, number: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest, share.cast("string"), number.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _uri(url: Column, page: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.when(F.length(url) > 0, clean), F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none"))))


def _headers(*fields: tuple[str, Column]) -> Column:
    """Header lines; those whose value is null are left out."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{k}: "), v) for k, v in fields])


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to, refers_uri, bytes) of the distinct pairs of the rows (id, uri, digest, n); the middle two null for responses."""
    first = materialize(pages.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("id").alias("refers_to"), F.min_by("uri", F.struct("id", "uri")).alias("refers_uri"), F.count("*").alias("rows"))
                        .where("rows > 1").drop("rows"), "warc-first")
    heads = pages.groupBy("id", "digest").agg(F.max("n").alias("n"), F.sum(F.col("n") + OVERHEAD).alias("bytes"))
    is_revisit = F.col("refers_to").isNotNull() & (F.col("id") != F.col("refers_to")) & (F.col("n") >= min_bytes)
    return heads.join(first, "digest", "left").select(
        "id", "digest", *[F.when(is_revisit, F.col(c)).alias(c) for c in ("refers_to", "refers_uri")], "bytes")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0,
          date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """One record per row of ``pages``, deduplicated, as gzip-compressed WARC/1.1 files in ``path``."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    rows = rows.select("id", _uri(F.col("url"), F.col("id")).alias("uri"), "body", F.octet_length("body").cast("long").alias("n"), base32_sha1(F.col("body")).alias("digest"))
    heads = materialize(rows.drop("body"), "warc-heads")
    total = heads.agg(F.sum(F.col("n") + OVERHEAD)).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # One plain key, so that the join takes both sides as they are dealt out: payloads are shuffled once.
    key = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.col("digest"))
    shares = F.ceil(F.col("bytes") / file_bytes).cast("int")
    decisions = materialize(decide(heads, min_bytes).withColumn("shares", shares), "warc-decisions")
    p = rows.withColumn("pair", key)
    large = decisions.where("shares > 1")  # at most as many as there are files
    if large.isEmpty():
        p = p.withColumn("share", F.lit(0))
    else:
        own = large.select(key.alias("l_pair"), "shares")
        p = p.join(own, F.col("pair") == F.col("l_pair"), "left").drop("l_pair")
        p = p.withColumn("share", F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), "shares").cast("int"), F.lit(0))).drop("shares")
    d = decisions.select(key.alias("pair"), "refers_to", "refers_uri", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    both = F.concat_ws("/", "pair", "share").alias("key")
    all_rows = p.select("*", both).repartition(files, "key").join(d.select(both, "refers_to", "refers_uri").repartition(files, "key"), "key")
    all_rows = all_rows.withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("uri")))

    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), _headers(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("id"), F.col("digest"), F.col("share"), F.col("number"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("digest"), F.lit(0), F.lit(1)))),
        ("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        ("WARC-Refers-To-Date", F.when(revisit, date)),
        ("X-Page-Id", F.col("id").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", length.cast("string"))), F.lit(CRLF * 2))
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("body")))
    all_rows.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(data: bytes):
    """Yields (header dict with lower-case names, block) for each record of one archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        at, n = end + 4, int(head["content-length"])
        yield head, data[at:at + n]
        at += n + 4


def _inflate(data: bytes) -> bytes:
    """Of one or several gzip members; data that isn't compressed stays."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out) or data


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in ``path``, see ``FIELDS``; ``digest`` is computed from a response's payload, and that of
    a revisit is the one it claims.  Its ``payload_bytes`` and ``payload`` are null until resolved."""

    def rows(batches):
        for batch in batches:
            for data in batch.column(0):
                out, size = [], 0
                for head, block in parse(_inflate(data.as_py())):
                    body = block.partition(b"\r\n\r\n")[2]
                    revisit = head["warc-type"] == "revisit"
                    digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
                    page = head.get("x-page-id")
                    out.append((head["warc-record-id"], head["warc-type"], int(page) if page else None, head.get("warc-target-uri"), digest,
                                head.get("warc-refers-to"), None if revisit else len(body), body if with_payload and not revisit else None))
                    size += len(block)
                    if size > 8 << 20:
                        yield made(out)
                        out, size = [], 0
                yield made(out)

    def made(out):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in FIELDS.split(", ")]
        cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, FIELDS)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page id of the response that a revisit names, and that response's payload and size.

    A plain join on record ids, which are unique, so that the revisits of one response can be split.
    """
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("r_id"), F.col("page_id").alias("r_page"), F.col("payload_bytes").alias("r_bytes"), F.col("payload").alias("r_payload"), F.col("digest").alias("r_digest"))
    revisits = records.where("record_type = 'revisit'")
    joined = revisits.join(originals, revisits["refers_to_record"] == F.col("r_id"), "left")
    plain = [F.col(c) for c in ("record_id", "record_type", "page_id", "uri")]
    return (records.where("record_type != 'revisit'").select(*plain, "digest", "payload_bytes", "payload", F.lit(None).cast("long").alias("refers_to"))
            .unionByName(joined.select(*plain, F.coalesce("r_digest", "digest").alias("digest"), F.col("r_bytes").alias("payload_bytes"),
                                       F.col("r_payload").alias("payload"), F.col("r_page").alias("refers_to"))))
