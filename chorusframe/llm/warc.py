"""WARC archives with revisit resolution.

Headers alone (id, URI, digest, length) are shuffled by payload digest (salted, maxima combined before the shuffle) and
joined with the original response of their payload.  The revisits found are joined to the records by id: broadcast where
they are few, else by a shuffle.  Archives are written with fresh headers in which only originals carry a
payload.  Records are written by Spark's text writer with the record terminator as line separator: it writes
bytes as they are to any file system Spark knows, under the commit protocol, so lost tasks leave nothing behind.
Archives are read by Content-Length, so a payload may hold anything.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, note_kept, shared_dir

MIN_BYTES, SALTS = 1000, 64
#: An archive holds FILE_RECORDS records of less than SMALL bytes, or larger ones up to FILE_BYTES in all (or one that is beyond).
FILE_RECORDS, SMALL, FILE_BYTES = 1000, 128 << 10, 128 << 20
#: Revisits that are broadcast (some 200 bytes each); more are joined by a shuffle.
BROADCAST_REVISITS, BATCH_BYTES = 200_000, 8 << 20
_READ = "record_id bigint, record_type string, uri string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"


def with_digests(records: DataFrame, id_col: str, uri_col: str, payload_col: str) -> DataFrame:
    """``record_id, uri, payload, payload_bytes, payload_digest``; a null payload is empty."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    return rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))


def revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``id, digest, original, original_uri`` of each record that revisits another (see resolve_revisits), from headers alone."""
    heads = records.where(F.col("payload_bytes") >= min_bytes).select(F.col("record_id").alias("id"), F.col("uri"), F.col("payload_digest").alias("digest"), F.col("payload").isNotNull().alias("whole"))
    heads = heads.withColumn("salt", F.pmod(F.xxhash64("id", "uri"), F.lit(SALTS)))
    some = heads.groupBy("digest", "salt").agg(F.max(F.when(F.col("whole") & F.col("id").isNotNull(), F.struct("id", "uri"))).alias("last"), F.count("*").alias("n"))
    groups = some.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    groups = groups.where("n > 1 AND last IS NOT NULL").select("digest", F.explode("salts").alias("salt"), F.col("last.id").alias("original"), F.col("last.uri").alias("original_uri"))
    return heads.join(groups, ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("original"))).select("id", "digest", "original", "original_uri").distinct()


def resolve_revisits(records: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Adds ``record_type, refers_to, refers_to_uri`` to ``record_id, uri, payload, payload_bytes, payload_digest`` and what else there is.

    Of records with equal payloads of at least ``min_bytes``, the one with the largest record_id that has its
    payload (is not itself a revisit, payload null) is the response and the others revisit it.  Rows that
    repeat that record_id are all responses; a null record_id revisits any other and is a response alone.
    """
    found = Scratch(records.sparkSession).write(revisits(records, min_bytes), keep=True)
    few = found.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    own = [c for c in records.columns if c not in ("record_type", "refers_to", "refers_to_uri")]
    row = records.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("r"))
    out = row.join(F.broadcast(found) if few else found, F.col("r.record_id").eqNullSafe(F.col("id")) & (F.col("r.payload_digest") == F.col("digest")) & (F.col("r.payload_bytes") >= min_bytes), "left")
    kind = F.when(F.col("original").isNotNull(), "revisit").otherwise("response")
    return out.select("r.*", kind.alias("record_type"), F.col("original").alias("refers_to"), F.col("original_uri").alias("refers_to_uri"))


def record_bytes(date: str) -> Column:
    """One record without its terminator, from the columns that resolve_revisits gives."""
    text = lambda *x: F.encode(F.concat(*x), "UTF-8")
    revisit = F.col("record_type") == "revisit"
    none = F.concat(F.lit("none-"), F.hex(F.xxhash64("uri", "payload_digest")))
    urn = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), none), F.lit(">"))
    clean = lambda c: F.regexp_replace(c, "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    first = F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To-Target-URI: "), clean("refers_to_uri")), F.lit("")), F.lit(f"\r\nWARC-Refers-To-Date: {date}"),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), urn(F.col("record_id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean("uri")), F.lit("")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, first).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.octet_length(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(text(head), text(http), body)


def write_warc(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", largest: int | None = None) -> None:
    """Archives of bounded size under ``path``; ``largest`` is the longest payload, looked up where it isn't given."""
    held = F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    if "refers_to_uri" not in resolved.columns:
        resolved = resolved.withColumn("refers_to_uri", F.lit(None).cast("string"))
    if largest is None:
        largest = resolved.select(F.max(held)).first()[0] or 0
    for name, part, records in (("small", held < SMALL, FILE_RECORDS), ("large", held >= SMALL, max(1, FILE_BYTES // max(largest, 1)))):
        if name == "small" or largest >= SMALL:
            rows = resolved.where(part).select(record_bytes(date).cast("string").alias("value"))
            rows.write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", records).text(f"{path}/{name}")


_NAME = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)
_DIGITS = re.compile(rb"^<urn:record:(-?\d+)>$")


def parse_warc(data: bytes, payloads: bool = True) -> Iterator[dict]:
    """The records of an archive (plain or gzip): headers, and for a response its payload (null without ``payloads``) with length and digest taken from it."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = {k.lower(): v for k, v in _NAME.findall(data[at:end])}
        block = end + 4
        stop = block + int(head[b"content-length"])
        body = data.index(b"\r\n\r\n", block, stop) + 4
        http = {k.lower(): v for k, v in _NAME.findall(data[block:body])}
        number = lambda name: int(m[1]) if (m := _DIGITS.search(head.get(name, b""))) else None
        out = {"record_id": number(b"warc-record-id"), "record_type": head[b"warc-type"].decode(), "refers_to": number(b"warc-refers-to")}
        out["uri"] = head[b"warc-target-uri"].decode() if b"warc-target-uri" in head else None
        if out["record_type"] == "revisit":
            out |= {"payload": None, "payload_bytes": int(http[b"content-length"]), "payload_digest": head[b"warc-payload-digest"].decode().removeprefix("sha1:")}
        else:
            payload = data[body:stop]
            out |= {"payload": payload if payloads else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}
        yield out
        at = stop + 4


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``record_id, record_type, uri, payload_digest, payload_bytes, refers_to, payload`` of every record under ``path``;
    a revisit has no payload.  Without ``payloads`` that column is null."""
    names = [x.split()[0] for x in _READ.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data in batch.column(0):
                rows, size = [], 0
                for row in parse_warc(data.as_buffer().to_pybytes(), payloads):
                    rows.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return found.select("content").mapInArrow(read, _READ)


def replay(records: DataFrame) -> DataFrame:
    """What read_warc gives, with each revisit's payload filled in from the response that it refers to."""
    found = records.where("record_type = 'response'").select(F.col("record_id").alias("id"), F.col("payload").alias("first")).dropDuplicates(["id"])
    row = records.select(F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("r"))
    out = row.join(found, F.when(F.col("r.record_type") == "revisit", F.col("r.refers_to")) == F.col("id"), "left")
    return out.select(*((F.coalesce("r.payload", "first") if c == "payload" else F.col(f"r.`{c}`")).alias(c) for c in records.columns))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES) -> None:
    """Rewrite the archives under ``source`` so that each payload is stored once."""
    records = read_warc(spark, source).select("record_id", "uri", "payload", "payload_bytes", "payload_digest")
    write_warc(resolve_revisits(records, min_bytes), target)


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page and read the archives back, without payloads.

    Null payloads are empty ones, null urls are left out of the headers, null ids are read back as null; an empty
    table gives no records; further columns are ignored.
    """
    records = with_digests(pages, id_col, uri_col, payload_col)
    largest = records.select(F.max("payload_bytes")).first()[0] or 0
    write_warc(resolve_revisits(records), path, largest=largest)
    return read_warc(pages.sparkSession, path, payloads=False).drop("payload")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    out = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), note_kept(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))
    return out.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS original FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.original IS NOT NULL AND d.page_id <> m.original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> m.original THEN m.original END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""
