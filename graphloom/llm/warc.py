"""WARC archives with revisit records in place of repeated payloads.

Headers only (id, payload digest, size) are shuffled by digest to find the original response of each
repeated payload: among equal payloads of at least LEAST bytes the one with the largest id. Up to
BROADCAST_DIGESTS repeated payloads are sent to the pages, which stay where they are; with more, large
pages are joined with them by digest, a hot digest being dealt over SALTS keys. Then each is written: a
response record with its payload, or a revisit record that names the response and has no payload. Records are
made as text and written by Spark's text writer, so archives go to any store that Spark knows and a
lost task leaves no half file. The reader parses records by their Content-Length.

A null html is an empty payload. Rows that repeat a page_id have a record each, and of those with equal
payloads the last is the original. Without a page_id a row has its own response record and is never
referred to. An empty table gives no records. The url is percent-encoded where it holds
blanks or control characters. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path

LEAST, SALTS, FILE_RECORDS = 1000, 16, 1000
#: Repeated payloads up to which their headers are broadcast (60 bytes each) and pages are not shuffled.
BROADCAST_DIGESTS = 500_000
#: Bytes of payloads that a reader hands on at once.
READ_BYTES = 8 << 20
BREAK, END = "\r\n", "\r\n\r\n"


def resolve(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) with digest, bytes and refers_to (null: a response)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.monotonically_increasing_id().alias("row"))
    pages = pages.withColumns({"digest": F.sha1(F.encode("html", "UTF-8")), "bytes": F.octet_length("html").cast("long")})
    large = (F.col("bytes") >= LEAST) & F.col("page_id").isNotNull()
    headers = pages.where(large).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("original"))
    original = cut(headers.where("n > 1").select("digest", F.col("original.page_id").alias("original"), F.col("original.row").alias("original_row")), "originals")
    none = F.lit(None).cast("long")
    small = pages.where(~large | F.col("page_id").isNull()).withColumns({"original": none, "original_row": none})
    if original.count() <= BROADCAST_DIGESTS:
        found = pages.where(large).join(F.broadcast(original), "digest", "left")
    else:
        dealt = original.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = pages.where(large).withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(SALTS)).cast("int"))
        found = salted.join(dealt, ["digest", "salt"], "left").drop("salt")
    out = found.unionByName(small)
    return out.withColumn("refers_to", F.when(F.col("original_row") != F.col("row"), F.col("original"))).drop("original", "original_row", "row")


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes gzip-compressed archives with a record for each page."""
    rows = resolve(pages)
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(BREAK))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri("refers_to")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("bytes").cast("string"))),
        F.lit(BREAK),
    )
    text = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    out = rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip")
    out.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive, read one by one."""
    while first := file.readline():
        if not re.fullmatch(rb"WARC/1\.\d\r\n", first):
            raise ValueError(f"no record begins with {first[:40]!r}")
        headers = {}
        while (line := file.readline()) != BREAK.encode():
            if not line.endswith(BREAK.encode()):
                raise ValueError("the archive ends inside a header")
            name, _, value = line.decode("utf-8").removesuffix(BREAK).partition(":")
            headers[name] = value.strip(" ")
        payload = file.read(int(headers["Content-Length"]))
        if file.read(4) != END.encode():
            raise ValueError(f"the record {headers.get('WARC-Record-ID')} does not end at its length")
        yield headers, payload


SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record; the payload, checked against its digest, for responses."""
    schema = SCHEMA if payloads else SCHEMA.rsplit(",", 1)[0]

    def frame(out: list) -> pd.DataFrame:
        names = [c.split() for c in schema.split(", ")]
        # integers that may be null, without a detour over floats
        return pd.DataFrame({n: pd.array([r[k] for r in out], "Int64") if t == "long" else pd.Series([r[k] for r in out], dtype=object) for k, (n, t) in enumerate(names)})

    def run(batches):
        for data in (x for pdf in batches for x in pdf["content"]):
            out, held = [], 0
            for h, payload in records(gzip.open(io.BytesIO(data))):
                digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                    raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
                number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x)) else None
                row = (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, number(h.get("WARC-Refers-To", "")), digest, int(h["X-Payload-Length"]), payload if kind == "response" else None)
                out.append(row if payloads else row[:-1])
                held += len(payload) * payloads
                if held > READ_BYTES:
                    yield frame(out)
                    out, held = [], 0
            yield frame(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(run, schema)


def restore(archive: DataFrame) -> DataFrame:
    """All records of :func:`read` with payloads, those of revisits taken from their responses."""
    revisits = archive.where("record_type = 'revisit'").drop("payload").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    originals = archive.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload").dropDuplicates(["refers_to"])
    originals = originals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = revisits.join(originals, ["refers_to", "salt"], "left").select(archive.columns)
    return archive.where("record_type = 'response'").unionByName(found)


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives
    written to the shared folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
