"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header block of every record (the WARC header and the
HTTP response head before the payload) is stored apart; a join on the digest gives the original records back,
which are WARC/1.1 records byte for byte. Pages have no time of capture, so the records' date is a parameter.

Defined results
  null html       an empty payload (0 bytes), deduplicated like any other when ``min_bytes`` is 0
  null url        the header ``WARC-Target-URI`` is left out
  odd url         control characters are percent-encoded in ``WARC-Target-URI``, and ``X-Exact-URI`` has the url in base64
  long payload    stored and read like any other; a row holds it whole
  null page_id    the record's id is made of a digest of url and payload, and it never becomes the target of a revisit,
                  unless all records with its payload lack one; then all of those are responses
  repeated rows   rows with the same page_id and payload are records of the same kind, and with the same record id
  ties            none: of records with equal payloads the largest page_id is the response
  empty table     an empty archive
  other columns   ignored
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The alphabet of base32 (RFC 4648) and the digits of radix 32 that ``conv`` writes.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RADIX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

CRLF = "\r\n"

#: The profile of WARC/1.1 for revisits of equal payloads, and the head put before each payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=UTF-8" + CRLF * 2
PAGE, NAMELESS = "urn:page:", "urn:nameless:"
HEAD_BYTES = 8192  # headers are looked for in so many bytes first


def base32_of_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal SHA-1: four groups of 40 bits, eight letters each."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * g, 10), 16, 32), 8, "0") for g in range(4)]
    return F.translate(F.concat(*groups), RADIX32, BASE32)


@dataclass(frozen=True)
class Archive:
    """``headers``: one row per record; ``payloads``: one row per distinct payload."""

    headers: DataFrame
    payloads: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(name + ": "), value.cast("string"), F.lit(CRLF)))


def write_archive(pages: DataFrame, min_bytes: int = 0, stored: bool = True, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write a record for every row of ``pages(page_id, url, html)``.

    One aggregation finds each payload's owner and keeps its bytes: partial aggregation comes first, so a
    payload with a third of all records moves once per task, and every other payload moves once.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    records = pages.select("page_id", "url", body.alias("payload")).select(
        "page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("sha256"), base32_of_sha1(F.sha1("payload")).alias("sha1"),
    )
    # Equal SHA-256 counts as equal bytes only if length and SHA-1 agree too, so they are part of the key.
    key = ["sha256", "sha1", "payload_bytes"]
    payloads = records.groupBy(*key).agg(F.max("page_id").alias("owner"), F.first("payload").alias("payload"))
    if stored:
        payloads = materialize(payloads, "warc-payloads")
    large = F.col("payload_bytes") >= min_bytes
    revisit = large & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    typed = records.select("page_id", "url", *key).join(payloads.select("owner", *key), key)
    typed = typed.withColumn("refers_to", F.when(revisit, F.col("owner")))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    name = F.coalesce(F.concat(F.lit(PAGE), F.col("page_id").cast("string")), F.concat(F.lit(NAMELESS), F.sha2(F.concat_ws(" ", "sha256", "url"), 256)))
    odd = F.col("url").rlike("[\\x00-\\x1F\\x7F]")
    plain = F.when(odd, F.url_encode("url")).otherwise(F.col("url"))
    size = F.when(kind == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")) + len(HTTP_HEAD)
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", F.concat(F.lit("<"), name, F.lit(">"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", plain), _line("X-Exact-URI", F.when(odd, F.base64(F.col("url").cast("binary")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _line("X-Payload-Length", F.col("payload_bytes")),
        _line("WARC-Refers-To", F.concat(F.lit("<" + PAGE), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", size), F.lit(CRLF + HTTP_HEAD),
    )
    headers = typed.select("page_id", "sha256", kind.alias("record_type"), head.cast("binary").alias("header"))
    return Archive(materialize(headers, "warc-headers") if stored else headers, payloads.select("sha256", "payload"))


def read_records(archive: Archive) -> DataFrame:
    """Original records: header block, payload (empty for revisits) and the whole record's bytes.

    A response meets its payload by digest; the digest is computed again from the stored bytes, and a
    payload that doesn't have it fails the job.
    """
    checked = archive.payloads.select(
        "sha256",
        F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload lacks its digest")).cast("binary")).alias("payload"),
    )
    responses = archive.headers.where("record_type = 'response'").join(checked, "sha256", "left").select("header", "payload")
    revisits = archive.headers.where("record_type = 'revisit'").select("header", F.lit(b"").alias("payload"))
    end = F.lit((CRLF * 2).encode())
    return responses.unionByName(revisits).withColumn("record", F.concat("header", "payload", end))


def full_payloads(archive: Archive) -> DataFrame:
    """``page_id, payload`` of every record, revisits resolved to the payload they refer to."""
    return archive.headers.select("page_id", "sha256").join(archive.payloads, "sha256", "left").select("page_id", "payload")


def parse_records(records: DataFrame) -> DataFrame:
    """Fields read back from the bytes of whole records; the payload's figures are computed from it where it is there."""
    end_in = lambda data: F.instr(F.decode(data, "ISO-8859-1"), CRLF * 2)  # noqa: E731  one character a byte
    near = end_in(F.substring("record", 1, HEAD_BYTES))
    cut = F.when(near > 0, near).otherwise(end_in(F.col("record")))
    parts = records.select("record", cut.alias("cut")).select(F.decode(F.substring("record", F.lit(1), F.col("cut") - 1), "UTF-8").alias("head"), "record", "cut")

    def field(name: str) -> Column:
        value = F.regexp_extract("head", f"(?m)^{name}: ([^\\r\\n]*)\\r?$", 1)
        return F.when(value == "", None).otherwise(value)

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(field(name), f"^<{PAGE}(-?[0-9]+)>$", 1), F.lit("")).cast("long")

    got = parts.select(
        page("WARC-Record-ID").alias("page_id"), F.coalesce(F.unbase64(field("X-Exact-URI")).cast("string"), field("WARC-Target-URI")).alias("url"),
        field("WARC-Type").alias("record_type"), field("X-Payload-Length").cast("long").alias("said_bytes"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("said_digest"),
        page("WARC-Refers-To").alias("refers_to"), field("Content-Length").cast("long").alias("content_length"), "record", "cut",
    )
    body = F.substring("record", F.col("cut") + 4 + len(HTTP_HEAD), (F.col("content_length") - len(HTTP_HEAD)).cast("int"))
    here = F.col("record_type") == "response"
    return got.withColumn("payload", F.when(here, body)).select(
        "page_id", "url", "record_type", "refers_to", "payload",
        F.when(here, F.length("payload").cast("long")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(here, base32_of_sha1(F.sha1("payload"))).otherwise(F.col("said_digest")).alias("payload_digest"),
    )
