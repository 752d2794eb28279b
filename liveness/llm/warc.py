"""A content-addressed WARC archive: payload bytes once per strong digest, record headers apart.

``write_archive`` writes two tables, ``payloads`` (digest, payload) and ``records`` (the exact
header bytes of every record and the digest of its payload); ``read_archive`` joins them
back to whole records and parses those."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_root
from .common import join_by_count, stage, text_slices

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page id, url and the payload's length, SHA-256 and SHA-1."""
    for piece in text_slices(batches, "payload", 1 << 24):
        found = [(len(p), hashlib.sha256(p).digest(), base64.b32encode(hashlib.sha1(p).digest()).decode())
                 for p in (v.as_buffer() for v in piece.column(2))]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array([n for n, _, _ in found], pa.int64()),
             pa.array([d for _, d, _ in found], pa.binary()), pa.array([s for _, _, s in found], pa.string())],
            names=["page_id", "url", "size", "digest", "sha1"])


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def _header(row: str = "row_id") -> Column:
    """The exact header bytes of a record, up to and including the blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    record = lambda c: F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat(F.lit("record "), c.cast("string")), 256), F.lit(">"))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")  # a header value is one line
    revisit = F.col("type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("type")), line("WARC-Record-ID", record(F.col(row))),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", record(F.col("first_row"))),
            F.coalesce(line("X-Refers-To-Page", F.col("first_page").cast("string")), F.lit("")),
            line("X-Payload-Length", F.col("size").cast("string")))).otherwise(F.lit("")),
        F.coalesce(line("X-Page", F.col("page_id").cast("string")), F.lit("")), line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))), F.lit(CRLF)).cast("binary")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  least: int = 0) -> None:
    """Write ``pages`` as an archive below ``path`` (``payloads`` and ``records``, Parquet).

    Of records with equal payloads of at least ``least`` bytes the one with the smallest id
    (null ids last; of rows that repeat it, one) is a response, the others are revisits of it;
    smaller payloads are all responses. A payload's bytes are stored once whatever the records.
    Null html is an empty payload, a null url leaves its header line out, a null id too.
    Control characters and blanks of a url are written as %20. No pages give empty tables.
    Other columns are not read.

    Digests are grouped, not payloads: bytes move only to the place where they are stored."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                          _payload(html_col).alias("payload"))
    found = stage(source.mapInArrow(_digests, "page_id long, url string, size long, digest binary, sha1 string")
                  .withColumn("row_id", F.monotonically_increasing_id()), "digests")
    first = stage(found.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row_id")).alias("w"), F.count(F.lit(1)).alias("n"))
        .select("digest", F.col("w.page_id").alias("first_page"), F.col("w.row_id").alias("first_row"), "n"), "first")
    met = join_by_count(found, first, "digest", "n").withColumn(
        "type", F.when((F.col("size") < least) | (F.col("row_id") == F.col("first_row")), "response").otherwise("revisit"))
    met.select("row_id", _header().alias("header"), F.when(F.col("type") == "response", F.col("digest")).alias("digest")) \
        .write.mode("overwrite").parquet(f"{path}/records")
    # pages whose bytes another page stores; by id, or by digest too where an id repeats
    repeated = stage(found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .select(F.col("page_id").alias("again")), "repeated")
    others = stage(found.join(first.select(F.col("first_row").alias("row_id")), "row_id", "left_anti")
                   .select(F.col("page_id").alias("other")).distinct(), "others")
    same = lambda a: F.col("page_id").eqNullSafe(F.col(a))
    payloads = source.select("page_id", "payload")
    single = payloads.join(others, same("other"), "left_anti").join(repeated, same("again"), "left_anti")
    several = (payloads.join(repeated, same("again"), "left_semi").withColumn("digest", F.unhex(F.sha2("payload", 256)))
               .join(first.select("digest", F.col("first_page").alias("at")), "digest").where(same("at"))
               .dropDuplicates(["digest"]))
    (single.select(F.unhex(F.sha2("payload", 256)).alias("digest"), "payload")
     .unionByName(several.select("digest", "payload")).write.mode("overwrite").parquet(f"{path}/payloads"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fields of whole records; every response's payload is held against its digests."""
    for piece in text_slices(batches, "record", 1 << 24):
        out = []
        for digest, record in zip(piece.column(0).to_pylist(), piece.column(1)):
            raw = record.as_buffer().to_pybytes()
            head, _, body = raw.partition(b"\r\n\r\n")
            lines = head.decode().split(CRLF)
            field = dict(x.split(": ", 1) for x in lines[1:])
            length = int(field["Content-Length"])
            payload, kind = body[:length], field["WARC-Type"]
            sha1 = field["WARC-Payload-Digest"].removeprefix("sha1:")
            if body[length:] != b"\r\n\r\n" or lines[0] != "WARC/1.1":
                raise ValueError(f"record {field['WARC-Record-ID']}: its length does not fit")
            if kind == "response" and (hashlib.sha256(payload).digest() != digest
                                       or base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1):
                raise ValueError(f"record {field['WARC-Record-ID']}: its payload is not the one digested")
            refers = field.get("X-Refers-To-Page")
            page = field.get("X-Page")
            out.append((None if page is None else int(page), field.get("WARC-Target-URI"), kind,
                        int(field.get("X-Payload-Length", length)), sha1, None if refers is None else int(refers)))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                         names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records as they were: ``digest`` (null for revisits) and ``record``, the
    whole bytes: header, payload, two line ends."""
    heads, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    end = F.lit(b"\r\n\r\n")
    # responses have each digest once unless payloads below the length limit repeat
    whole = (heads.where("digest is not null").join(payloads, "digest")
             .select("digest", F.concat("header", "payload", end).alias("record")))
    bare = heads.where("digest is null").select("digest", F.concat("header", end).alias("record"))
    return whole.unionByName(bare)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive, parsed and verified: page_id, url, record_type, payload_bytes,
    payload_digest (base32 SHA-1), refers_to. A damaged record raises."""
    return records(spark, path).mapInArrow(
        _parsed, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """``write_archive`` into the shared folder, then ``read_archive``."""
    spark = pages.sparkSession
    path = f"{stage_root(spark)}/llm-archive-{uuid.uuid4().hex[:12]}"
    write_archive(pages, path, **options)
    return read_archive(spark, path)
