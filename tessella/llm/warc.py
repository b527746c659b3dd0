"""Operator 11, WARC archives whose repeated payloads are revisits, in DataFrame functions only.

Writing: headers (payload digest and id) are shuffled by digest, the smallest id of each repeated
payload becomes its original, and pages join the originals: the original is a response, the others are
revisit records that refer to it and carry no payload. Records are written by Spark's text sink with
CR LF CR LF after each, which is the archive format byte for byte, under Spark's commit protocol.

Reading: Spark's text source splits archives at the version mark, so large archives are read by many
tasks. A payload may hold the mark itself; the chain of Content-Lengths decides. A running maximum of
declared ends cuts a file where no record can reach across; only the rare runs between such cuts that
hold several fragments are followed in order and put together again.
"""

from __future__ import annotations

import datetime
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import discard, fresh, materialize, ship

# The format's own.
END = "\r\n"
BLANK = END + END
MARK = "WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SMALL = 100_000  # rows of a table that may be broadcast, each of some hundred bytes


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, upper case: eight groups of 20 bits are four digits each."""
    h = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, HEX32, BASE32)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for a broadcast if it has few rows; Spark shuffles it otherwise."""
    return F.broadcast(df) if rows <= SMALL else df


def records_of(pages: DataFrame, id_col: str, url_col: str | None, payload_col: str, least: int) -> DataFrame:
    """A row per page: row, page_key, url, payload, bytes, digest, and of its original orig_row, orig_key, orig_url (null for a response).

    Of records with equal payloads of at least `least` bytes the smallest id is the original; null ids
    come last, and of repeated ids the first row. A row's number is its place in the scan, so pages
    must be a table that gives its rows in the same order when it is read again.
    """
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    # A second hash beside SHA-1, for which unlike payloads with one digest are known.
    base = base.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload")), "check": F.xxhash64("payload")})
    heads = base.where(F.col("bytes") >= least).groupBy("digest", "check", "bytes")
    first = F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row", "url")).alias("first")
    repeated = heads.agg(F.count(F.lit(1)).alias("n"), first).where(F.col("n") > 1)
    originals = materialize(repeated.select("digest", "check", "bytes", F.col("first.row").alias("orig_row"), F.col("first.page_id").cast("string").alias("orig_key"), F.col("first.url").alias("orig_url")), "warc-originals")
    out = base.join(small(originals, originals.count()), ["digest", "check", "bytes"], "left")
    own = F.col("orig_row") == F.col("row")
    return out.select("row", F.col("page_id").cast("string").alias("page_key"), "url", "payload", "bytes", "digest", *[F.when(~own, F.col(c)).alias(c) for c in ("orig_row", "orig_key", "orig_url")])


def named(name: str, value) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 0, compression: str = "none", date: str | None = None) -> None:
    """Writes a WARC record per page to a new folder: responses, and revisits of payloads that are there already.

    Null payloads are empty, null ids have no X-Page-Key header, null urls a target of urn:page:<id>.
    Line ends within ids and urls become spaces. Headers are fresh: record ids are new in each call,
    and date (now, in UTC) stands for all records. Repeated rows have a record each; an empty table
    gives an empty folder. Other columns are ignored. compression: none, which many tasks can read a
    file of, or gzip.
    """
    salt = F.lit(uuid.uuid4().hex)
    at = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    flat = lambda c: F.regexp_replace(c, r"[\r\n]+", " ")
    target = lambda url, key: F.coalesce(flat(F.col(url)), F.concat(F.lit("urn:page:"), F.coalesce(flat(F.col(key)), F.lit("null"))))
    record_id = lambda row: F.regexp_replace(F.md5(F.concat_ws("/", salt, F.col(row).cast("string"))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    rows = records_of(pages, id_col, url_col, payload_col, least)
    revisit = F.col("orig_row").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(BLANK))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    head = F.concat(
        F.lit(f"{MARK}1{END}"),
        named("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        named("WARC-Record-ID", record_id("row")),
        named("WARC-Date", F.lit(at)),
        named("WARC-Target-URI", target("url", "page_key")),
        named("X-Page-Key", flat(F.col("page_key"))),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        named("WARC-Profile", F.when(revisit, PROFILE)),
        named("WARC-Refers-To", F.when(revisit, record_id("orig_row"))),
        named("WARC-Refers-To-Target-URI", F.when(revisit, target("orig_url", "orig_key"))),
        named("WARC-Refers-To-Date", F.when(revisit, at)),
        named("Content-Type", F.lit("application/http; msgtype=response")),
        named("Content-Length", F.octet_length("block").cast("string")),
        F.lit(END),
    )
    record = F.concat(head.cast("binary"), F.col("block")).cast("string")
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", BLANK).option("compression", compression).text(path)


def field(head: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; null where it isn't there."""
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.rtrim(found))


def head_of(value: Column) -> Column:
    return F.substring_index(value, BLANK, 1)


def declared(value: Column) -> Column:
    """Bytes of a fragment by its own header, with the blank lines after header and block; null where it is no header."""
    head = head_of(value)
    length = F.try_to_number(field(head, "Content-Length"), F.lit("9" * 18))
    return F.when(F.octet_length(head) < F.octet_length(value), F.octet_length(head) + 4 + length.cast("long") + 4)


def knots(parts: DataFrame) -> DataFrame:
    """Of fragments that aren't whole records: file, seq and the offset of the record that they belong to.

    parts: file, block, seq, size, says. A fragment where the declared ends of all before it have been
    reached begins a record for certain, since records fill a file without gaps. What lies between
    such fragments is followed from its first one by the declared ends.
    """
    order = Window.partitionBy("file").orderBy("block", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("size") + len(MARK)
    at = parts.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))
    # The first fragment of a file is what stands before its first mark.
    at = at.withColumn("until", F.col("offset") + len(MARK) + F.coalesce("says", "size"))
    at = at.withColumn("cut", F.coalesce(F.col("offset") >= F.max("until").over(before), F.lit(True)))
    at = at.withColumn("run", F.sum(F.col("cut").cast("long")).over(order))
    runs = Window.partitionBy("file", "run")
    at = at.withColumn("n", F.count(F.lit(1)).over(runs)).where(F.col("n") > 1)

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        records, start, end = [], -1, -1
        for offset, until in zip(pdf.offset.tolist(), pdf.until.tolist()):
            if offset >= end:
                start, end = offset, until
            records.append(start)
        return pdf.assign(record=records)[["file", "seq", "record", "offset"]]

    return at.select("file", "run", "seq", "offset", "until").groupBy("file", "run").applyInPandas(follow, "file string, seq long, record long, offset long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives in a folder: file, type, record_id, target_uri, date, page_key, digest, profile, refers_to, whole, payload.

    digest is the payload digest as declared, without `sha1:`. The payload is the block, without the
    HTTP header where there is one; revisits have an empty one. A record that ends too soon has
    whole = false and what there is of its block; one without a Content-Length reaches to the next.
    Archives of versions 1.0 and 1.1 are read, plain or compressed as a whole. What stands before a
    file's first record is ignored. A folder without archives gives no rows.
    """
    ship(spark)
    lines = spark.read.option("lineSep", MARK).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    says = declared(F.col("value"))
    tied = materialize(knots(lines.select("file", "block", "seq", F.octet_length("value").cast("long").alias("size"), says.alias("says"))), "warc-knots")
    many = tied.count()
    single = lines.select("file", "seq", "value")
    if many:
        mine = small(tied, many)
        single = single.join(mine.select("file", "seq"), ["file", "seq"], "left_anti")
        parts = lines.join(mine, ["file", "seq"]).groupBy("file", "record").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
        glued = parts.select("file", "seq", F.array_join(F.transform("parts", lambda p: p["value"]), MARK).alias("value"))
        single = single.unionByName(glued)
    else:
        discard(tied)
    head = head_of(F.col("value"))
    rows = single.where(F.octet_length(head) < F.octet_length("value")).withColumns({"head": head, "says": declared(F.col("value"))})
    rows = rows.where(field(F.col("head"), "WARC-Type").isNotNull())
    got = F.octet_length("value").cast("long")
    length = F.coalesce(F.col("says"), got) - F.octet_length("head") - 8
    block = F.substring(F.col("value").cast("binary"), (F.octet_length("head") + 5).cast("int"), F.least(F.greatest(length, F.lit(0)), got).cast("int"))
    names = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "page_key": "X-Page-Key", "digest": "WARC-Payload-Digest", "profile": "WARC-Profile", "refers_to": "WARC-Refers-To", "kind": "Content-Type"}
    rows = rows.select("file", block.alias("content"), F.coalesce(F.col("says") <= got, F.lit(False)).alias("whole"), *[field(F.col("head"), n).alias(c) for c, n in names.items()])
    text = F.col("content").cast("string")
    http = F.substring_index(text, BLANK, 1)
    has_http = F.coalesce(F.lower("kind").startswith("application/http"), F.lit(False))
    payload = F.when(has_http, F.substring(F.col("content"), (F.octet_length(http) + 5).cast("int"), F.octet_length("content"))).otherwise(F.col("content"))
    kept = [c for c in names if c not in ("kind", "digest")]
    return rows.select("file", *kept, F.regexp_replace("digest", "^sha1:", "").alias("digest"), "whole", payload.alias("payload"))


def resolve(records: DataFrame) -> DataFrame:
    """A row per response or revisit of read_archives: page_key, bytes, digest, type, original.

    bytes and digest are those of the full payload: of a response as read, of a revisit those of the
    response that it refers to, whose page_key is `original`. A revisit joins by record id and digest
    together; where there is no such response, bytes and original are null and the digest is as
    declared. Headers alone are shuffled, never payloads.
    """
    heads = records.where(F.col("type").isin("response", "revisit"))
    own = F.col("type") == "response"
    heads = materialize(heads.select("page_key", "record_id", "refers_to", "type", F.when(own, F.octet_length("payload").cast("long")).alias("bytes"), F.when(own, base32_sha1(F.col("payload"))).otherwise(F.col("digest")).alias("digest")), "warc-heads")
    responses, revisits = heads.where(own), heads.where(~own)
    wanted = revisits.select(F.col("refers_to").alias("record_id"), "digest").distinct()
    found = responses.join(wanted, ["record_id", "digest"], "left_semi").groupBy("record_id", "digest").agg(F.min(F.struct("page_key", "bytes")).alias("o"))
    joined = revisits.select("page_key", "type", "digest", F.col("refers_to").alias("record_id")).join(found, ["record_id", "digest"], "left")
    first = responses.select("page_key", "bytes", "digest", "type", F.lit(None).cast("string").alias("original"))
    return first.unionByName(joined.select("page_key", F.col("o.bytes").alias("bytes"), "digest", "type", F.col("o.page_key").alias("original")))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html", least: int = 0, path: str | None = None, compression: str = "none") -> DataFrame:
    """Writes pages as archives to path (a new folder among the scratch tables) and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Everything returned comes from the archives: bytes and digest are counted anew from the payloads.
    """
    spark = pages.sparkSession
    path = path or fresh(spark, "archives", "pages")
    write_archives(pages, path, id_col, url_col, payload_col, least, compression)
    kind = pages.schema[id_col].dataType
    out = resolve(read_archives(spark, path))
    return out.select(F.col("page_key").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("original").cast(kind).alias("refers_to"))


__all__ = ["base32_sha1", "read_archives", "resolve", "round_trip", "write_archives"]
