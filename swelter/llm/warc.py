"""WARC archives: writing captures, reading records, assembling transactions.

Records are written by Spark's text writer, so any file system Spark knows will do: a
record ends with two line breaks, which is the writer's line separator. Each capture is
a response (or a revisit, if its payload is stored elsewhere), a request and a metadata
record; the latter two name the first in WARC-Concurrent-To. Files hold a bounded number
of captures, so that a reader's task can hold a file.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swelter.llm.common import written

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are stored each time.
MIN_SHARED = 100
CAPTURES_PER_FILE = 2000
RECORD_SCHEMA = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, digest string, payload_bytes long, block string, payload string"


def _id(kind: str, key: Column, url: Column, digest: Column) -> Column:
    """A urn:uuid made of what the capture holds, so that rerun tasks write the same ids."""
    h = F.md5(F.concat_ws("\x00", F.lit(kind), F.coalesce(key.cast("string"), F.lit("\x01")), url, digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line breaks; null headers are left out."""
    lines = [F.lit(VERSION), *[F.concat(F.lit(f"{name}: "), value) for name, value in headers]]
    return F.concat(F.concat_ws("\r\n", *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))), F.lit("\r\n\r\n"), block)


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Captures with digests, and for each whether it is a response or a revisit of which.

    Null payloads are empty, null urls about:blank. Of equal payloads of MIN_SHARED bytes
    or more, the smallest key is the response (of its urls the smallest is referred to);
    rows of one key and payload that repeat are all responses. Null keys sort first. Keys
    and digests are grouped alone, with partial sums; bodies move once at most, to meet
    the digests that are shared, in a join whose large partitions the optimizer can split.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    caps = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("about:blank")).alias("url"), body.alias("body"))
    caps = caps.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    first = caps.where(F.col("bytes") >= MIN_SHARED).groupBy(F.col("digest").alias("_d")).agg(F.min(F.struct("key", "url")).alias("first"), F.count("*").alias("_n"))
    shared = first.where("_n > 1").select("_d", "first")
    out = caps.join(shared, F.col("digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("key").eqNullSafe(F.col("first.key"))
    return out.select("key", "url", "body", "bytes", "digest", revisit.alias("revisit"), "first")


def records(captures: DataFrame) -> DataFrame:
    """The text of the records of planned() captures: three rows (value) for each.

    Ids name the content (key, url and payload), so rows that repeat entirely have equal
    records, whichever is meant; others with one key differ.
    """
    named = lambda kind: _id(kind, F.col("key"), F.col("url"), F.col("digest"))
    own, asked = named("capture"), named("request")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "%0A"))]
    response = _record([("WARC-Type", F.lit("response")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))], F.concat(http, F.col("body")))
    refers = _id("capture", F.col("first.key"), F.col("first.url"), F.col("digest"))
    revisit = _record([("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), ("Content-Type", F.lit("application/http; msgtype=response"))], http)
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[^:]*://[^/?#]*([^#\s]*)", 1), F.lit("")), F.lit("/"))
    request = _record([("WARC-Type", F.lit("request")), ("WARC-Record-ID", asked), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\n\r\n")))
    # metadata names the request, as some crawlers do; assembly follows both steps
    note = F.concat(F.lit("capture-key: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record([("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", named("metadata")), *common, ("WARC-Concurrent-To", asked), ("Content-Type", F.lit("application/warc-fields"))], note)
    return captures.select(F.explode(F.array(F.when(F.col("revisit"), revisit).otherwise(response), request, metadata)).alias("value"))


def write(captures: DataFrame, path: str, compression: str = "gzip") -> None:
    """Archives of CAPTURES_PER_FILE captures at most, through Spark's own writer."""
    records(captures).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", 3 * CAPTURES_PER_FILE).text(path)


_HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, by their Content-Length; what is no record is an error."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at} of {len(data)}")
        named: dict[str, list[str]] = {}
        for name, value in _HEADER.findall(data[at:end]):
            named.setdefault(name.decode("utf-8", "replace").lower(), []).append(value.decode("utf-8", "replace"))
        size = int(named.get("content-length", ["0"])[0])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the WARC record at byte {at} is cut off")
        at = end + 4 + size
        kind = named.get("warc-type", [""])[0].lower()
        payload, n, digest = None, None, (named.get("warc-payload-digest") or [""])[0].rpartition(":")[2] or None
        if kind in ("response", "revisit"):
            head, _, payload = block.partition(b"\r\n\r\n")
            n = len(payload)
            if kind == "revisit":  # the stored headers tell the length of the payload
                told = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
                n, payload = int(told[1]) if told else None, None
            else:
                digest = hashlib.sha256(payload).hexdigest()
        one = lambda name: named.get(name, [None])[0]
        text = lambda b: None if b is None else b.decode("utf-8", "replace")
        yield one("warc-record-id"), kind, named.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), digest, n, None if kind == "response" else text(block), text(payload)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under path; a task reads whole files, one at a time.

    The digest of a response is taken of the payload that was read, that of a revisit is
    the one it states. payloads=False leaves the column payload out.
    """
    schema = RECORD_SCHEMA if payloads else RECORD_SCHEMA.rpartition(", ")[0]
    names = [c.split()[0] for c in schema.split(", ")]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                held = 0
                for row in parse(bytes(content)):
                    held += len(row[8] or "") + 200
                    rows.append(row[: len(names)])
                    if held > 4_000_000:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(parsed, schema)


def assembled(recs: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: its records joined by concurrent-to.

    Links count in either direction and over two steps (metadata that names the request
    that names the response). Of several requests or metadata records of a capture the
    smallest record id is taken; records linked to no capture are left out; a capture
    may lack either. revisit rows get `original`, the response that they refer to, or
    null if it isn't there.
    """
    kinds = recs.select("record_id", "type")
    captured = F.col("type").isin("response", "revisit")
    told = recs.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = told.unionByName(told.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    roots = kinds.where(captured).select("record_id").distinct()
    one = links.join(roots, links.b == roots.record_id).select(F.col("a").alias("rec"), F.col("b").alias("root"))
    two = links.join(one, links.b == one.rec).select(F.col("a").alias("rec"), "root").where(F.col("rec") != F.col("root"))
    near = one.select("rec", F.struct(F.lit(1).alias("steps"), "root").alias("r")).unionByName(two.select("rec", F.struct(F.lit(2).alias("steps"), "root").alias("r")))
    near = near.groupBy("rec").agg(F.min("r").alias("r")).select("rec", F.col("r.root").alias("root"))

    def side(kind: str) -> DataFrame:
        rows = recs.where(F.col("type") == kind).join(near, F.col("record_id") == F.col("rec"))
        best = rows.groupBy("root").agg(F.min(F.struct("record_id", "target_uri", "block")).alias(kind))
        return best.withColumnRenamed("root", f"_{kind}_root")

    heads = recs.where(captured)
    out = heads.join(side("request"), F.col("record_id") == F.col("_request_root"), "left").join(side("metadata"), F.col("record_id") == F.col("_metadata_root"), "left")
    fields = ["record_id", "type", "target_uri", "digest", "payload_bytes", "refers_to"] + ["payload"] * ("payload" in recs.columns)
    out = out.select(F.struct(*fields).alias("response"), "request", "metadata")
    out = written(out, "captures")
    # a record that many refer to is asked for once by each of SALTS parts of them
    refers = F.col("response.refers_to")
    salted = out.where(refers.isNotNull()).withColumn("_salt", F.pmod(F.xxhash64("response.record_id"), F.lit(SALTS)))
    asked = salted.select(refers.alias("_of"), "_salt").distinct()
    kept = out.where("response.type = 'response'").select(F.col("response.record_id").alias("_original"), F.struct("response.record_id", "response.target_uri", "response.digest", "response.payload_bytes", "metadata").alias("original"))
    kept = kept.join(asked.select(F.col("_of").alias("_original")).distinct(), "_original", "left_semi").groupBy("_original").agg(F.min("original").alias("original"))
    told = asked.join(kept, F.col("_of") == F.col("_original")).select("_of", F.col("_salt").alias("_s"), "original")
    revisits = salted.join(told, (refers == F.col("_of")) & (F.col("_salt") == F.col("_s")), "left").select("response", "request", "metadata", "original")
    others = out.where(refers.isNull()).withColumn("original", F.lit(None).cast(kept.schema["original"].dataType))
    return others.unionByName(revisits)


#: Parts that the revisits of one record are dealt over.
SALTS = 64


def capture_key(metadata: str = "metadata") -> Column:
    """The key that write() put into the metadata record, as text; null if it was null."""
    return F.nullif(F.regexp_extract(F.col(f"{metadata}.block"), r"capture-key: ([^\r\n]*)", 1), F.lit(""))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes pages as archives under path, reads them back and assembles the captures."""
    write(planned(pages), path)
    return assembled(written(read(pages.sparkSession, path, payloads=False), "warc-records"))
