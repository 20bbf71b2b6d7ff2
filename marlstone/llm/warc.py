"""WARC archives: a writer, one gzip member a record, and a splittable reader.

A reading task scans its byte range for the gzip magic, takes a candidate for a record if its first bytes inflate to a
WARC header, and owns the records that start inside its range, whose ends may lie beyond it. Files are reached by
pyarrow's filesystems, so the folder may be file://, hdfs://, s3:// or gs://.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import new_folder, store

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STEP = 1 << 16
RECORD = "path string, offset long, length long, record_id string, record_type string, refers_to string, uri string, digest string, payload binary"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def member(record_id: str, record_type: str, refers_to: str | None, uri: str | None, digest: str, payload: bytes, date: str, level: int) -> bytes:
    body = HTTP + (b"" if record_type == "revisit" else payload)
    clean = (uri or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [f"WARC/1.1\r\nWARC-Type: {record_type}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Target-URI: {clean}\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:{digest}"]
    if refers_to:
        head.append(f"WARC-Refers-To: <{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n")
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + packer.flush()


def write_warc(records: DataFrame, folder: str, *, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes records (record_id, record_type, refers_to, uri, digest, payload) and returns the manifest (path, length, records).

    Each task writes files of its own under names that no other attempt has; a file counts only if the manifest, which
    is stored once the tasks have ended, lists it, so a lost or repeated task leaves no record twice. Null refers_to:
    no such header; null uri: empty; null payload: empty.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        size = count = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    path = f"{folder}/records-{uuid.uuid4().hex}.warc.gz"
                    files, inner = _open(path)
                    files.create_dir(inner.rpartition("/")[0])
                    out, size, count = files.open_output_stream(inner, compression=None), 0, 0  # the name would have it compressed once more
                data = member(r.record_id, r.record_type, r.refers_to, r.uri, r.digest, r.payload or b"", date, level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [path], "length": [size], "records": [count]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "length": [size], "records": [count]})

    columns = records.select("record_id", "record_type", "refers_to", "uri", "digest", "payload")
    return store(columns.mapInPandas(write, "path string, length long, records long"), "warc-manifest")


def inflate(source, at: int, size: int, first: memoryview) -> tuple[bytes, int] | None:
    """The record whose member begins at `at`, and the member's length; None if there is none. first: what is read already."""
    unpacker, out, fed, chunk = zlib.decompressobj(31), bytearray(), 0, first[:STEP]
    rest = first[STEP:]
    try:
        while True:
            if not chunk:
                return None  # the file ends inside the member
            fed += len(chunk)
            out += unpacker.decompress(chunk)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None
            if unpacker.eof:
                return (bytes(out), fed - len(unpacker.unused_data)) if out.startswith(b"WARC/1.") else None
            chunk, rest = (rest[:STEP], rest[STEP:]) if rest else (source.read_at(min(STEP, size - at - fed), at + fed) if at + fed < size else b"", b"")
    except zlib.error:
        return None


def parse(path: str, at: int, length: int, data: bytes) -> dict:
    head, _, body = data.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = body[: int(field.get("content-length", 0))]
    payload = body.partition(b"\r\n\r\n")[2] if body.startswith(b"HTTP/") else body
    bare = lambda k: field[k].strip("<>") if k in field else None
    return {"path": path, "offset": at, "length": length, "record_id": bare("warc-record-id"), "record_type": field.get("warc-type"), "refers_to": bare("warc-refers-to"), "uri": field.get("warc-target-uri"), "digest": field.get("warc-payload-digest", "").rpartition(":")[2], "payload": payload}


def records_of(path: str, size: int, begin: int, end: int) -> Iterator[dict]:
    """The records that start in [begin, end)."""
    files, inner = _open(path)
    with files.open_input_file(inner) as source:
        block = source.read_at(min(end + 2, size) - begin, begin)
        at, view = 0, memoryview(block)
        while (at := block.find(MAGIC, at)) >= 0 and begin + at < end:
            got = inflate(source, begin + at, size, view[at:])
            if got is None:
                at += 1
                continue
            yield parse(path, begin + at, got[1], got[0])
            at += got[1]


def read_warc(archives: DataFrame, *, split_bytes: int = 8 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """All records of the archives, a DataFrame with path and length (as write_warc's manifest, or Spark's binaryFile source without its content).

    A task holds one range of split_bytes and the record at hand. What is no record, as damaged members, is passed over;
    an empty table of archives gives no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                for record in records_of(r.path, r.length, r.begin, min(r.begin + split_bytes, r.length)):
                    rows.append(record)
                    held += len(record["payload"])
                    if held >= batch_bytes or len(rows) >= 5000:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows)

    ranges = archives.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))
    n = ranges.count()
    return ranges.repartition(max(1, min(n, 100_000))).mapInPandas(read, RECORD)


#: Into how many parts the copies of a page are dealt.
SALTS = 64


def archive_pages(pages: DataFrame, folder: str | None = None, *, key="page_id", uri="url", html="html", least_bytes=100, **options) -> DataFrame:
    """Writes a record a page and returns the manifest. Of pages with equal payloads of least_bytes or more that with the smallest key is the response, others revisit it.

    Keys may be of any type that has a text form and an order; their text, percent-encoded, names the records. Null html is an empty
    payload; long ones are written whole. An empty table writes no archive. Rows without a key revisit the smallest key of their payload, if any row has one; equal
    rows with the smallest key are responses alike. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").drop("n")
    urn = lambda c: F.coalesce(F.concat(F.lit("urn:page:"), F.url_encode(F.col(c).cast("string"))), F.lit("urn:no-page"))
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    # Copies of one page are dealt out by a salt, so that no task gets the payloads of all of them.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "uri", F.monotonically_increasing_id()), F.lit(SALTS)))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    records = salted.join(first, ["digest", "salt"], "left").select(
        urn("key").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, urn("first")).alias("refers_to"), "uri", "digest", "payload"
    )
    return write_warc(records, folder or new_folder(pages.sparkSession, "warc"), **options)


def page_records(archives: DataFrame, key_type: str = "long", **options) -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to. What a revisit says of its payload comes from the response that it refers to.

    key_type: the type that keys had; they are kept as text in the records' names. Records whose names are no keys of this type
    have a null page_id. Null keys, equal rows and long payloads come back as they were written; an empty table gives an empty result.
    """
    named = lambda c: F.when(F.col(c).startswith("urn:page:"), F.try_url_decode(F.substring(c, len("urn:page:") + 1, 1 << 30))).try_cast(key_type)
    back = store(
        read_warc(archives, **options).select(
            "record_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("sha")
        ), "warc-records")
    whole = back.filter("record_type = 'response' AND sha = digest").groupBy(F.col("record_id").alias("refers_to"), "digest").agg(F.max("bytes").alias("whole_bytes"), F.max("sha").alias("whole_sha"))
    answer = back.filter("record_type = 'response'").withColumns({"whole_bytes": F.col("bytes"), "whole_sha": F.col("sha")})
    again = back.filter("record_type = 'revisit'").join(whole, ["refers_to", "digest"], "left")
    return answer.unionByName(again).select(
        named("record_id").alias("page_id"), F.col("whole_bytes").alias("payload_bytes"), F.col("whole_sha").alias("payload_digest"), "record_type", named("refers_to").alias("refers_to")
    )
