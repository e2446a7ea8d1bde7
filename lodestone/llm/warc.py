"""WARC archives, index first.

``write_archives`` writes a record for each row, each record a gzip member of its own, and returns an index with
file, offset, length, URL and digest.  The index is what counts: archives that a lost task leaves behind are in no
index and are never read.  ``read_archives`` sorts the index entries that were selected, joins neighbours into one
byte-range read where the gap between them is small, and takes the records apart.

Of records with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others
are revisits of it, without payload.  Smaller ones are all responses.  A null id counts as the smallest; of repeated
rows of the largest id (the same id and payload), that with the largest url is the response, once, and the others
are revisits that refer to the same id.  A null payload is empty, a null url has no WARC-Target-URI.  An empty table
gives an empty index.  Payloads are not shuffled: which rows are revisits is told to the rows where they are read.  Only ``id_col``, ``url_col`` and ``payload_col`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import _files
from lodestone.llm._rows import keep_rows, place, placed
from lodestone.runtime import Scratch, shuffle_partitions

LEAST = 1000
#: An archive is closed once it has this many bytes.
ROLL = 256 << 20
#: Neighbouring records are read at once if the gap is at most GAP, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"

_SAFE = {c: f"%{c:02X}" for c in (*range(33), 127)}


def _urn(record_id: str | None) -> str:
    return f"<urn:page:{'' if record_id is None else record_id}>"


def record(record_id: str | None, url: str | None, kind: str, refers_to: str | None, digest: str, payload: bytes | None, length: int, date: str = DATE) -> bytes:
    """One record; ``length`` and ``digest`` are those of the full payload, also where a revisit leaves it out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {url.translate(_SAFE)}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """id, url, kind, refers_to, digest, length, payload (null for a revisit); a response's payload is held against its digest."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    name = lambda k: head[k][len("<urn:page:") : -1] or None if k in head else None
    kind = head["warc-type"]
    if kind == "response" and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} doesn't have its digest")
    return {"id": name("warc-record-id"), "url": head.get("warc-target-uri"), "kind": kind, "refers_to": name("warc-refers-to"), "digest": digest, "length": length, "payload": body if kind == "response" else None}


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


INDEX = "id string, url string, kind string, refers_to string, digest string, payload_bytes long, file string, offset long, length long"


def _records(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int, scratch: Scratch) -> DataFrame:
    """id, url, kind, refers_to, digest, payload_bytes, payload for each row of ``df``; payloads of revisits go nowhere."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = placed(df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")), scratch)
    digests = [F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("payload_bytes")]
    large = scratch.keep(rows.select("id", "url", *digests, place(rows).alias("place")).filter(F.col("payload_bytes") >= least), "large")
    rank = F.struct(F.col("id").isNotNull().alias("some"), "id", F.col("url").isNotNull().alias("url_some"), "url", "place")
    heads = scratch.keep(large.groupBy("digest").agg(F.max(rank).alias("head"), F.count("*").alias("n")).filter("n > 1").select("digest", "head"), "heads")
    revisits = scratch.keep(large.join(heads, "digest").filter("place <> head.place"), "revisits")
    names = ["id", "url", "kind", "refers_to", "digest", "payload_bytes", "payload"]
    none = F.lit(None).cast(rows.schema["id"].dataType)
    left = keep_rows(rows, revisits, scratch).select("id", "url", F.lit("response").alias("kind"), none.alias("refers_to"), *digests, "payload")
    return left.unionByName(revisits.select("id", "url", F.lit("revisit").alias("kind"), F.col("head.id").alias("refers_to"), "digest", "payload_bytes", F.lit(None).cast("binary").alias("payload")).select(names))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Archives and, below folder/index, the index; returns the index as read back."""
    spark = df.sparkSession
    scratch = Scratch(spark, "warc")
    rows = _records(df, id_col, url_col, payload_col, least, scratch)
    rows = rows.select(F.col("id").cast("string"), "url", "kind", F.col("refers_to").cast("string"), "digest", "payload_bytes", "payload")

    def write(batches):
        out, at, name = None, 0, ""
        for b in batches:
            places = []
            for r in zip(*(c.to_pylist() for c in b.columns[:6]), b.column(6)):
                if out is None or at >= ROLL:
                    if out is not None:
                        out.close()
                    name, at = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz", 0
                    out = _files.create(name)
                    info = _gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode())
                    out.write(info)
                    at += len(info)
                data = _gzip(record(r[0], r[1], r[2], r[3], r[4], r[6].as_py(), r[5]))
                out.write(data)
                places.append((name, at, len(data)))
                at += len(data)
            file, offset, length = zip(*places) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names)
        if out is not None:
            out.close()

    names = [x.split()[0] for x in INDEX.split(", ")]
    index = rows.mapInArrow(write, INDEX)
    path = f"{folder}/index"
    index.write.mode("overwrite").parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def read_archives(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that ``index`` selects: id, url, kind, refers_to, digest, length[, payload]."""
    n = shuffle_partitions(index.sparkSession)
    entries = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    fields = ["id", "url", "kind", "refers_to", "digest", "length", *(["payload"] if payload else [])]
    types = {"length": pa.int64(), "payload": pa.binary()}

    def read(batches):
        ranges = None
        opened = None

        def spans():
            """(file, entries) with neighbours together."""
            now, held = None, []
            for b in batches:
                for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (file != now or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > SPAN):
                        yield now, held
                        held = []
                    now = file
                    held.append((offset, length))
            if held:
                yield now, held

        for file, held in spans():
            if file != opened:
                if ranges:
                    ranges.close()
                ranges, opened = _files.read_ranges(file), file
            first = held[0][0]
            data = ranges(first, sum(held[-1]) - first)
            rows = [parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], types.get(f, pa.string())) for f in fields], fields)
        if ranges:
            ranges.close()

    schema = T.StructType([T.StructField(f, {"length": T.LongType(), "payload": T.BinaryType()}.get(f, T.StringType())) for f in fields])
    return entries.mapInArrow(read, schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(pages, Scratch(spark, "warc_out").root), payload=False)
    number = pages.schema["page_id"].dataType
    return records.select(F.col("id").cast(number).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(number).alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), g AS (
  SELECT payload_digest, max(page_id) AS head FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
