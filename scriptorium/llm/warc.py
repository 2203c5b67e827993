"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames of about ``frame_bytes``
each, followed by a footer: a skippable frame that holds the seek table
(compressed and full size of each frame). The manifest maps each record to its
bundle, frame and offset within the frame, so that one record is read by
seeking to and decoding one frame. Bundles are written by the tasks to the
shared folder under names no other attempt uses; the manifest, a Parquet table
committed by Spark, names those that count, so a lost or repeated task leaves
only files that nothing refers to.

Of records with equal payloads of ``revisit_bytes`` or more, the one with the
largest id is the response, the others are revisits of it that hold no payload.

Defined cases: a null payload is empty; empty and short payloads are always
responses; a null id is never the largest, and where all ids of a payload are
null the records are all responses; rows that repeat the largest id with the
same payload are all responses; an empty table gives an empty result; columns
besides id, url and payload are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm._common import arrow_batches, join_spread, materialise, shared_dir, ship

#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MANIFEST = "bundle string, frame int, frame_start long, frame_size int, offset int, size int, record_id string"
RECORDS = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _open(folder: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    return store, path


def pack_record(page_id, url, payload: bytes, refers_to, digest: str | None = None) -> tuple[str, bytes]:
    """record id and bytes of a WARC/1.1 record."""
    digest = digest or hashlib.sha1(payload).hexdigest()
    record_id = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}"
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {datetime.fromtimestamp(0, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return record_id, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame at a bundle's end: (compressed, full) sizes of its frames."""
    table = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (count - k)) for k in range(count)]


class _Bundle:
    def __init__(self, folder: str, frame_bytes: int):
        self.store, self.root = _open(folder)
        self.store.create_dir(self.root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.press, self.frame_bytes = zstandard.ZstdCompressor(level=3), frame_bytes
        self.frames: list[tuple[int, int]] = []
        self.held: list[tuple[str, bytes]] = []
        self.full = self.start = 0

    def add(self, record_id: str, raw: bytes) -> list[dict]:
        self.held.append((record_id, raw))
        self.full += len(raw)
        return self.flush() if self.full >= self.frame_bytes else []

    def flush(self) -> list[dict]:
        if not self.held:
            return []
        data = self.press.compress(b"".join(r for _, r in self.held))
        rows, offset = [], 0
        for record_id, raw in self.held:
            rows.append({"bundle": self.name, "frame": len(self.frames), "frame_start": self.start, "frame_size": len(data), "offset": offset, "size": len(raw), "record_id": record_id})
            offset += len(raw)
        self.out.write(data)
        self.frames.append((len(data), self.full))
        self.start += len(data)
        self.held, self.full = [], 0
        return rows

    def close(self) -> list[dict]:
        rows = self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return rows


def with_revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), refers_to.

    Only (id, digest) rows of payloads that occur twice or more are joined by
    digest, and those of a digest that many rows share are dealt out; the payloads
    themselves are dealt by id and digest.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    small = base.where(F.octet_length("payload") >= revisit_bytes).select("page_id", "digest")
    kept = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    kept = materialise(kept, "copied-digests")
    total = kept.agg(F.sum("n")).first()[0] or 0
    revisits = (
        join_spread(small, kept, "digest", "n", total, ["page_id"])
        .where("page_id IS NULL OR page_id < refers_to")
        .groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.max("refers_to").alias("refers_to"))
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return base.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write(pages: DataFrame, frame_bytes: int = 1 << 20) -> tuple[DataFrame, str]:
    """Writes the archives; the manifest and the folder of the bundles."""
    spark = pages.sparkSession
    ship(spark)
    arrow_batches(spark)
    folder = shared_dir(spark, "warc")

    def store(batches):
        bundle = None
        for b in batches:
            bundle = bundle or _Bundle(folder, frame_bytes)
            rows = []
            for page_id, url, payload, digest, refers_to in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                rows += bundle.add(*pack_record(page_id, url, payload, refers_to, digest))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _arrow(MANIFEST))
        if bundle and (rows := bundle.close()):
            yield pa.RecordBatch.from_pylist(rows, _arrow(MANIFEST))

    return materialise(with_revisits(pages).mapInArrow(store, MANIFEST), "warc-manifest"), folder


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def read(manifest: DataFrame, folder: str, check: bool = True) -> DataFrame:
    """The records named by the manifest. Frames are read one at a time: a
    task gets whole frames, seeks to each and decodes it once. ``check``
    compares the digest and length of every payload with its header."""
    spark = manifest.sparkSession
    ship(spark)

    def load(batches):
        store, root = _open(folder)
        last, name, data, handle = None, None, b"", None
        for b in batches:
            rows = []
            for bundle, start, size, offset, length in zip(*(b[c].to_pylist() for c in ("bundle", "frame_start", "frame_size", "offset", "size")), strict=True):
                if bundle != name:
                    handle, name = store.open_input_file(f"{root}/{bundle}"), bundle
                if (bundle, start) != last:
                    handle.seek(start)
                    data, last = zstandard.ZstdDecompressor().decompress(handle.read(size)), (bundle, start)
                fields, payload = parse_record(data[offset : offset + length])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                response = fields["WARC-Type"] == "response"
                if check and response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                number = lambda k, f=fields: int(f[k]) if k in f else None
                rows.append({"record_id": fields["WARC-Record-ID"].strip("<>"), "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID")})
            yield pa.RecordBatch.from_pylist(rows, _arrow(RECORDS))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.repartition(parts, "bundle", "frame").sortWithinPartitions("bundle", "frame_start", "offset").mapInArrow(load, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    return read(*write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p
), m AS (
  SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.top IS NULL OR m.top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.top IS NULL OR m.top = d.page_id THEN NULL ELSE m.top END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
