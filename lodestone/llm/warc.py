"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC
records, closed by the public seekable format's seek table in a skippable frame;
any Zstandard tool reads it. Bundles are named by their content and written by
Spark, a file each. The index, read off the files, maps a record to (bundle, path,
frame, offset in the frame), so ``read_record`` fetches a footer, a seek table and
one frame, and never the bundle.

Duplicates: of records with equal payloads the smallest id holds the payload and
the others are revisit records that name it.

Cases: null payloads are empty; a null id is larger than any other, and where a
group has null ids only, all of them are responses; rows that repeat the id of
the response are responses too; null urls are left out of the record; an empty
table gives no bundles; payloads of any length are whole, a record larger than a
frame's aim gets a frame of its own; ids of any type that has a text are read back
as that type; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._shared import RangeReader, read_files, staged, trimmed, write_files

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_END = struct.pack("<I", SEEKABLE)  # what every bundle ends in
BUNDLES = T.StructType([T.StructField("bundle", T.StringType()), T.StructField("data", T.BinaryType())])


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: str | None) -> str:
    return "<urn:none>" if key is None else f"<urn:record:{quote(key, safe='')}>"


def _key(urn: str) -> str | None:
    return unquote(urn.strip("<>").removeprefix("urn:record:")) if urn != "<urn:none>" else None


def record(kind: str, key: str | None, url: str | None, payload: bytes, sha: str, size: int, refers: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block and names its response."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(key)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.insert(4, "WARC-Target-URI: " + " ".join(url.split()))
    if kind == "revisit":
        lines.append(f"WARC-Refers-To: {_urn(refers)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    lines.append(f"Content-Length: {len(payload)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the place after the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    return headers, block, end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, plain) sizes and the seekable footer."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IB", len(sizes), 0) + _END
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(read, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, from the footer and the table alone.

    ``read(at, n)`` gives n bytes of a bundle of ``size`` bytes.
    """
    count, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    table, start, out = read(size - 9 - count * entry, count * entry), 0, []
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(read, place: tuple[int, int, int]) -> bytes:
    start, packed, plain = place
    return zs.ZstdDecompressor().decompress(read(start, packed), max_output_size=plain)


class BundleWriter:
    """Groups records into frames of about ``frame_bytes``."""

    def __init__(self, frame_bytes: int = 1 << 18, level: int = 3):
        self.aim, self.zip = frame_bytes, zs.ZstdCompressor(level=level, write_checksum=True)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.plain = self.done = self.records = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.plain and self.plain + len(data) > self.aim:
            self._cut()
        place = len(self.sizes), self.plain
        self.records += 1
        self.open.append(data)
        self.plain += len(data)
        return place

    def _cut(self) -> None:
        if self.open:
            packed = self.zip.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.plain))
            self.done += len(packed)
            self.open, self.plain = [], 0

    def close(self) -> bytes:
        self._cut()
        return b"".join(self.parts) + seek_table(self.sizes)


def with_roles(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """id, url, payload bytes, SHA-1 in hex and the response each row refers to (null: itself).

    Only digests that occur twice or more reach the join, from a written table, so
    that a digest with a third of all rows is split at run time; digests are the JVM's.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    made = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("sha1"))
    firsts = staged(made.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("_d"), "first"), "firsts")
    joined = made.join(firsts, F.col("sha1") == F.col("_d"), "left")
    refers = F.when(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first"))), F.col("first"))
    text = lambda c: c.cast("string")
    return joined.select(text(F.col("id")).alias("id"), text(F.col("url")).alias("url"), "payload", "sha1", text(refers).alias("refers_to"))


def write_archive(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", bundle_bytes: int = 8 << 20) -> None:
    """All pages as bundles, files below the new folder ``root``."""
    arrow = to_arrow_schema(BUNDLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def flush():
            data = writer.close()
            name = hashlib.sha256(data).hexdigest()[:32] + ".warc.zst"
            return pa.RecordBatch.from_pylist([{"bundle": name, "data": data.removesuffix(_END)}], schema=arrow)

        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                for r in batch.slice(part, 256).to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    sha = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    writer.add(record(kind, r["id"], r["url"], r["payload"], sha, len(r["payload"]), r["refers_to"]))
                    if writer.done >= bundle_bytes:
                        yield flush()
                        writer = BundleWriter()
        if writer.records:
            yield flush()

    # equal records make equal bundles of one name, so each gets the number of its task as well
    made = with_roles(pages, key, url, payload).mapInArrow(trimmed(run), BUNDLES)
    numbered = made.select(F.concat(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"), F.lit("-"), "bundle").alias("bundle"), "data")
    write_files(numbered, root, "bundle", "data", _END)


READ = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("bundle", T.StringType()), T.StructField("path", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType()),
])


def _told(headers: dict[str, str], block: bytes) -> dict:
    """A record's fields, checked against its digest."""
    kind, sha, size = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if kind == "response" and (digest(block) != sha or len(block) != size):
        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
    refers = _key(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return {"id": _key(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": sha, "record_type": kind, "refers_to": refers, "url": headers.get("WARC-Target-URI"), "payload": block}


def read_archive(spark: SparkSession, root: str, key: T.DataType = T.LongType(), payloads: bool = True) -> DataFrame:
    """Every record of the bundles below ``root``, frame by frame, with its place."""
    arrow = to_arrow_schema(READ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, path, data = (c[i].as_py() for c in batch.columns)
                read = lambda at, n: data[at : at + n]  # noqa: E731, B023
                for number, place in enumerate(frames(read, len(data))):
                    plain, at, out = read_frame(read, place), 0, []
                    while at < len(plain):
                        headers, block, end = parse(plain, at)
                        out.append(_told(headers, block) | {"bundle": name, "path": path, "frame": number, "offset": at} | ({} if payloads else {"payload": None}))
                        at = end
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = read_files(spark, root, "bundle").mapInArrow(trimmed(run), READ)
    return found.withColumns({c: F.col(c).cast(key) for c in ("id", "refers_to")})


def index(spark: SparkSession, root: str, key: T.DataType = T.LongType()) -> DataFrame:
    """(id, bundle, path, frame, offset) of every record below ``root``, as a written table."""
    return staged(read_archive(spark, root, key, payloads=False).select("id", "bundle", "path", "frame", "offset"), "index")


def read_record(spark: SparkSession, indexed: DataFrame, key) -> list[dict]:
    """The records of one id: of their bundles, the footer, the table and one frame each are read."""
    out = []
    for place in indexed.where(F.col("id").eqNullSafe(F.lit(key))).collect():  # one row, but for repeated ids
        read = RangeReader(spark, place["path"])
        plain = read_frame(read, frames(read, read.size)[place["frame"]])
        headers, block, _ = parse(plain, place["offset"])
        out.append(_told(headers, block) | {"bytes_read": read.asked})
    return out
