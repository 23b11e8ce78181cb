"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle is a file of frames, a skippable frame with the
bundle's own index, and last the seek table that the public seekable format puts into a skippable frame, so any
Zstandard tool reads the whole file. The index maps a record identifier to (frame, offset inside the frame's content,
length): reading one record inflates one frame. index_of() gathers the indexes of many bundles into a table sorted by
page_id, so that a lookup reads only the bundles that hold a wanted page.

Spark's text writer writes the bundles, one file for each row: a row is a bundle without its last four bytes, and these,
the seekable format's closing magic number, are the line separator. So any store that Spark writes to will do, and failed tasks
leave nothing behind. A bundle is never larger than about bundle_bytes plus one record.

A record's identifier is made of page_id and payload digest. In a target URI, control characters, spaces and "<>" are
percent-encoded, as URIs want; all else stays.

Edge cases: null html is an empty payload; a null page_id is always a response; a null url is an empty target; rows that
repeat the smallest page_id of a payload are all responses; rows equal in page_id and payload share an
identifier, and a lookup returns each; a page larger than a frame is a frame of its own; an empty table gives no rows and no
bundle; other columns, also ones whose names differ from page_id, url or html in case only, play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, arrow_schema, held_by, id_filter, map_rows, new_path, pick, small_batches, spread_join, utf8, written

MIN_REVISIT_BYTES = 100
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: The skippable frame of a bundle's own index.
INDEX_MAGIC = 0x184D2A50
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]+", lambda m: quote(m[0], safe=""), url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Target-URI: {_target(url)}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Profile: {_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(warc["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class BundleWriter:
    """Collects records into frames, frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.sizes, self.open, self.index = frame_bytes, [], [], bytearray(), []
        self.packer = zstandard.ZstdCompressor(level=3)

    def add(self, identifier: str, data: bytes) -> None:
        if self.open and len(self.open) + len(data) > self.frame_bytes:
            self._close_frame()
        self.index.append((identifier, len(self.frames), len(self.open), len(data)))
        self.open += data

    def _close_frame(self) -> None:
        packed = self.packer.compress(bytes(self.open))
        self.frames.append(packed)
        self.sizes.append((len(packed), len(self.open)))
        self.open = bytearray()

    @property
    def packed_bytes(self) -> int:
        return sum(a for a, _ in self.sizes) + len(self.open)

    def finish(self) -> bytes:
        if self.open:
            self._close_frame()
        index = self.packer.compress("\n".join(f"{i} {f} {o} {n}" for i, f, o, n in self.index).encode())
        table = b"".join(struct.pack("<II", a, b) for a, b in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", INDEX_MAGIC, len(index)) + index + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class BundleReader:
    """Random access to the frames of a bundle through its footer."""

    def __init__(self, content: bytes):
        n, descriptor, magic = struct.unpack("<IBI", content[-9:])
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        step = 12 if descriptor & 0x80 else 8
        table = content[len(content) - 9 - n * step : len(content) - 9]
        self.content, self.at, at = content, [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", table, i * step)
            self.at.append((at, packed, plain))
            at += packed
        self.index_at = at
        self.kept: tuple[int, bytes] = (-1, b"")
        self.unpacker = zstandard.ZstdDecompressor()

    def index(self) -> list[tuple[str, int, int, int]]:
        """(identifier, frame, offset, length) of all records, in their order."""
        magic, size = struct.unpack_from("<II", self.content, self.index_at)
        if magic != INDEX_MAGIC:
            raise ValueError("no index")
        packed = self.content[self.index_at + 8 : self.index_at + 8 + size]
        lines = self.unpacker.stream_reader(packed).read().decode().split("\n")
        return [(i, int(f), int(o), int(n)) for i, f, o, n in (x.rsplit(" ", 3) for x in lines)]

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            at, packed, plain = self.at[k]
            self.kept = (k, self.unpacker.decompress(self.content[at : at + packed], max_output_size=max(1, plain)))
        return self.kept[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to). Payload groups are counted before the shuffle. Revisits are few: pages outside a filter of their ids do not move."""
    pages = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha2("html", 256))
    seen = pages.select("page_id", "digest", F.octet_length("html").alias("size")).where(F.col("size") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    seen = written(seen.where("page_id is not null"), "payloads")
    groups = written(seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("top"), F.count("*").alias("n")).where("refers_to < top").drop("top"), "payloadgroups")
    revisits = written(spread_join(seen, groups, "digest", "n", "page_id").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    sent = id_filter(revisits.select("page_id"))
    hit = F.col("page_id").isNotNull() if sent is None else held_by(sent)("page_id")
    names = ["page_id", "url", "html", "digest", "refers_to"]
    alone = pages.where(~hit).withColumn("refers_to", F.lit(None).cast("long"))
    return pages.where(hit).join(revisits, ["page_id", "digest"], "left").select(*names).union(alone.select(*names))


def bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(content): marked pages packed into bundles, as many for each partition as it needs."""
    schema = arrow_schema("content binary")
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda w: pa.RecordBatch.from_arrays([pa.array([w.finish()], pa.binary())], schema=schema)
        out = BundleWriter(frame_bytes)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                for page_id, url, html, digest, refers_to in zip(*[c.to_pylist() for c in batch.slice(lo, SLICE_ROWS).columns], strict=True):
                    out.add(record_id(page_id, digest), record(page_id, url, utf8(html), digest, refers_to))
                    if out.packed_bytes >= bundle_bytes:
                        yield row(out)
                        out = BundleWriter(frame_bytes)
        if out.index:
            yield row(out)

    return records.mapInArrow(run, "content binary")


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Archive pages as bundle files in a folder."""
    magic = struct.pack("<I", SEEKABLE_MAGIC)
    rows = bundles(marked(pages), frame_bytes, bundle_bytes).select(F.expr(f"cast(substring(content, 1, length(content) - {len(magic)}) as string)").alias("value"))
    # the writer puts the line separator's bytes behind each row's
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", magic.decode("latin-1")).option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the bundles in a folder."""
    return spark.read.format("binaryFile").load(folder).where("length > 0").select(F.col("path").alias("file"), "content")


def _number(identifier: str) -> int | None:
    digits = identifier.removeprefix("<urn:x-page:").partition(":")[0]
    return int(digits) if digits else None


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of (file, content), found through index and seek table; a response's digest is recomputed and compared."""

    def start():
        def row(content: bytes) -> Iterator[tuple]:
            reader = BundleReader(content)
            for want, *place in reader.index():
                warc, http, payload = parse(reader.record(*place))
                if warc["WARC-Record-ID"] != want:
                    raise ValueError(f"index names {want}, archive has {warc['WARC-Record-ID']}")
                digest, size = warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                if warc["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {warc['WARC-Record-ID']} is damaged")
                refers = warc.get("WARC-Refers-To")
                yield _number(want), size, digest, warc["WARC-Type"], None if refers is None else _number(refers)

        return row

    return map_rows(archives.select("content"), start, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to bundle files in the shared folder and read the archives back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_bundles(pages, folder)
    return read_back(stored(spark, folder))


def index_of(archives: DataFrame) -> DataFrame:
    """(page_id, file, frame, offset, length) of all records, sorted by page_id and stored in the shared folder. No frame is inflated."""

    def start():
        def row(file: str, content: bytes) -> Iterator[tuple]:
            for identifier, *place in BundleReader(content).index():
                yield _number(identifier), file, *place

        return row

    found = map_rows(archives.select("file", "content"), start, "page_id long, file string, frame long, offset long, length long")
    return written(found.repartitionByRange("page_id", "file", "frame").sortWithinPartitions("page_id"), "warcindex")


def lookup(index: DataFrame, page_ids: list[int]) -> DataFrame:
    """(page_id, payload) of the records of the named pages: only bundles that hold one are read, and one frame is inflated for each hit."""
    spark, places = index.sparkSession, {}
    for r in index.where(F.col("page_id").isin(page_ids)).collect():
        places.setdefault(r.file, []).append((r.frame, r.offset, r.length))
    if not places:
        return spark.createDataFrame([], "page_id long, payload binary")
    sent = spark.sparkContext.broadcast(places)

    def start():
        def row(file: str, content: bytes) -> Iterator[tuple]:
            reader = BundleReader(content)
            for place in sorted(sent.value[file]):
                warc, _, payload = parse(reader.record(*place))
                yield _number(warc["WARC-Record-ID"]), payload

        return row

    return map_rows(spark.read.format("binaryFile").load(sorted(places)).select(F.col("path").alias("file"), "content"), start, "page_id long, payload binary")
