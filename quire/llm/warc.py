"""Web archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. A bundle ends with a seek table in a
skippable frame (sizes of all frames, then a fixed footer), so plain decompressors read it whole
and seeking readers fetch single frames. An index maps each record to its bundle, frame and offset
in the frame. Records with equal payloads are stored once: the others revisit the first.

Bundles are written by the tasks straight to the shared store, under a temporary name first and
renamed when complete; names derive from partitions, so a task that runs again replaces its own.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, salted_lookup

FRAME_BYTES = 1 << 18  # of records, before compression
BUNDLE_BYTES = 1 << 23  # of frames, compressed
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time

# The seekable format and the record format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX = "record_id long, bundle string, frame int, frame_start long, frame_length long, offset int, length int"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in text or "\n" in text else text


def record_bytes(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record. A revisit has no payload; its length is kept in a header of its own."""
    if refers_to is None:
        block, kind = RESPONSE_HEAD % len(payload) + payload, "response"
    else:
        block, kind = b"", "revisit"
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {one_line(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None  # none for a revisit

    @property
    def record_id(self) -> str:
        return self.headers["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")

    @property
    def refers_to(self) -> str | None:
        found = self.headers.get("WARC-Refers-To")
        return found and found.removeprefix("<urn:page:").removesuffix(">")


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at `at` and where the next begins. Raises if it is damaged."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if first != VERSION:
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    begin = end + 4
    stop = begin + int(headers["Content-Length"])
    payload = None
    if headers["WARC-Type"] == "response":
        payload = data[data.index(b"\r\n\r\n", begin) + 4 : stop]
        if f"sha1:{payload_digest(payload)}" != headers["WARC-Payload-Digest"]:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return Record(headers, payload), stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """(compressed, decompressed) sizes of the frames as a skippable frame with footer."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """The frames' sizes, from the end of a bundle."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    table = tail[len(tail) - 9 - count * width : -9]
    return [struct.unpack_from("<II", table, i * width) for i in range(count)]


def frames_of(bundle: bytes) -> Iterator[bytes]:
    """The decompressed frames of a whole bundle, one at a time."""
    at, reader = 0, zstandard.ZstdDecompressor()
    for packed, plain in read_seek_table(bundle):
        yield reader.decompress(bundle[at : at + packed], max_output_size=plain)
        at += packed


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path there."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def read_record(folder: str, entry: dict) -> Record:
    """One record by its index entry: reads the one frame that holds it."""
    where, path = store(folder)
    with where.open_input_file(f"{path}/{entry['bundle']}") as source:
        packed = source.read_at(entry["frame_length"], entry["frame_start"])
    return parse_record(zstandard.ZstdDecompressor().decompressobj().decompress(packed), entry["offset"])[0]


class BundleWriter:
    """Bundles of one task; `add` and `close` return the index entries that became final."""

    def __init__(self, folder: str, stem: str):
        (self.where, self.path), self.stem = store(folder), stem
        self.number, self.sizes, self.at = -1, [], 0
        self.buffer, self.pending, self.entries = bytearray(), [], []
        self.out = None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, record_id: int, record: bytes) -> list[tuple]:
        self.pending.append((record_id, len(self.buffer), len(record)))
        self.buffer += record
        if len(self.buffer) >= FRAME_BYTES:
            self._frame()
        return self._finish() if self.at >= BUNDLE_BYTES else []

    def _frame(self) -> None:
        if not self.pending:
            return
        if self.out is None:
            self.number, self.sizes, self.at = self.number + 1, [], 0
            self.name = f"{self.stem}-{self.number:05d}.warc.zst"
            self.temporary = f"{self.path}/_{self.name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
            self.out = self.where.open_output_stream(self.temporary, compression=None)
        packed = self.packer.compress(bytes(self.buffer))
        self.out.write(packed)
        self.entries += [(i, self.name, len(self.sizes), self.at, len(packed), offset, length) for i, offset, length in self.pending]
        self.sizes.append((len(packed), len(self.buffer)))
        self.at += len(packed)
        self.buffer, self.pending = bytearray(), []

    def _finish(self) -> list[tuple]:
        if self.out is None:
            return []
        self.out.write(seek_table(self.sizes))
        self.out.close()
        self.where.move(self.temporary, f"{self.path}/{self.name}")
        self.out, self.at = None, 0
        done, self.entries = self.entries, []
        return done

    def close(self) -> list[tuple]:
        self._frame()
        return self._finish()


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """The index of the bundles that the returned plan writes to `folder` when it runs. `records`:
    record_id long, url string, payload binary, digest string, refers_to long (null: a response)."""
    where, path = store(folder)
    where.create_dir(path, recursive=True)
    names = INDEX.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, f"part-{TaskContext.get().partitionId():06d}")

        def batch(entries: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries), kinds)], names=names)

        for rows in batches:
            for at in range(rows.num_rows):
                row = {name: rows.column(name)[at].as_py() for name in ("record_id", "url", "payload", "digest", "refers_to")}
                to = None if row["refers_to"] is None else str(row["refers_to"])
                done = writer.add(row["record_id"], record_bytes(str(row["record_id"]), row["url"] or "", row["payload"], row["digest"], to))
                if done:
                    yield batch(done)
        done = writer.close()
        if done:
            yield batch(done)

    return records.select("record_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX)


def read_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the bundles in `folder`: record_id, record_type, url, payload (null for a
    revisit), payload_bytes, payload_digest, refers_to. Payloads are checked against digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for bundle in files["content"]:
                for frame in frames_of(bundle):
                    at, rows = 0, []
                    while at < len(frame):
                        record, at = parse_record(frame, at)
                        h, to = record.headers, record.refers_to
                        rows.append((int(record.record_id), h["WARC-Type"], h.get("WARC-Target-URI"), record.payload, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), None if to is None else int(to)))
                    columns = ["record_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
                    frame_rows = pd.DataFrame(rows, columns=columns)
                    frame_rows["refers_to"] = frame_rows["refers_to"].astype("Int64")
                    yield frame_rows

    return files.select("content").mapInPandas(
        read, "record_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    )


def archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write one record a row of `pages` into bundles in `folder` and return their stored index.

    A null page is an empty payload. Of equal payloads, empty ones too, the row with the largest
    key is the response; should several rows have that key, all of them are. A null key is taken
    as -1.
    """
    scratch = scratch or Scratch(pages.sparkSession, "warc-index")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(key), F.lit(-1)).cast("long").alias("record_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("_same"))
    groups = scratch.put(rows.groupBy("_same").agg(F.max("record_id").alias("_response"), F.count("*").alias("_n")).where("_n > 1").select("_same", "_response"), "groups")
    digested = salted_lookup(rows, groups, ["_same"], F.col("record_id"))
    # SHA-1 in base 32, five bits of the hexadecimal digits at a time
    records = digested.select(
        "record_id", "url", "payload", _base32(F.sha1("payload")).alias("digest"),
        F.when(F.col("_response") != F.col("record_id"), F.col("_response")).alias("refers_to"),
    )
    return scratch.put(write_bundles(records, folder), "index")


def _base32(hexadecimal):
    """Base 32 of 40 hexadecimal digits, in the JVM."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for five in range(0, 40, 10):
        # ten hexadecimal digits are forty bits, eight letters
        number = F.conv(F.substring(hexadecimal, five + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(letters), F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*parts)
