"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC records, and a skippable frame with the
seek table (sizes of all frames) at its end, in the format that seekable readers know. The index is a
table: record identifier, bundle, frame and the record's offset within that frame; one frame is all that a
look-up reads and decompresses. Bundles are written by the tasks into a shared folder.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, shared_dir, stored, table

# fixed values of the seekable format
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1

FRAME, LEVEL, LEAST = 1 << 18, 3, 100
INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_size long, at long, size long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def _record(kind: str, rid: str, url: str, page: str, digest: str, size: int, block: bytes, more: list[str]) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Page-ID: {page}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", *more]
    return "\r\n".join([*head, "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c >= " ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[str, bytes]:
    """Identifier and bytes of a response record, or of a revisit record that leaves the payload out."""
    page = "" if page_id is None else str(page_id)
    rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {_clean(url)} {digest}')}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return rid, _record("response", rid, _clean(url), page, digest, len(payload), http + payload, [])
    more = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return rid, _record("revisit", rid, _clean(url), page, digest, len(payload), http, more)


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record at `at`."""
    split = data.index(b"\r\n\r\n", at)
    lines = data[at:split].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = split + 4 + int(head["Content-Length"])
    block = data[split + 4 : end]
    return head, block[block.index(b"\r\n\r\n") + 4 :], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(tail: bytes) -> list[tuple[int, int]]:
    """Compressed and full size of each frame, from the end of a bundle (any part that holds the whole table)."""
    n, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEK_MAGIC or flags & 0x7C:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    body = tail[len(tail) - 9 - n * step : len(tail) - 9]
    return [struct.unpack_from("<II", body, i * step) for i in range(n)]


def write(pages: DataFrame, folder: str | None = None, frame: int = FRAME, level: int = LEVEL, least: int = LEAST) -> DataFrame:
    """Writes the archives; returns their index (INDEX), stored beside them.

    Of pages with equal payloads of at least `least` bytes those with the smallest page_id are responses and the
    others revisit it, also those with a null page_id, which is never referred to: where all are null, all are
    responses. A null html is an empty payload; one longer than `frame` has a frame of its own; extra columns are
    ignored. A bundle's name holds its task's attempt, so attempts that fail leave a file that no index names.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # pages without equals need no partner, so the joined side is small
    firsts = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    firsts = stored(firsts)  # only then can the join's hot digests be split
    # only identifiers go through the join; the texts stay where they are dealt by page
    ids = rows.select("page_id", "digest").join(firsts, "digest").filter("not first <=> page_id and first is not null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    rows = rows.join(ids, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=level)
        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        file = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        out, frames, at = None, [], 0
        held: list[tuple] = []
        parts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, at, size
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{file}", compression=None)
            packed = press.compress(b"".join(parts))
            out.write(packed)
            index = [(*x[:2], f"{folder}/{file}", len(frames), at, len(packed), *x[2:]) for x in held]
            frames.append((len(packed), size))
            at, size = at + len(packed), 0
            held.clear()
            parts.clear()
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=INDEX.replace(",", "").split()[::2])

        for b in batches:
            for page, url, html, digest, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "digest", "first"))):
                rid, data = record(page.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), first.as_py())
                held.append((page.as_py(), rid, size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= frame:
                    yield flush()
        if parts:
            yield flush()
        if out is not None:
            out.write(seek_table(frames))
            out.close()

    return stored(bounded(rows).mapInArrow(run, INDEX))


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, checked against its digest (RECORDS).

    A task reads a whole bundle, frame by frame as the seek table says. A revisit has its response's size and
    digest from its own headers, and no payload.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        for b in batches:
            for path in b.column("bundle").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    f.seek(f.size() - 9)
                    n, flags, _ = struct.unpack("<IBI", f.read(9))
                    tail = 9 + n * (12 if flags & 0x80 else 8)
                    f.seek(f.size() - tail)
                    frames = read_seek_table(f.read(tail))
                    f.seek(0)
                    for packed, size in frames:
                        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size)
                        rows, i = [], 0
                        while i < len(data):
                            head, payload, i = parse(data, i)
                            kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                            if kind == "response":
                                if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["WARC-Payload-Length"]):
                                    raise ValueError(f"damaged record {head['WARC-Record-ID']} in {path}")
                            refers = head.get("WARC-Refers-To-Page-ID")
                            page = head["WARC-Page-ID"]
                            rows.append((int(page) if page else None, head["WARC-Target-URI"], int(head["WARC-Payload-Length"]), digest, kind, int(refers) if refers else None, payload.decode() if payloads and kind == "response" else None))
                        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORDS.replace(",", "").split()[::2])

    bundles = index.select("bundle").distinct()
    return bundles.mapInArrow(run, RECORDS)


def fetch(wanted: DataFrame) -> DataFrame:
    """The records that rows of the index name, each from its own frame only: (record_id, record_type, payload)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        for b in batches:
            for x in b.to_pylist():
                store, at = fs.FileSystem.from_uri(x["bundle"])
                with store.open_input_file(at) as f:
                    f.seek(x["frame_at"])
                    data = zstandard.ZstdDecompressor().decompress(f.read(x["frame_size"]))
                head, payload, _ = parse(data, x["at"])
                yield pa.RecordBatch.from_arrays([pa.array([x["record_id"]]), pa.array([head["WARC-Type"]]), pa.array([payload.decode()])], names=["record_id", "record_type", "payload"])

    return wanted.select("record_id", "bundle", "frame_at", "frame_size", "at").mapInArrow(run, "record_id string, record_type string, payload string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages")), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
