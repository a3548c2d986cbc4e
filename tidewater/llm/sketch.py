"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every 5-word shingle hash below a fixed fraction of the hash range. A text with fewer than FLOOR hashes
below it has a higher threshold of its own, that of its FLOOR smallest hashes, so that short texts don't end with nothing. Sketches merge by union and compare by the hashes below
the lower of both thresholds, whatever the texts' lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, parts, stored, table
from .words import Words, slices

SHINGLE, FRACTION, FLOOR = 5, 1 / 16, 32


def _limit(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2**64), 2**64 - 1))


def sketches(texts: list[bytes], n: int = SHINGLE, fraction: float = FRACTION, floor: int = FLOOR) -> list[np.ndarray]:
    """Ascending 64-bit hashes per text; a text of fewer words has one shingle, a text without words none."""
    w = Words(texts)
    size = np.diff(w.first)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    ends = np.cumsum(count)
    start = np.repeat(w.first[:-1] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
    stop = np.minimum(start + n, np.repeat(w.first[1:], count))
    h = w.span(start, stop)
    limit = _limit(fraction)
    out = []
    for a, b in zip((ends - count).tolist(), ends.tolist()):
        u = np.unique(h[a:b])
        out.append(u[: max(floor, int(np.searchsorted(u, limit)))])
    return out


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    u = np.unique(np.concatenate([a, b]))
    top = min(threshold(a, fraction, floor), threshold(b, fraction, floor))
    return _below(u, top)[: max(floor, int(np.searchsorted(u, _limit(fraction))))]


def threshold(a: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> int:
    """All of the text's hashes below this are in the sketch."""
    return max(int(_limit(fraction)), int(a[-1]) + 1) if len(a) >= floor else 2**64


def _below(a: np.ndarray, top: int) -> np.ndarray:
    return a if top >= 2**64 else a[: np.searchsorted(a, np.uint64(top))]


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> float:
    """Estimate of the Jaccard likeness of the shingles, 0 to 1; 1 for two empty sketches."""
    top = min(threshold(a, fraction, floor), threshold(b, fraction, floor))
    a, b = _below(a, top), _below(b, top)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION, floor: int = FLOOR) -> float:
    """Estimate of the share of a's shingles that b has too; 1 if a is empty."""
    top = min(threshold(a, fraction, floor), threshold(b, fraction, floor))
    a, b = _below(a, top), _below(b, top)
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def encode(a: np.ndarray) -> str:
    """16 hex digits a hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def document_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text. Null and empty texts have the empty fingerprint; equal texts equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([encode(x) for x in sketches(texts)], pa.string())], names=["id", "fingerprint"])

    return bounded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """The rows of _OUT for texts and the text that follows each."""
    edited = [_edited(a, b) for a, b in zip(texts, following)]
    n = len(texts)
    every = sketches([t.encode() for t in texts + edited + following[-1:]])
    own, new, after = every[:n], every[n : 2 * n], every[1:n] + every[2 * n :]
    cols = [
        pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(map(encode, own), pa.string()), pa.array(map(encode, new), pa.string()),
        pa.array(map(likeness, own, new), pa.float64()), pa.array(map(likeness, own, after), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the start of the next document.

    The next document follows in descending doc_id, ties by a hash of the text; after the last comes the first. One range
    shuffle puts neighbours side by side; only the two ends of each partition go through a second, small step.
    Null texts count as empty, a null id as the smallest; a single row is its own next document; an empty
    table gives no rows; other columns are ignored.
    """
    n_parts = n_parts or parts(docs.sparkSession)
    order = [F.col("id").desc(), F.col("tie")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[tuple] = []  # rows whose next one hasn't come yet, in order; the last stays

        def end(kind: str, doc: int | None, text: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *empty, pa.array([part], pa.int32()), pa.array([kind]), pa.array([text])], names=names)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "part", "kind", "text"]
        first = True
        for b, texts in slices(batches, "t"):
            new = list(zip(b.column("id").to_pylist(), (t.decode() for t in texts)))
            if not new:
                continue
            if first:
                yield end("first", *new[0])
                first = False
            held += new
            if len(held) > 1:
                out = _compare([x[0] for x in held[:-1]], [x[1] for x in held[:-1]], [x[1] for x in held[1:]])
                n = out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
                held = held[-1:]
        if held:
            yield end("last", *held[0])

    found = stored(bounded(rows).mapInArrow(run, f"{_OUT}, part int, kind string, text string"))
    ends = found.filter("kind is not null").select("doc_id", "part", "kind", "text")
    starts = ends.filter("kind = 'first'").select(F.col("part").alias("p"), F.col("text").alias("following"))
    # a row for each partition: the next one that has rows, after the last one the first
    order_of = ends.select("part").distinct().groupBy().agg(F.sort_array(F.collect_list("part")).alias("all"))
    nexts = order_of.select(F.posexplode("all").alias("i", "q"), "all").select("q", F.element_at("all", (F.col("i") + 1) % F.size("all") + 1).alias("p"))
    pairs = ends.filter("kind = 'last'").join(nexts, F.col("part") == F.col("q")).join(starts, "p")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                yield _compare([doc], [text], [following])

    return found.filter("kind is null").drop("part", "kind", "text").union(pairs.select("doc_id", "text", "following").mapInArrow(finish, _OUT))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(table(spark, sf_dir, "documents"))
