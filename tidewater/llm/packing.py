"""Best-fit-decreasing packing of tokenized documents into sequences of a fixed length.

Lengths are whole numbers up to the sequence length, so all that best fit needs to know is how many pieces
each length has: at most `capacity` counts, whatever the input. Pieces of one length are placed together: a
segment tree over the remaining capacities finds the tightest open bin in logarithmic time, and all bins with
that capacity take theirs in one step, exactly as one by one. Every piece then finds its place from its rank
among those of its length, which is counted per salted group; a length has the more salts, the more pieces it has.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, stored, table
from .words import slices

CAPACITY, END = 1024, 2
SALTED = 1 << 11  # pieces of a length that are ranked together, on average


class CapacityTree:
    """A segment tree over the capacities 0 to n: how many bins are open at each."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that a bin has."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first sequence, sequences, pieces in each, offset): where pieces go, by rank within their length."""
    tree = CapacityTree(capacity)
    bins: dict[int, deque[tuple[int, int]]] = {}  # capacity left: runs of sequences (first, how many)
    made, out = 0, []

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            bins.setdefault(left, deque()).append((first, n))
            tree.add(left, n)

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, first = capacity, made
                n = -(-todo // (capacity // length))
                made += n
            else:
                first, n = bins[left].popleft()
                tree.add(left, -n)
            each = left // length
            full = min(n, todo // each)
            if full:
                out.append((length, rank, first, full, each, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n and todo:
                out.append((length, rank, first + full, 1, todo, capacity - left))
                put(left - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            put(left, first + full, n - full)
    return out


def special_strings(vocabulary: str) -> list[str]:
    with open(vocabulary, "rb") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def encoder(vocabulary: str, ranks: str, pattern: str, special: list[str]):
    """Texts to lists of ids, as `tokenizers` gives them for `vocabulary`.

    The same vocabulary as ranks, read by tiktoken, gives equal ids six times as fast; the file for
    `tokenizers` decides for texts with one of its special strings, and for all where there are no ranks.
    Python workers keep what they have loaded for their next tasks.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})

    def slow(text: str) -> list[int]:
        if vocabulary not in kept:
            kept[vocabulary] = tokenizers.Tokenizer.from_file(vocabulary)
        return kept[vocabulary].encode(text, add_special_tokens=False).ids

    if not ranks:
        return slow
    if ranks not in kept:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[ranks] = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    plain = kept[ranks].encode_ordinary
    return lambda text: slow(text) if any(s in text for s in special) else plain(text)


def default_files() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids and an end id, longer ones cut; the first piece takes the remainder."""
    files = files or default_files()
    special = special_strings(files[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files, special)
        for b, texts in slices(batches, "t"):
            rows = []
            for doc, text in zip(b.column("doc_id"), texts):
                ids = np.array([*encode(text.decode()), END], "<u4")
                start, stop = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    rows.append((doc.as_py(), piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop = stop, stop + capacity
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return bounded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset.

    Ranks number the pieces of a length within salts of about SALTED pieces, by doc_id, piece, start and checksum, so
    that a length that most pieces share is dealt over as many groups as it needs. Only the counts by length and the places of
    plan() pass the driver; both are bounded by the capacity.
    """
    spark = cuts.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cuts.groupBy("length").agg(F.count("*")).collect()}
    # at most `capacity` rows
    salts = spark.createDataFrame([(k, -(-n // SALTED)) for k, n in counts.items()], "length long, salts long")
    cuts = cuts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))).drop("salts")
    by_salt = cut(cuts.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = F.sum("n").over(_over("length").orderBy("salt").rowsBetween(-(1 << 31), -1))
    offsets = by_salt.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cuts.withColumn("rank", F.row_number().over(_over("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    steps = plan(counts, capacity)
    by_length: dict[int, list] = {}
    for s in steps:
        by_length.setdefault(s[0], []).append(s[1:])
    places = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shipped = spark.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                p = shipped.value[int(n)]
                step = p[np.searchsorted(p[:, 0], rank[mine], "right") - 1]
                i = rank[mine] - step[:, 0]
                sequence[mine] = step[:, 1] + i // step[:, 3]
                offset[mine] = step[:, 4] + i % step[:, 3] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, out)


def _over(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece. Null and empty texts are one piece, the end id alone; repeated rows are packed each; a long text
    is encoded by itself; an empty table gives no rows; other columns are ignored."""
    return pack(stored(pieces(docs, capacity, files)), capacity)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
