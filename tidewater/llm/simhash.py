"""SimHash near-duplicates: fingerprints, links within 3 bits, components.

Linking embeds a fingerprint as the bit counts of its 32 two-bit segments. The Manhattan distance of two
such points never exceeds the Hamming distance, so links lie in the Manhattan ball of radius 3. The range
join finds them on a grid: the segments form 6 blocks, a distance of at most 3 leaves some 3 blocks
unmoved, so the points share the grid cell of one of the 20 block triples. Of the pairs in a cell those within
Manhattan distance 3 go on, each in the first of the triples that it shares, and are verified exactly by xor and bit count.

Counts are written in unary (0: 00, 1: 01, 2: 11), so that the distance of two points is the number of bits in which they differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, connected_components, cut, fresh, stored, table
from .words import slices

BITS, SEGMENTS, BLOCKS = 3, 32, 6
TILE = 512  # members of a cell that are compared at once; larger cells are split into pairs of tiles


def fingerprint(text: bytes, n: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over the n-word shingles of the text in lower case (A-Z only); none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < n:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts.tolist(), ends[n - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp): fp is the signed 64-bit fingerprint of the whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "t"):
            fp = np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return bounded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))).mapInArrow(run, "id long, fp long")


def _masks() -> tuple[list[int], list[int]]:
    """Bits of each block, and of each block triple."""
    edges = [round(i * SEGMENTS / BLOCKS) for i in range(BLOCKS + 1)]
    block = [((1 << 2 * edges[i + 1]) - 1) ^ ((1 << 2 * edges[i]) - 1) for i in range(BLOCKS)]
    return block, [sum(block[i] for i in t) for t in combinations(range(BLOCKS), BLOCKS - BITS)]


def embed(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, in unary."""
    low, high = fp & np.uint64(0x5555555555555555), (fp >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return ((high & low) << np.uint64(1)) | high | low


def _cells(points: DataFrame) -> DataFrame:
    """(node, fp, triple, cell) for each of the 20 block triples."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low = F.col("fp").bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(0x5555555555555555))
    counts = F.shiftleft(high.bitwiseAND(low), 1).bitwiseOR(high).bitwiseOR(low)
    cells = F.array(*[F.struct(F.lit(i).alias("triple"), counts.bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(_masks()[1])])
    return points.select("node", "fp", F.explode(cells).alias("c")).select("node", "fp", "c.triple", "c.cell")


def _links(sorted_cells: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that join what a cell's or tile pair's members join; at most one per member where they are many."""
    block, triples = _masks()
    owner = np.full(1 << BLOCKS, -1, np.int64)  # by the set of blocks that a pair shares: its first triple
    for i, t in reversed(list(enumerate(combinations(range(BLOCKS), BLOCKS - BITS)))):
        for shared in range(1 << BLOCKS):
            if all(shared >> x & 1 for x in t):
                owner[shared] = i

    def small(triple, node, fp, point, start, size) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for lag in range(1, int(size.max(initial=1))):
            s = start[size > lag]
            n = size[size > lag] - lag
            i = np.repeat(s - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            apart = point[i] ^ point[i + lag]
            i, apart = (x[np.bitwise_count(apart) <= bits] for x in (i, apart))
            shared = sum(((apart & np.uint64(m)) == 0).astype(np.int64) << x for x, m in enumerate(block))
            i = i[owner[shared] == triple[i]]
            near = np.bitwise_count(fp[i] ^ fp[i + lag]) <= bits
            yield node[i[near]], node[i[near] + lag]

    def large(node, fp, point) -> tuple[np.ndarray, np.ndarray]:
        near = np.bitwise_count(point[:, None] ^ point[None, :]) <= bits
        a, b = np.nonzero(near)
        near[a, b] = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        label = np.arange(len(fp))
        while True:
            new = np.where(near, label[None, :], len(fp)).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(fp))
        return node[moved], node[label[moved]]

    def groups(keys, node, fp) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        size = np.diff(np.append(start, len(node)))
        few, point = size <= 24, embed(fp)
        found = list(small(keys[:, 0], node, fp, point, start[few], size[few]))
        found += [large(node[s : s + n], fp[s : s + n], point[s : s + n]) for s, n in zip(start[~few], size[~few])]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last group of a batch may go on in the next
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in ("triple", "cell", "tile", "node", "fp")], 1)
            x = x if kept is None else np.concatenate([kept, x])
            if not len(x):
                continue
            last = int(np.flatnonzero((x[:, :3] != x[-1, :3]).any(1)).max(initial=-1)) + 1
            kept, x = x[last:], x[:last]
            if len(x):
                yield from groups(x[:, :3], x[:, 3], x[:, 4].copy().view(np.uint64))
        if kept is not None and len(kept):
            yield from groups(kept[:, :3], kept[:, 3], kept[:, 4].copy().view(np.uint64))

    return sorted_cells.mapInArrow(run, "a long, b long")


def near_components(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, fp, component) for rows (id, fp): fingerprints within `bits` (at most 3) differing bits link.

    Equal fingerprints form one class, which enters the join once. Cells of more than TILE classes are
    split into pairs of tiles, and every comparison returns links that span what it connects, never all
    pairs. Rows with a null id take part only through their class; its component is null if it has no id.
    """
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("node")))
    points = _cells(classes.filter("node is not null"))
    many = stored(points.groupBy("triple", "cell").agg(F.count("*").alias("n")).filter("n > 1"))
    tiles = F.ceil(F.col("n") / TILE).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("g"))
    other = F.when(F.col("g") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda i: i != F.col("mine"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = (
        points.join(many, ["triple", "cell"]).withColumn("g", tiles).withColumn("mine", mine)
        .withColumn("other", F.explode(other))
        .select(F.col("triple").cast("long").alias("triple"), "cell", (F.least("mine", "other") * F.col("g") + F.greatest("mine", "other")).alias("tile"), "node", "fp")
    )
    keys = ["triple", "cell", "tile"]
    links = _links(dealt.repartition(*keys).sortWithinPartitions(*keys), bits)
    groups = connected_components(links)
    named = classes.join(groups, classes.node == groups.node, "left").select("fp", F.coalesce("component", classes.node).alias("component"))
    return fps.join(named, "fp").select("id", "fp", "component")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other; repeated rows share their class; a long text is
    read by itself; an empty table gives no rows; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col))
    return near_components(fps).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, of each component only the one with the smallest doc_id; rows without an id stay."""
    (name,) = fresh(docs.columns, "__gone")
    found = simhash_components(docs.filter("doc_id is not null"))
    gone = cut(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
