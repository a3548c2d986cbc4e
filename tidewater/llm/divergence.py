"""Divergence of a language's sources, from the shares of its terms, by dense matrices of term blocks.

Terms are counted by group (language and source), the counts of a language's kept terms are dealt into blocks of a few
hundred terms, and each block becomes a numpy tile of groups by terms in int64. Broadcasting a tile against itself
gives its share of the divergence of all pairs of groups; the blocks' matrices are summed. A tile also gives each
group's strongest terms, kept in a heap a group, and the heaps of all tiles are merged.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, stored, table
from .words import slices

LEAST_DOCS, TOP = 10, 10
TERMS, GROUPS = 512, 256  # of a tile: more groups are split into pairs of group blocks
ENTRIES = 200_000  # counted terms that a task holds before it passes them on
PIECE = 1 << 20  # bytes of a text that are split into terms at a time
CELLS = 1 << 21  # int64 cells of a broadcast
SCALE = 1_000_000_000

#: Bytes of terms as they are but A-Z lower-cased; all others are blanks. Bytes from 0x80 on only occur in characters from U+0080 on.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, from about PIECE bytes at a time, cut between terms."""
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by group, summed over what a task reads."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for i in range(0, len(terms), 1 << 15):
                some = terms[i : i + (1 << 15)]
                cols = [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).view(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
        counts.clear()

    held = 0
    for piece, texts in slices(batches, "text"):
        for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), texts):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for terms in pieces(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
            held += len(n) - before
        if held >= ENTRIES:
            yield from flush()
            held = 0
    yield from flush()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) in int64, for count <= total below 2**53: three digits at a time, as the product may not fit."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of apart() of every row of p and every row of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for i in range(0, len(p), step):
        out[i : i + step] = apart(p[i : i + step, None, :], q[None, :, :]).sum(2)
    return out


def best(value: np.ndarray, terms: list[str], top: int) -> list[tuple[int, bytes, str]]:
    """The top terms as (-value, UTF-8, term); ties go to the term whose UTF-8 is first."""
    least = -np.partition(-value, top - 1)[top - 1] if len(value) > top else -1
    return heapq.nsmallest(top, [(-int(value[j]), terms[j].encode("utf-8", "surrogatepass"), terms[j]) for j in np.flatnonzero(value >= least)])


NAMES = ["lang", "source", "part", "item", "value"]


def _tiles(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by language, pair of group blocks and term block, each block's groups before its terms."""
        sums = heaps = frame = None  # of a language's pair of group blocks

        def flush() -> Iterator[pa.RecordBatch]:
            if frame is None:
                return
            lang, a, b, left, right = frame
            rows = [(s, "pair", t, int(v)) for i, s in enumerate(left) for t, v in zip(right, sums[i]) if a != b or s != t]
            if a != b:
                rows += [(t, "pair", s, v) for s, _, t, v in rows]
            rows += [(left[i], "term", t, -v) for i, h in heaps.items() for v, _, t in h]
            for i in range(0, len(rows), 1 << 15):
                s, part, item, value = zip(*rows[i : i + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s)), pa.array(s), pa.array(part), pa.array(item), pa.array(value, pa.int64())], names=NAMES)

        def tile(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal sums, heaps, frame
            t = pa.Table.from_batches(rows)
            lang, a, b = t["lang"][0].as_py(), t["a"][0].as_py(), t["b"][0].as_py()
            at, n, terms = t["at"].to_numpy(), t["n"].to_numpy(), t["term"].to_pylist()
            heads = t["term"].null_count  # the groups come first
            order = np.argsort(at[:heads], kind="stable")
            groups, total, v = at[:heads][order], n[:heads][order], t["lang_n"][0].as_py()
            names, block = t["source"].slice(0, heads).to_pylist(), t["block"].to_numpy()
            left, right = ([names[i] for i in order if block[i] == x] for x in (a, b))
            if frame is None or frame[:3] != (lang, a, b):
                yield from flush()
                frame, sums, heaps = (lang, a, b, left, right), np.zeros((len(left), len(right)), np.int64), {}
            place: dict[str, int] = {}
            column = np.array([place.setdefault(x, len(place)) for x in terms[heads:]], np.int64)
            if not place:
                return
            count = np.zeros((heads, len(place)), np.int64)
            row = np.searchsorted(groups, at[heads:])
            count[row, column] = n[heads:]
            p = shares(count + 2, (total + 2 * v)[:, None])
            sums += pair_sums(p[: len(left)], p[-len(right) :])
            if a == b:
                whole = np.zeros(len(place), np.int64)
                whole[column] = t["lang_n"].to_numpy()[heads:]
                q = shares(whole + 2, np.array([t["lang_total"][0].as_py() + 2 * v]))
                f, listed = apart(p, q[None, :]), list(place)
                for i in range(heads):
                    more = np.flatnonzero((count[i] > 0) & (p[i] > q))
                    found = best(f[i, more], [listed[j] for j in more], top)
                    heaps[i] = heapq.nsmallest(top, heaps.get(i, []) + found)

        now, held = None, []
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("lang", "a", "b", "tb")]))
            for key, run_of in groupby(range(len(keys)), keys.__getitem__):
                some = list(run_of)
                if key != now and held:
                    yield from tile(held)
                    held = []
                now = key
                held.append(batch.slice(some[0], len(some)))
        if held:
            yield from tile(held)
        yield from flush()

    return run


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from every other one (part `pair`), and its
    `top` terms that it has more of than its language (part `term`).

    Null texts, languages and sources are ''. A language without kept terms has pairs of value 0; a language's only source has
    no pairs. Repeated rows count each. Ties go to the item whose UTF-8 is first. Long texts are split piece by piece, between
    terms. An empty table gives no rows. Other columns play no part, whatever their names.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = bounded(plain).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")  # a row a source at most
    kept = counted.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("d"))
    kept = stored(kept.filter(F.col("d") >= least_docs).drop("d"))

    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = plain.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)  # the result has a row for every pair of them
    groups = stored(groups.withColumns({"block": F.floor(F.col("at") / GROUPS), "blocks": F.floor((F.count("*").over(W.partitionBy("lang")) - 1) / GROUPS), "tbs": F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS))}))

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("other")
    shape = ["lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "tb", "at", "block", "source", "term", "n", "lang_n", "lang_total"]
    heads = groups.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tbs") - 1))).select("*", other)
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "n": F.col("total"), "lang_n": F.col("v")}).select(*shape)
    cells = kept.join(groups.drop("total", "v"), ["lang", "source"]).withColumn("tb", F.pmod(F.xxhash64("term"), "tbs")).select("*", other).select(*shape)
    dealt = heads.unionByName(cells).repartition("lang", "a", "b", "tb").sortWithinPartitions("lang", "a", "b", "tb", F.col("term").isNotNull(), "at", "term")
    found = bounded(dealt).mapInArrow(_tiles(top), "lang string, source string, part string, item string, value long")
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
