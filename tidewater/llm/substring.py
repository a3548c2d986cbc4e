"""Substring dedup: words covered by 50-word windows that an earlier document has too.

Prefix-partitioned suffix trees over words, in four steps:

* Partition. A window is filed under the smallest hash of the k-word runs in it, so equal windows share a group whatever
  their documents. Neighbouring windows of a document with the same group form an edge. k is the length of the group's
  prefix and varies: it starts at 16 words, and a group with more than LIMIT words is split by a longer prefix, up to
  the whole window, until each fits in memory. Groups that one document alone has are dropped.
* Edges of the groups left bring their words. Equal ones, by their words, become one leaf with its smallest document.
* Each group's leaves become a suffix array: ranks of suffixes by their first 2, 4, 8 ... words, from the words themselves.
  Runs of suffixes that agree in 50 words are the deep internal nodes; a node's smallest document keeps the words.
* Documents lose the windows of nodes that have a smaller document.

Hashes only decide what is compared with what. That two windows are equal is always decided by their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, drop, fresh, row_key, stored, table
from .words import U, Words, mix, slices

WINDOW, PREFIX, STEPS = 50, 16, 4
LIMIT = 1 << 17  # words of a group whose suffixes are sorted at once
KEY = "id long, k1 long, k2 long"


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each n neighbours, in log n steps."""
    have = 1
    while 2 * have <= n:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def prefix_lengths(window: int, prefix: int) -> list[int]:
    """The lengths that a group's prefix can have, from the shortest to the whole window."""
    return sorted({prefix + round(i * (window - prefix) / STEPS) for i in range(STEPS + 1)})


class Edges:
    """Edges of several texts: number of the text, first window, number of windows, group and label as hashes.

    `open` are the windows that take part. Where the prefix is the whole window, an edge's windows are all equal, so
    its label and its slice are those of one window.
    """

    def __init__(self, w: Words, window: int, k: int, open: np.ndarray):
        self.whole = k == window
        i = np.arange(len(w.hash) - k + 1)
        low = _slide(w.span(i, i + k), window - k + 1, np.minimum)
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (w.text[1 : len(low)] != w.text[: len(low) - 1])])
        at = np.flatnonzero(open & (new | np.concatenate([[True], ~open[:-1]])))
        before = np.concatenate([[0], np.cumsum(open)])
        self.start, self.count = at, before[np.append(at[1:], len(low))[: len(at)]] - before[at]
        self.text = w.text[at]
        self.group = mix(low[at] + U(k))
        self.words = np.where(self.whole, window, self.count + window - 1)
        self.label = mix(w.span(at, at + self.words) ^ self.group)


def _places(text: np.ndarray, label: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with text[i] == owner[j] and label[i] == labels[j]."""
    known, rank = np.unique(np.concatenate([label, labels]), return_inverse=True)
    a, b = text * len(known) + rank[: len(label)], owner * len(known) + rank[len(label) :]
    order = np.argsort(b, kind="stable")
    left, right = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    i = np.repeat(np.arange(len(a)), right - left)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(right - left) - (right - left), right - left) + left[i]]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of the row and value of each element of a list column; null: none."""
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pc.list_flatten(column)


def _hashes(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64).view(U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def edges_of(w: Words, window: int, prefix: int, opened: tuple[np.ndarray, np.ndarray]) -> Iterator[Edges]:
    """Edges by the shortest prefix, then those of longer prefixes within the edges whose (text, label) is opened."""
    n = len(w.hash)
    if n < window:
        return
    open = w.text[: n - window + 1] == w.text[window - 1 :]
    for k in prefix_lengths(window, prefix):
        if not open.any():
            return
        e = Edges(w, window, k, open)
        yield e
        i = np.unique(_places(e.text, e.label, *opened)[0])
        change = np.zeros(len(open) + 1, np.int64)
        change[e.start[i]] += 1
        np.add.at(change, e.start[i] + e.count[i], -1)
        open = np.cumsum(change)[:-1] > 0


def _edges(docs: DataFrame, window: int, prefix: int, k: int) -> DataFrame:
    """(KEY, group, label, words) of the edges by the prefix length k, each label once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "text"):
            owner, opened = _lists(b.column("open"))
            for found, e in zip(prefix_lengths(window, prefix), edges_of(Words(texts), window, prefix, (owner, _hashes(opened)))):
                if found == k:
                    _, one = np.unique(np.stack([e.text.astype(U), e.label], 1), axis=0, return_index=True)
                    key = [b.column(c).take(pa.array(e.text[one])) for c in ("id", "k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*key, _signed(e.group[one]), _signed(e.label[one]), pa.array(e.words[one])], names=["id", "k1", "k2", "group", "label", "words"])

    return bounded(docs).mapInArrow(run, f"{KEY}, group long, label long, words long")


def _leaves(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """(id, group, label, slice): the words, joined by one space, of the edges in the column `hit`, once for a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, "text"):
            texts = [b" ".join(t.split()) for t in texts]
            w = Words(texts)
            data = w.buf.tobytes()
            owner, opened = _lists(b.column("open"))
            mine, hit = _lists(b.column("hit"))
            for e in edges_of(w, window, prefix, (owner, _hashes(opened))):
                i = _places(e.text, e.label, mine, _hashes(hit))[0]
                if not len(i):
                    continue
                _, one = np.unique(np.stack([e.text[i].astype(U), e.label[i]], 1), axis=0, return_index=True)
                i = i[one]
                size, at = e.words[i], w.start[e.start[i]]
                stop = w.end[e.start[i] + size - 1]
                text = pa.array([data[s:t] for s, t in zip(at.tolist(), stop.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(e.text[i])), _signed(e.group[i]), _signed(e.label[i]), text], names=["id", "group", "label", "slice"])

    return bounded(docs).mapInArrow(run, "id long, group long, label long, slice binary")


def deep_nodes(words: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Number of the node that each suffix in `start` reaches at `depth` words; equal numbers, equal words.

    Suffixes are ranked by their first word, then by 2, 4, 8 ... words from the ranks before, as a suffix array is
    built; ranks of the largest power of two twice, overlapping, give the depth between two powers. Ranks keep the
    order of the words' numbers, so neighbours in rank are neighbours in the tree.
    """
    _, rank = np.unique(words, return_inverse=True)
    have = 1
    while 2 * have <= depth:
        after = np.concatenate([rank[have:] + 1, np.zeros(min(have, len(rank)), rank.dtype)])[: len(rank)]
        _, rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)
        have *= 2
    pair = rank[start] * (len(rank) + 1) + rank[start + depth - have]
    return np.unique(pair, return_inverse=True)[1]


def _repeats(group: list[int], label: list[int], text: list[bytes], first: np.ndarray, last: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows of _RUNS for the leaves of whole groups: runs of a leaf's windows and the smallest document that has them."""
    split = [t.split(b" ") for t in text]
    sizes = np.array([len(x) for x in split], np.int64)
    words = pa.array([x for s in split for x in s], pa.binary()).dictionary_encode().indices.to_numpy()
    windows = sizes - window + 1
    leaf = np.repeat(np.arange(len(text)), windows)
    nth = np.arange(len(leaf)) - np.repeat(np.cumsum(windows) - windows, windows)
    node = deep_nodes(words, (np.cumsum(sizes) - sizes)[leaf] + nth, window)
    order = np.argsort(node, kind="stable")
    heads = np.flatnonzero(np.diff(node[order], prepend=-1))
    lowest = np.minimum.reduceat(first[leaf[order]], heads)[node]
    at = np.flatnonzero((np.diff(leaf, prepend=-1) != 0) | np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    count = np.diff(np.append(at, len(leaf)))
    lost = lowest[at] < last[leaf[at]]
    at, count = at[lost], count[lost]
    twice: dict[tuple[int, int], int] = {}
    for x in zip(group, label):
        twice[x] = twice.get(x, 0) + 1
    owner = leaf[at].tolist()
    same = pa.array([text[i] if twice[group[i], label[i]] > 1 else None for i in owner], pa.binary())
    cols = [pa.array([c[i] for i in owner], pa.int64()) for c in (group, label)]
    return pa.RecordBatch.from_arrays([*cols, same, pa.array(nth[at].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(lowest[at])], names=["group", "label", "same", "at", "n", "first"])


def _tree_runs(leaves: DataFrame, window: int) -> DataFrame:
    """(group, label, same, at, n, first) from leaves (group, label, slice, first, last) that are sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("group", "label", "slice", "first", "last"))):
                if held and size > LIMIT and row[0] != held[-1][0]:
                    yield out(held)
                    held, size = [], 0
                held.append(row)
                size += row[2].count(b" ") + 1
        if held:
            yield out(held)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        group, label, text, first, last = zip(*rows)
        return _repeats(group, label, text, np.array(first, np.int64), np.array(last, np.int64), window)

    return leaves.mapInArrow(run, "group long, label long, same binary, at int, n int, first long")


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(KEY, marks, open): for each document with repeats, marks (label, same, at, n) of windows to remove.

    `same` is null, or the words that an edge must have: only where two leaves of a group have the same label.
    """
    known = docs.filter(F.col(id_col).isNotNull()).select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    key, lengths = ["id", "k1", "k2"], prefix_lengths(window, prefix)
    found, opened, rows = None, None, known.withColumn("open", F.array().cast("array<bigint>"))
    for k in lengths:
        # grouped tables are stored before they are joined: only then can a join's hot keys be split
        edges = stored(_edges(rows, window, prefix, k))
        leaves = edges.groupBy("group", "label").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("words").alias("words"))
        groups = leaves.groupBy("group").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"), F.sum("words").alias("words")).filter("low < high")
        large = F.lit(k < window) & (F.col("n") > 1) & (F.col("words") > limit)
        groups = stored(groups.select("group", large.alias("large")))
        hits = stored(edges.join(groups, "group").select(*key, "group", "label", "large"))
        more_groups = k < window and not groups.filter("large").isEmpty()
        drop(edges, groups)
        small = hits.filter("not large").drop("large")
        found = small if found is None else found.union(small)
        if not more_groups:
            break
        more = hits.filter("large").select(*key, "label")
        opened = more if opened is None else opened.union(more)
        rows = known.join(opened.groupBy(*key).agg(F.collect_list("label").alias("open")), key)
    mine = found.groupBy(*key).agg(F.collect_list("label").alias("hit"))

    def with_opened(df: DataFrame) -> DataFrame:
        if opened is None:
            return df.withColumn("open", F.lit(None).cast("array<bigint>"))
        return df.join(opened.groupBy(*key).agg(F.collect_list("label").alias("open")), key, "left")

    slices_ = _leaves(with_opened(known.join(mine, key)), window, prefix)
    leaves = stored(slices_.groupBy("group", "label", "slice").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    runs = stored(_tree_runs(leaves.repartition("group").sortWithinPartitions("group"), window))
    drop(leaves)
    marks = found.join(runs, ["group", "label"]).filter("first < id").groupBy(*key).agg(F.collect_list(F.struct("label", "same", "at", "n")).alias("marks"))
    return with_opened(marks)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str, str] = ("n_words", "n_removed", "kept"), limit: int = LIMIT) -> DataFrame:
    """All rows and columns, with n_words, n_removed and kept (the words left, joined by one space), or other names.

    Words are runs other than 0x20 and 0x09-0x0D, unchanged. A word goes if a window of `window` words of its
    document covers it and the same words also start in a document with a smaller id. Windows are judged on the
    input. Null texts have no words; rows without an id lose nothing and make no other row lose anything;
    repeated rows (equal id) don't count against each other; an empty table gives no rows. Long texts are handled one at a time. Columns of the names that are added are replaced.
    """
    own = fresh([*docs.columns, *added], "__id", "__k1", "__k2", "__marks", "__open")
    docs_out = [f for f in docs.schema.fields if f.name.lower() not in {a.lower() for a in added}]
    names, marked_as, open_as = [f.name for f in docs_out], *own[3:]
    marks = repeats(docs, window, prefix, id_col, text_col, limit).toDF(*own)
    key = row_key(id_col, text_col)
    rows = docs.join(marks, [k == F.col(n) for k, n in zip(key, own)], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in slices(batches, text_col):
            marked = np.flatnonzero(b.column(marked_as).is_valid().to_numpy(zero_copy_only=False))
            sub = [b" ".join(texts[i].split()) for i in marked]
            w = Words(sub)
            data = w.buf.tobytes()
            owner, lists = _lists(b.column(marked_as).take(pa.array(marked)))
            label, at, n = _hashes(lists.field("label")), *(lists.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
            same = lists.field("same").to_pylist() if lists.field("same").null_count < len(lists) else None
            mine, opened = _lists(b.column(open_as).take(pa.array(marked)))
            change = np.zeros(len(w.hash) + 1, np.int64)
            for e in edges_of(w, window, prefix, (mine, _hashes(opened))):
                i, j = _places(e.text, e.label, owner, label)
                if same:
                    ok = [same[y] is None or same[y] == data[w.start[e.start[x]] : w.end[e.start[x] + e.words[x] - 1]] for x, y in zip(i, j)]
                    i, j = i[ok], j[ok]
                first = e.start[i] + (0 if e.whole else at[j])
                np.add.at(change, first, 1)
                np.add.at(change, first + (e.count[i] if e.whole else n[j]) + window - 1, -1)
            covered = np.cumsum(change)[:-1] > 0
            kept, count, removed = [], [], []
            which = {int(i): k for k, i in enumerate(marked)}
            for i, t in enumerate(texts):
                words = t.split()
                count.append(len(words))
                if (k := which.get(i)) is not None:
                    words = [x for x, c in zip(words, covered[w.first[k] : w.first[k + 1]].tolist()) if not c]
                kept.append(b" ".join(words).decode())
                removed.append(count[-1] - len(words))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, *added])

    fields = [T.StructField(n, t) for n, t in zip(added, (T.LongType(), T.LongType(), T.StringType()))]
    return bounded(rows.select(*[F.col(f"`{c}`") for c in names], marked_as, open_as)).mapInArrow(run, T.StructType([*docs_out, *fields]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents in their own columns with the repeated words gone, n_chars as it is now; documents of nothing else go."""
    words, removed, kept = fresh(docs.columns, "__n_words", "__n_removed", "__kept")
    found = dedup_substrings(docs, added=(words, removed, kept))
    changed = F.col(removed) > 0
    found = found.filter(~changed | (F.col(kept) != ""))
    text = F.when(changed, F.col(kept)).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by hand for small inputs: id to n_words, n_removed, sha256."""
    first: dict[tuple, int] = {}
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(ws) if i not in gone)
        out[d] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest())
    return out
