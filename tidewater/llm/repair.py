"""Repair of conversations at the least cost: a shortest path through the edits, by Dial's bucket queue.

The nodes are (rows dealt with, state of what is kept so far); the states are those of `(s?(ua)+)?`, and an arc is an edit.
Costs are integers of at most 6, so that a ring of 7 buckets takes the place of a heap. Distances to the end are settled
backwards; then a walk from the start takes, of the arcs that are tight, the one whose letter comes first.

Rows are ordered by one range shuffle, so that a conversation of any size spreads over tasks. A conversation that lies
inside a task's rows is repaired there. One that is cut (the first and the last of a task) or long comes out in chunks: its
faults, a byte a row, are put together for the path, whose audit has a letter a row anyway; its texts stay in chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, stored, table

CHUNK_ROWS, CHUNK_BYTES = 4096, 1 << 20

# Costs of the edits, and what a row that ends in the middle of a sentence adds where it stays.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5

NONE, SYSTEM, USER, ASSISTANT = range(4)  # states by the last role kept
LETTERS = b"xsua"  # of roles by the state that they lead to
BEFORE = {SYSTEM: (NONE,), USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}  # states that a role may follow
AFTER = {(p, q): True for q, ps in BEFORE.items() for p in ps}
NEXT = (USER, USER, ASSISTANT, USER)  # the one role besides system that may follow a state
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16  # flags of a code, beside the role's state
ROLES = {USER: "user", ASSISTANT: "assistant"}


def distances(codes: bytes) -> list[int]:
    """The cost from each node, 4 * rows + state, to the end."""
    n = len(codes)
    far = 1 << 60
    dist = [far] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(REROLE + CUT + 1)]
    for q in (NONE, ASSISTANT):
        dist[4 * n + q] = 0
        ring[0].append(4 * n + q)
    d, left = 0, 2
    while left:
        bucket = ring[d % len(ring)]
        while bucket:
            node = bucket.pop()
            left -= 1
            if dist[node] != d:
                continue
            i, q = divmod(node, 4)
            arcs = [(4 * i + p, INSERT) for p in BEFORE[q]] if q in ROLES else []
            if i:
                code, base = codes[i - 1], node - 4 - q
                arcs.append((base + q, DELETE))
                if not code & (BLANK | DUPLICATE):
                    cut = CUT if code & TRUNCATED else 0
                    if q and code & 3 == q:
                        arcs += [(base + p, cut) for p in BEFORE[q]]
                    elif q in ROLES:
                        arcs += [(base + p, cut + REROLE) for p in BEFORE[q]]
            for to, cost in arcs:
                if d + cost < dist[to]:
                    dist[to] = d + cost
                    ring[(d + cost) % len(ring)].append(to)
                    left += 1
        d += 1
    return dist


def walk(codes: bytes, dist: list[int]) -> str:
    """The letters of the cheapest edits, the first in order of those that cost the same."""
    out, i, q, n = [], 0, NONE, len(codes)
    while True:
        here = dist[4 * i + q]
        if i == n and not here:
            return "".join(out)
        code = codes[i] if i < n else BLANK
        if i < n and here == DELETE + dist[4 * i + 4 + q]:
            out.append("D")
            i += 1
            continue
        to = NEXT[q]
        if here == INSERT + dist[4 * i + to]:
            out.append("I")
            q = to
            continue
        cut, own = (CUT if code & TRUNCATED else 0), code & 3
        if (q, own) in AFTER and here == cut + dist[4 * i + 4 + own]:
            out.append("K")
            q = own
        else:
            out.append("R")
            q = to
        i += 1


def audit_of(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows with these codes."""
    dist = distances(codes)
    return dist[NONE], walk(codes, dist)


def repaired(audit: str, lines: list[tuple[str, str, int]], state: int = NONE) -> Iterator[str]:
    """The lines that stay or come in; lines are (role, text, how many times), the audit has a letter each and one an insertion;
    state is that before the first of them."""
    at, left = iter(lines), 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield f"{ROLES[state]}:"
            continue
        if not left:
            role, text, left = next(at)
        left -= 1
        if letter != "D":
            state = NEXT[state] if letter == "R" else LETTERS.index(role[:1].encode()) if letter == "K" else state
            yield f"{ROLES[state] if letter == 'R' else role}:{text}"


def count_faults(codes: bytes) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles don't follow each other."""
    legal = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    blank, twice, cut = (sum(1 for c in codes if c & f) for f in (BLANK, DUPLICATE, TRUNCATED))
    return blank, twice, cut, sum((a & 3, b & 3) not in legal for a, b in zip(codes, codes[1:]))


def gaps_of(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


# --- rows


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage, by the CRC of `conv:turn` modulo 20."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    k = F.crc32(name) % 20
    said = F.coalesce(F.col(text), blank)
    said = F.when(k == 1, "").when(k == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    who = F.when(k == 4, "user").otherwise(F.coalesce(F.col(role), blank))
    times = F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.filter(k != 0).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("text"), times.alias("_")).drop("_")


def _code() -> Column:
    """A row's state and first fault; `again` is true where an earlier turn has its role and text."""
    initial = F.substring("role", 1, 1)
    state = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NONE)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.coalesce(F.col("again"), F.lit(False))
    cut = ~F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(".", "!", "?")
    return (state + F.when(blank, BLANK).when(later, DUPLICATE).when(cut, TRUNCATED).otherwise(0)).cast("int")


CHUNK = "conv long, cost long, audit string, sha string, blank long, duplicate long, truncated long, illegal long, gaps long, part long, nth long, codes binary, lines array<struct<role:string,text:string,m:long>>, first long, last long, turns long"
CHUNK_NAMES = [x.split()[0] for x in CHUNK.split(", ")]


def _coded(m: int, code: int) -> bytes:
    """Codes of m equal rows: all but the first are duplicates, or blank."""
    state = code & 3
    return bytes([code]) + bytes([code if code & BLANK else state | DUPLICATE]) * (m - 1)


def _repair(chunk_rows: int, chunk_bytes: int):
    line_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("m", pa.int64())]))
    kinds = pa.schema([(n, pa.string() if n in ("audit", "sha") else pa.binary() if n == "codes" else line_type if n == "lines" else pa.int64()) for n in CHUNK_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, size, seen = TaskContext.get().partitionId(), 0, 0, False
        now: tuple = ()
        held: list[tuple[int | None, str, str, int, int]] = []
        out: list[tuple] = []
        out_size = 0

        def turns() -> tuple[int | None, int | None, int]:
            t = [x[0] for x in held if x[0] is not None]
            return (t[0], t[-1], len(set(t))) if t else (None, None, 0)

        def close(chunked: bool) -> None:
            """Puts the held rows out, as a whole conversation or as a chunk of one."""
            nonlocal held, size, nth, out_size
            codes = b"".join(_coded(m, c) for *_, m, c in held)
            first, last, distinct = turns()
            lines = [(r, t, m) for _, r, t, m, _ in held]
            if chunked:
                out.append((now[0], None, None, None, None, None, None, None, None, part, nth, codes, [{"role": r, "text": t, "m": m} for r, t, m in lines], first, last, distinct))
                nth += 1
                out_size += size
            else:
                cost, audit = audit_of(codes)
                sha = hashlib.sha256("\n".join(repaired(audit, lines)).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((now[0], cost, audit, sha, *count_faults(codes), gaps_of(first, last, distinct), None, None, None, None, None, None, None))
                out_size += len(audit) + 200
            held, size = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out, out_size
            b = pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), kinds)], schema=kinds)
            out, out_size = [], 0
            return b

        for b in batches:
            for conv, turn, role, text, m, code in zip(*[b.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "m", "code")]):
                if now != (conv,):
                    if held:
                        close(chunked=not seen or nth > 0)  # the first conversation may have begun in another task
                        seen = True
                    now, nth = (conv,), 0
                elif len(held) >= chunk_rows or size >= chunk_bytes:
                    close(chunked=True)
                held.append((turn, role, text, m, code))
                size += len(text) * 2 + 50
                if out_size >= chunk_bytes:
                    yield batch()
        if held:
            close(chunked=True)  # and the last may go on
        if out:
            yield batch()

    return run


def _paths(key: tuple, chunks: pa.Table) -> pa.Table:
    """A cut conversation's path, from the codes of its chunks in order: a byte a row, as the audit has a letter a row."""
    chunks = chunks.sort_by([("part", "ascending"), ("nth", "ascending")]).to_pydict()
    codes = b"".join(chunks["codes"])
    cost, audit = audit_of(codes)
    first = last = None
    distinct = 0
    for f, t, n in zip(chunks["first"], chunks["last"], chunks["turns"]):
        if n:
            first = f if first is None else first
            distinct += n - (last == f)
            last = t
    rows, at, row, state, end = [], 0, 0, NONE, len(chunks["codes"]) - 1
    for i, piece in enumerate(chunks["codes"]):
        # a chunk's part of the audit: its rows with the insertions before each, and those at the end with the last chunk
        start, before, left = at, state, len(piece)
        while at < len(audit) and (left or i == end):
            letter = audit[at]
            state = NEXT[state] if letter in "IR" else codes[row] & 3 if letter == "K" else state
            row += letter != "I"
            left -= letter != "I"
            at += 1
        rows.append((chunks["conv"][i], chunks["part"][i], chunks["nth"][i], audit[start:at], before, *[None] * 7))
    rows.append((chunks["conv"][0], None, None, None, None, cost, audit, *count_faults(codes), gaps_of(first, last, distinct)))
    names = [x.split() for x in PATH.split(", ")]
    return pa.table({n: pa.array(c, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for (n, t), c in zip(names, zip(*rows))})


PATH = "conv long, part long, nth long, slice string, state int, cost long, audit string, blank long, duplicate long, truncated long, illegal long, gaps long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each cut conversation's lines, from chunks in order, one at a time."""
    now, sha, empty = None, None, True
    done: list[tuple] = []
    for b in batches:
        for conv, audit, state, lines in zip(*[b.column(c).to_pylist() for c in ("conv", "slice", "state", "lines")]):
            if now != (conv,):
                if now:
                    done.append((now[0], sha.hexdigest()))
                now, sha, empty = (conv,), hashlib.sha256(), True
            text = "\n".join(repaired(audit, [(x["role"], x["text"], x["m"]) for x in lines], state))
            if any(x != "D" for x in audit):
                sha.update((("" if empty else "\n") + text).encode("utf-8", "surrogatepass"))
                empty = False
    if now:
        done.append((now[0], sha.hexdigest()))
    for _, some in groupby(enumerate(done), lambda x: x[0] >> 14):
        ids, found = zip(*[x[1] for x in some])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], names=["conv", "sha"])


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(rows: DataFrame, ids: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of each conversation of ids (conv), from rows
    (conv, turn, role, text) without null roles and texts.

    Rows go by turn, null turns first, and at the same turn by role and text. Equal rows are counted before they are
    shuffled. A null conversation is one conversation. A role is the state of its first letter; none of s, u and a can't stay.
    One without rows has zeros, an empty audit and the digest of an empty text. Empty tables give no rows. Long texts are
    held one chunk at a time.
    """
    some = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("m"))
    some = stored(some.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text", F.length("text"))}))
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    twice = some.groupBy("conv", "role", "h1", "h2").agg(F.min(order).alias("earliest"), F.count("*").alias("k")).filter("k > 1")
    twice = twice.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "earliest")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2"))
    marked = some.join(twice, same, "left").withColumn("again", order > F.col("earliest"))
    coded = marked.select("conv", "turn", "role", "text", "m", _code().alias("code"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = coded.repartitionByRange(parts, "conv", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv", "turn", "role", "text")
    done = stored(bounded(dealt).mapInArrow(_repair(chunk_rows, chunk_bytes), CHUNK))

    chunks = done.filter("part is not null")
    paths = stored(chunks.select("conv", "part", "nth", "codes", "first", "last", "turns").groupBy("conv").applyInArrow(_paths, PATH))
    slices = paths.filter("part is not null").select(F.col("conv").alias("c"), F.col("part").alias("p"), F.col("nth").alias("n"), "slice", "state")
    joined = chunks.join(slices, F.col("conv").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("nth") == F.col("n")))
    told = joined.select("conv", "part", "nth", "slice", "state", "lines").repartition("conv").sortWithinPartitions("conv", "part", "nth").mapInArrow(_digests, "conv long, sha string")
    whole = paths.filter("part is null").join(told.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c"))).select("conv", *RESULT, "audit", "sha")
    found = done.filter("part is null").select("conv", *RESULT, "audit", "sha").union(whole)
    every = ids.select(F.col("conv").alias("i")).distinct()
    out = every.join(found, F.col("i").eqNullSafe(F.col("conv")), "left")
    return out.select(F.col("i").alias("conv"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in RESULT], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("sha"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = repair(damage(rows), rows.select(F.col("conv_id").cast("long").alias("conv")))
    return out.withColumnsRenamed({"conv": "conv_id", "sha": "repaired_sha256"})
