"""Language identification by cross-parsing entropy.

Labelled text of each language becomes a suffix automaton. A text is parsed into the longest matches that the
automaton knows, and the language that needs the fewest phrases per letter wins. Each letter of the labelled texts
has a symbol, so that the automata are sparse: the transitions of a state lie in one array at its base plus the
symbol, each with the base of its owner. A transition that is missing restarts at the root and counts a phrase, so a
step is two look-ups; numpy takes the steps of many texts and all languages side by side.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, fresh, table
from .words import slices

#: Labelled rows that a language is learned from: so many at most, whole, those of up to SAMPLE_CHARS characters before longer
#: ones, and none after SAMPLE_DOCS * SAMPLE_CHARS characters.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 4000
BLOCK = 2048  # symbols of a text that are parsed side by side with those of others; phrases go on from block to block
SLICE = 1_500_000  # bytes of text that are in Python at a time, and in a batch that goes back
UNKNOWN = "und"


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions {symbol: next state} by state of the suffix automaton of the symbols; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def fold(c: str) -> str:
    """A letter's lower case, as one character."""
    return c.lower()[:1]


def packed(step: list[dict[int, int]], n_symbols: int, offset: int) -> tuple[np.ndarray, int]:
    """Cells of owner << 32 | next state, and the root; states are numbers from offset on.

    A state's number is the base to which a symbol is added. Bases are drawn until all cells of the state are free, those
    of many transitions first; half of the cells stay free. States without transitions share the base that owns nothing.
    """
    size = 2 * sum(map(len, step)) + 1
    taken, used, draw = bytearray(size + n_symbols), bytearray(size), random.Random(0).random
    base = [0] * len(step)
    used[0] = 1
    for state in sorted(range(len(step)), key=lambda i: -len(step[i])):
        moves = step[state]
        if not moves:
            break
        while True:
            b = int(draw() * size)
            if not used[b] and not any(taken[b + c] for c in moves):
                break
        used[b] = 1
        base[state] = b
        for c in moves:
            taken[b + c] = 1
    cells = np.full(size + n_symbols, -1, np.int64)
    places = np.array([(base[i] + c, base[i], base[t]) for i, moves in enumerate(step) for c, t in moves.items()], np.int64).reshape(-1, 3)
    cells[places[:, 0]] = (places[:, 1] + offset) << 32 | (places[:, 2] + offset)
    return cells, base[0] + offset


class Model:
    """Languages in order, the labelled texts' letters with a symbol each, and one array of all automata.

    Symbol 0 is a break (any run of non-letters), 1 a letter that no labelled text has.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        seen = {fold(c) for t in samples.values() for c in set(t) if c.isalpha()}
        self.known = {c: i + 2 for i, c in enumerate(sorted(seen))}
        self.n = len(self.known) + 2
        tables, self.roots, at, lookup = [], [], 0, self.lookup()
        for lang in self.langs:
            step = automaton(self.symbols([samples[lang]], lookup)[0].tolist())
            cells, root = packed(step, self.n, at)
            at += len(cells)
            tables.append(cells)
            self.roots.append(root)
        self.table = np.concatenate(tables) if tables else np.full(self.n, -1, np.int64)
        # where a symbol leads that no phrase goes on with: from the root, or to it
        cells = self.table[np.array(self.roots, np.int64)[:, None] + np.arange(self.n)]
        roots = np.array(self.roots, np.int64)[:, None]
        self.restart = np.where(cells >> 32 == roots, cells & 0xFFFFFFFF, roots).astype(np.int64)

    def lookup(self) -> np.ndarray:
        """Symbol of each code point of the basic plane: letters by their lower case."""
        out = np.zeros(1 << 16, np.int32)
        for cp in range(1 << 16):
            c = chr(cp)
            if c.isalpha():
                out[cp] = self.known.get(fold(c), 1)
        return out

    def symbols(self, texts: list[str], lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, and where each text starts; runs of breaks are one, leading ones none."""
        lookup = self.lookup() if lookup is None else lookup
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        s = lookup[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        s[far] = [self.known.get(fold(chr(p)), 1) if chr(p).isalpha() else 0 for p in points[far].tolist()]
        start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        keep = s > 0
        keep[1:] |= s[:-1] > 0
        # a break at a text's start is dropped even if the text before ends with a letter
        heads = start[:-1][(start[:-1] < len(s))]
        keep[heads] = s[heads] > 0
        return s[keep], np.concatenate([[0], np.cumsum(keep)])[start]

    def step(self, now: np.ndarray, c: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the symbols c, and whether a phrase ended before them."""
        cells = self.table[now + c]
        ends = cells >> 32 != now
        return np.where(ends, self.restart[lang, c], cells & 0xFFFFFFFF), ends

    def phrases(self, texts: list[str], lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and whether the text has a letter.

        Blocks of all texts are parsed side by side, each from the root. Then the blocks that follow another are parsed again
        from the state in which that one ended, until they meet the path that they took from the root, as they do after a few
        letters; a block that never meets it changes the start of the next. The counts are those of one parse from start to end.
        """
        s, start = self.symbols(texts, lookup)
        size, langs = np.diff(start), len(self.langs)
        blocks = -(-size // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = start[owner] + nth * BLOCK
        stop = np.minimum(at + BLOCK, start[owner + 1]) if len(owner) else at
        order = np.argsort(at - stop, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        n, first = (stop - at)[order], at[order]
        rows = np.tile(np.array(self.roots, np.int64)[:, None], (1, len(owner)))
        count = np.zeros((langs, len(owner)), np.int64)
        states, ended = [], []  # by place in a block: [language, block], the longest blocks first
        every = np.arange(langs)[:, None]
        active = len(owner) - np.searchsorted(n[::-1], np.arange(1, n[0] + 1)) if len(n) else []
        for i, k in enumerate(active):
            rows[:, :k], ends = self.step(rows[:, :k], s[first[:k] + i], every)
            count[:, :k] += ends
            states.append(rows[:, :k].astype(np.int32))
            ended.append(ends)
        block, lang = (x.ravel() for x in np.meshgrid(np.flatnonzero(nth > 0), np.arange(langs)))
        while len(block):
            now, b, j, i = rows[lang, rank[block - 1]], block, lang, 0
            through = [np.zeros((2, 0), np.int64)]
            while len(b):
                r = rank[b]
                now, ends = self.step(now, s[at[b] + i], j)
                met = states[i][j, r] == now
                count[j, r] += ends.astype(np.int64) - ended[i][j, r]
                states[i][j, r], ended[i][j, r] = now, ends
                i += 1
                over = ~met & (n[r] == i)
                rows[j[over], r[over]] = now[over]
                through.append(np.stack([b[over], j[over]]))
                go = ~met & ~over
                now, b, j = now[go], b[go], j[go]
            block, lang = np.concatenate(through, axis=1)
            more = np.append(nth, 0)[block + 1] > 0
            block, lang = block[more] + 1, lang[more]
        out = np.zeros((len(texts), langs), np.int64)
        for j in range(langs):
            out[:, j] = np.bincount(owner, count[j, rank], len(texts))
        return out + (size > 0)[:, None], size > 0

    def predict(self, texts: list[str], lookup: np.ndarray) -> tuple[list[str], list[float]]:
        """Language and score of each text: the score is the winner's share of the inverse phrase counts."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        count, letters = self.phrases(texts, lookup)
        best = count.argmin(1)
        inverse = 1 / np.maximum(count, 1)
        share = inverse.max(1) / inverse.sum(1)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)], np.where(letters, share, 0.0).tolist()


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Labelled text per language: whole texts of `sample_docs` rows at most, with the smallest hashes of id and text; rows of up to
    `sample_chars` characters come first, and none follow once sample_docs * sample_chars characters are reached."""
    h = F.xxhash64(F.col(id_col).cast("string"), text_col)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), h.alias("h"), F.col(text_col).alias("t"))
    order = W.partitionBy("l").orderBy(F.length("t") > sample_chars, "h", "t")
    top = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample_docs)
    before = F.coalesce(F.sum(F.length("t").cast("long")).over(W.partitionBy("l").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = top.withColumn("before", before).filter(F.col("before") < sample_docs * sample_chars)
    out: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["l"], r["r"])):
        out.setdefault(r["l"], []).append(r["t"])
    return {k: " ".join(v) for k, v in out.items()}


def fit(docs: DataFrame, **names) -> Model:
    """A model from all letters of the sample: the rows of each language are bounded, whatever the input."""
    return Model(sample(docs, **names))


def predict(docs: DataFrame, model: Model, text_col: str = "text", added: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All rows and columns, with lang_pred and lang_score, or other names. A null text or one without a letter is `und`, score 0;
    so is every text where no language was learned. Of languages that need equally few phrases the first in order wins, as where a text has
    no letter of any labelled one. Long texts are parsed from start to end. Columns of the names
    that are added are replaced."""
    docs = docs.drop(*added)
    shipped = docs.sparkSession.sparkContext.broadcast({"langs": model.langs, "known": model.known, "n": model.n, "roots": model.roots, "table": model.table, "restart": model.restart})
    names, schema, model_of = docs.columns, docs.schema, Model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_of.__new__(model_of)
        m.__dict__.update(shipped.value)
        lookup = m.lookup()
        # what is held a letter grows with the languages
        for piece, texts in slices(batches, text_col, SLICE * 4 // max(4, len(m.langs))):
            langs, scores = m.predict([t.decode("utf-8", "replace") for t in texts], lookup)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, *added])

    return bounded(docs).mapInArrow(run, T.StructType([*schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, **names) -> DataFrame:
    """predict() with a model learned from the labelled rows that aren't held out."""
    return predict(docs, fit(docs.filter(~held_out())), **names)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents in which a language was found, with their own columns: those with a letter, whatever its script, also where no row teaches a language."""
    model = fit(docs.filter(~held_out()))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs.columns, "__lang", "__score")
    return predict(docs, model, added=(lang, score)).filter(F.col(lang) != UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
