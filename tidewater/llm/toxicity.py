"""Toxicity of texts, disguised words included, by a noisy channel.

A writer who disguises a word swaps letters for digits and signs, spaces them out or repeats them. Each such stretch of
a text becomes a lattice of the letters that may have been meant, with the channel's costs, and a Viterbi search under a
language model of characters finds the likeliest readings. The model's counts come from all documents. What a text
says plainly and what is restored are then scored by words and beginnings of words that labelled toxic texts have and
others lack.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, stored, table
from .words import slices

#: Labelled rows that the classifier learns from: about so many, drawn by a hash of their id. All that are scored are scored whole.
LABELLED = 20_000
ORDER, SYMBOLS = 4, 28  # of the language model: boundary, a-z, any other letter
CELLS = SYMBOLS**ORDER
BEAM, READINGS = 24, 3
PREFIXES = range(4, 9)  # letters of a word's beginning that are features, beside the whole word
PIECE = 1 << 20  # characters of a text that are split into words at a time
MEMO = 100_000  # words whose features a task remembers
LEAST, SURE = 0.3, 0.95  # share of toxic texts from which a feature counts, and from which it decides alone if no clean text had it

# Letters that digits and signs stand for, and letters of other scripts that look like Latin ones.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i", "£": "l",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}
JOINERS, MASKS = frozenset(" .-_~·,:;/\\'`"), frozenset("*#")
# Costs of the channel in nats.
SWAP, LOST, JOINED, SPLIT, REPEATED, MASKED = 1.0, 7.0, 0.5, 1.0, 0.5, 3.0

EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$@+|") + "“”„«»…–—¿¡’‘"
THRICE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"[^\W_][ .\-_~·,:;/\\'`*](?:.[ .\-_~·,:;/\\'`*])+.")
LETTERS = re.compile(r"[^\W\d_]+")
DECORATED = re.compile(r"^([$@])\1{2,}|([$@])\2{2,}$")
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])

#: Symbol of each byte of UTF-8: a letter's, 27 for the first byte of any other character, 255 for bytes that go on.
CLASSES = np.array([0 if b < 65 or 90 < b < 97 or 122 < b < 128 else (b | 32) - 96 if b < 128 else 255 if b < 192 else 27 for b in range(256)], np.uint8)


# --- language model


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of runs of ORDER symbols, summed over what a task reads; a word begins after boundaries only."""
    total = np.zeros(CELLS, np.int64)
    for _, texts in slices(batches, "text"):
        s = CLASSES[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
        s = s[s < 255]
        s = s[(s > 0) | np.append(True, s[:-1] > 0)]
        s = np.repeat(s, np.where(s == 0, ORDER - 1, 1)).astype(np.int64)
        s = np.concatenate([np.zeros(ORDER - 1, np.int64), s])
        code = np.zeros(max(0, len(s) - ORDER + 1), np.int64)
        for i in range(ORDER):
            code = code * SYMBOLS + s[i : i + len(code)]
        # boundaries count after letters only, so that it doesn't matter where texts are dealt
        total += np.bincount(code[(s[ORDER - 1 :] > 0) | (s[ORDER - 2 : -1] > 0)], minlength=CELLS)
    at = np.flatnonzero(total)
    for i in range(0, len(at), 1 << 15):
        yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 15)]), pa.array(total[at[i : i + (1 << 15)]])], names=["code", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities of a symbol after ORDER - 1 others, by code: counts over all texts, at most CELLS rows whatever their number."""
    rows = bounded(docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))).mapInArrow(_grams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    count = np.zeros(CELLS)
    for r in rows.collect():
        count[r["code"]] = r["n"]
    return log_probabilities(count)


def log_probabilities(count: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Each order's shares, with those of the next lower one as so many counts."""
    count, p = count.reshape([SYMBOLS] * ORDER), np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = count.sum(tuple(range(ORDER - order)))
        p = (c + weight * p) / (c.sum(-1, keepdims=True) + weight)
    return np.log(p).ravel().astype(np.float32)


# --- the channel


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else SYMBOLS - 1


def options(c: str, run: int, inner: bool) -> list[tuple[str, float]]:
    """What `run` equal characters may stand for, with the channel's cost."""
    if c in JOINERS:
        return [("", JOINED * run), (" ", SPLIT)]
    if c in MASKS and inner:
        letters = [(chr(97 + i) * k, MASKED * run) for i in range(26) for k in {1, run} if k <= 2]
        return [*letters, ("", LOST)]
    if c in LEET:
        swaps = [(x * k, SWAP + REPEATED * (run - k)) for x in LEET[c] for k in (1, 2) if k <= run]
        return [*swaps, (c, SWAP + 2) if c.isalpha() else ("", LOST)]
    if c.isalpha():
        return [(c * k, REPEATED * (run > k)) for k in (1, 2) if k <= run]
    return [("", LOST), (" ", SPLIT)]


def decode(said: str, logp, n: int = READINGS) -> list[str]:
    """The n likeliest readings, words apart by blanks; the states are the last ORDER - 1 symbols, the best BEAM of them go on."""
    most = SYMBOLS ** (ORDER - 1)
    # symbols so far, score, and letters as a chain
    beam: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    at = 0
    while at < len(said):
        c, start = said[at], at
        while at < len(said) and said[at] == c:
            at += 1
        after: dict[int, tuple[float, tuple | None]] = {}
        found = options(c, at - start, start > 0 and at < len(said))
        for state, (score, chain) in beam.items():
            for text, cost in found:
                s, now, put = state, score - cost, chain
                for x in text:
                    k = s * SYMBOLS + symbol(x)
                    now += logp[k]
                    s = 0 if x == " " else k % most
                    put = (put, x)
                if s not in after or now > after[s][0]:
                    after[s] = (now, put)
        beam = after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda x: (-x[1][0], x[0]))[:BEAM])
    ends = sorted(((score + logp[s * SYMBOLS] if s else score, s, chain) for s, (score, chain) in beam.items()), key=lambda x: (-x[0], x[1]))
    out = []
    for _, _, chain in ends[:n]:
        letters = []
        while chain:
            chain, x = chain
            letters.append(x)
        out.append("".join(reversed(letters)))
    return out


def readings(token: str, logp) -> list[str]:
    """Words that a token without blanks says plainly, and those that it may hide."""
    token = token.translate(INVISIBLE) if not token.isascii() else token
    core = DECORATED.sub("", token.strip(EDGE))
    if core.isalpha() and (core.isascii() or not any(c in LEET for c in core)) and not THRICE.search(core):
        return [core]
    if not core.isascii():
        core = unicodedata.normalize("NFKC", core).lower()
    out = LETTERS.findall(core)
    latin = any("a" <= c <= "z" for c in core)
    if SPACED.fullmatch(core):
        out += [w for r in decode(core.replace("*", " "), logp) for w in r.split()]
    elif latin and (any(c in LEET for c in core) or any(c in MASKS for c in core) or THRICE.search(core)):
        out += [w for r in decode(core, logp) for w in r.split()]
    return out


def pieces(text: str) -> Iterator[list[str]]:
    """Lower-cased tokens of a whole text, from about PIECE characters at a time, cut at blanks."""
    at, blank = 0, re.compile(r"\s")
    while at < len(text):
        cut = blank.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def spaced(tokens: list[str], carried: list[str]) -> list[str]:
    """Stretches of four or more single characters; one that reaches the end of a piece is carried on to the next."""
    out, last = [], None
    singles = [i for i, t in enumerate(tokens) if len(t) == 1]
    run, carried[:] = carried[:], []
    if run and (not singles or singles[0] != 0):
        if len(run) >= 4:
            out.append(" ".join(run))
        run = []
    for i in singles:
        if last is not None and i != last + 1:
            if len(run) >= 4:
                out.append(" ".join(run))
            run = []
        run.append(tokens[i])
        last = i
    if run and last == len(tokens) - 1:
        carried[:] = run
    elif len(run) >= 4:
        out.append(" ".join(run))
    return out


def stretches(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """A whole text's tokens, piece by piece, with the stretches of single characters among them."""
    carried: list[str] = []
    for tokens in pieces(text):
        yield tokens, spaced(tokens, carried)
    if len(carried) >= 4:
        yield [], [" ".join(carried)]


def marks(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return [word + "$", *(word[:k] for k in PREFIXES if k <= len(word))] if len(word) > 2 else []


# --- classifier


def _features(logp, known: dict[str, float] | None):
    """Functions from a token, and from a stretch of single characters, to their features (known ones, if given)."""
    memo: dict[str, list[str]] = {}

    def of(words: list[str]) -> list[str]:
        return [m for w in words for m in marks(w) if known is None or m in known]

    def token(t: str) -> list[str]:
        found = memo.get(t)
        if found is None:
            found = of(readings(t, logp))
            if len(memo) >= MEMO:
                memo.clear()
            if len(t) < 100:
                memo[t] = found
        return found

    return token, lambda run: of([w for r in decode(run, logp) for w in r.split()])


def _contexts(model):
    """(feature, context) of texts; a context is a token with its neighbours, or a stretch of single characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, stretch = _features(array("f", model.value["logp"]), model.value["marks"])
        for _, texts in slices(batches, "text"):
            rows: set[tuple[str, int]] = set()
            for text in texts:
                for tokens, runs in stretches(text.decode("utf-8", "replace")):
                    for i, t in enumerate(tokens):
                        if found := token(t):
                            h = xxhash.xxh64_intdigest(" ".join(tokens[max(0, i - 1) : i + 2])) >> 1
                            rows.update((m, h) for m in found)
                    for r in runs:
                        rows.update((m, xxhash.xxh64_intdigest(r) >> 1) for m in stretch(r))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64()))], names=["mark", "h"])

    return run


def _present(model):
    """How many texts have each feature (of the known ones, if any are given)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, stretch = _features(array("f", model.value["logp"]), model.value["marks"])
        count: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["mark", "n"])
            count.clear()
            return out

        for _, texts in slices(batches, "text"):
            for text in texts:
                here: set[str] = set()
                for tokens, runs in stretches(text.decode("utf-8", "replace")):
                    for t in set(tokens):
                        here.update(token(t))
                    for r in runs:
                        here.update(stretch(r))
                count.update(here)
                if len(count) > MEMO:
                    yield batch()
        yield batch()

    return run


EVIDENCE = ["tokens", "hits", "distinct", "total", "top", "sure"]


def _evidence(model):
    """What a text has of known features: its tokens, how many have one and how many of these differ, the sum and the greatest of
    the features' scores, and the greatest of those that no clean text had."""
    known, sure = model.value["marks"], model.value["sure"]
    token, stretch = _features(array("f", model.value["logp"]), known)

    def of(text: str) -> tuple[int, int, int, float, float, float]:
        n, hits, best, certain = 0, Counter(), {}, 0.0
        for tokens, runs in stretches(text):
            n += len(tokens)
            for said, find in ((Counter(tokens), token), (Counter(runs), stretch)):
                for t, k in said.items():
                    found = find(t)
                    if found:
                        hits[t] += k
                        best[t] = max(known[m] for m in found)
                        certain = max(certain, *(known[m] if m in sure else 0.0 for m in found))
        return n, sum(hits.values()), len(hits), sum(k * best[t] for t, k in hits.items()), max(best.values(), default=0.0), certain

    return of


def _rows_evidence(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _evidence(model)
        for piece, texts in slices(batches, "text"):
            found = [of(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), *(pa.array(map(float, c), pa.float64()) for c in zip(*found))], names=["toxic", *EVIDENCE])

    return run


def inputs(evidence: np.ndarray) -> np.ndarray:
    """Inputs of the regression from rows of EVIDENCE: the top feature's log odds, hits, distinct ones, and their share of the text."""
    n, hits, distinct, total, top, _ = evidence.T
    odds = np.where(top > 0, np.log(np.clip(top, 0.01, 0.99) / (1 - np.clip(top, 0.01, 0.99))), -4.0)
    return np.stack([np.ones(len(n)), odds, np.log1p(hits), np.log1p(distinct), np.minimum(3, 50 * total / np.maximum(n, 25)), top > 0], 1)


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(text, toxic) of about `most` labelled rows that aren't held out, drawn by a hash of the id; equal texts once a label.
    The draw is made on the labels, so that what is broadcast is bounded and no text is shuffled."""
    some = labels.filter(F.col("toxic").isNotNull() & ~held_out()).select(F.col("doc_id").alias("i"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    n = some.count()
    share = int(min(1.0, most / max(1, n)) * (1 << 20))
    some = some.filter(F.pmod(F.xxhash64(F.lit(7), "i"), F.lit(1 << 20)) < share).distinct()
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(some), F.col("doc_id") == F.col("i"))
    return rows.select("text", "toxic").dropDuplicates(["text", "toxic"])


class Model:
    """logp: the language model; marks: share of toxic texts among those with a feature; sure: features that no clean text had;
    weights: of the regression, none where only one label was seen; base: score of a text without features."""

    def __init__(self, logp: np.ndarray, marks: dict[str, float], sure: set[str], base: float):
        self.logp, self.marks, self.sure, self.base = logp, marks, sure, base
        self.weights: np.ndarray | None = None

    def scores(self, evidence: list[tuple]) -> list[float]:
        e = np.array(evidence, float).reshape(-1, len(EVIDENCE))
        known = np.minimum(1.0, e[:, 4]) if self.weights is None else 1 / (1 + np.exp(-np.clip(inputs(e) @ self.weights, -30, 30)))
        return np.where(e[:, 1] > 0, np.maximum(known, np.where(e[:, 5] >= SURE, e[:, 5], 0.0)), self.base).tolist()


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Features that labelled toxic texts have so much oftener than the others that chance doesn't explain it.

    A feature's count in toxic texts is the lesser of its texts and its distinct contexts, so that copies and passages count
    once. It stays where the likelihood ratio against the share of toxic texts passes 100 times the number of features. A
    regression on what a text has of these features then tells toxic texts from clean ones that have such a word by chance.
    """
    spark = docs.sparkSession
    logp = language_model(docs)
    rows = stored(labelled(docs, labels, most))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = (toxic + 1) / (toxic + clean + 2)
    ship = lambda marks: spark.sparkContext.broadcast({"logp": logp, "marks": marks})
    present = lambda which, marks: bounded(rows.filter(F.col("toxic") == which).select("text")).mapInArrow(_present(ship(marks)), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    in_toxic = stored(present(1, None))
    bar = math.log(100 * max(1, in_toxic.count()))
    # no feature passes with fewer, whatever the others have
    least = bar / -math.log(prior)
    often = {r["mark"]: r["n"] for r in in_toxic.filter(F.col("n") >= least).collect()}
    candidates = dict.fromkeys(often, 0.0)
    contexts = bounded(rows.filter("toxic = 1").select("text")).mapInArrow(_contexts(ship(candidates)), "mark string, h long").distinct().groupBy("mark").count()
    often = {r["mark"]: min(r["count"], often[r["mark"]]) for r in contexts.collect()}
    n_of = {r["mark"]: r["n"] for r in present(0, candidates).collect()}
    known, sure = {}, set()
    for mark, t in often.items():
        n = n_of.get(mark, 0)
        p = t / (t + n)
        gain = t * math.log(p / prior) + (n * math.log((1 - p) / (1 - prior)) if n else 0.0)
        if gain >= bar and p >= LEAST:
            known[mark] = (t + 2 * prior) / (t + n + 2)
            if not n:
                sure.add(mark)
    model = Model(logp, known, sure, min(0.25, prior / 4))
    if toxic and clean:
        shipped = spark.sparkContext.broadcast({"logp": logp, "marks": known, "sure": sure})
        # six numbers a labelled row of the bounded draw
        drawn = np.array(bounded(rows).mapInArrow(_rows_evidence(shipped), ", ".join(["toxic int", *(f"{c} double" for c in EVIDENCE)])).collect(), float)
        model.weights = regression(inputs(drawn[:, 1:]), drawn[:, 0])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", added: str = "toxicity") -> DataFrame:
    """All rows and columns, with the text's score from 0 to 1: how likely a labelled text with its features is toxic, or, if that
    is more, the share of a feature that no clean text had (SURE at least).

    Null and empty texts and those without features have the model's base. Texts are read whole, in pieces cut between words.
    Repeated rows get equal scores, an empty table gives no rows. A column of the added name is replaced.
    """
    docs = docs.drop(added)
    shipped = docs.sparkSession.sparkContext.broadcast({"logp": model.logp, "marks": model.marks, "sure": model.sure})
    names, light, evidence = docs.columns, Model(None, {}, set(), model.base), _evidence
    light.weights = model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = evidence(shipped)
        for piece, texts in slices(batches, text_col, 4 << 20):
            found = light.scores([of(t.decode("utf-8", "replace")) for t in texts])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.float64())], names=[*names, added])

    return bounded(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added, T.DoubleType())]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score(docs, fit(docs, labels), added="score")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
