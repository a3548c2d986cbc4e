"""Mixing to target weights with soft domain membership, in DataFrame functions only.

A classifier fitted on the labelled table (naive Bayes over hashed words; toxic by the strongest word) gives every
document a posterior of each domain. Distributed projected-gradient least squares then finds a rate for each document, none below zero,
with which the expected domain token totals match the targets: minimise |totals - targets|^2 / all^2 plus RIDGE * the token
weighted squared distance of the rates from 1. A document's gradient is its posteriors times the residuals of the
domains, so a step moves every rate along its posteriors and projects it to zero or more; what a pass over the documents
sums up (residuals and curvature of the rates above zero, a dozen numbers) is all that comes to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, stored, table

DOMAINS = ("good", "poor", "toxic")
SHARES = {"good": 0.75, "poor": 0.23, "toxic": 0.02}
SAMPLE, BUCKETS, SIGNS, SHARPNESS, RIDGE, STEPS, TOLERANCE = 20_000, 1 << 15, 1 << 14, 40.0, 2e-4, 60, 1e-6


def domain(quality: str = "quality", toxic: str = "toxic") -> Column:
    """The domain of a row of labels; null if a label that decides it is null."""
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(toxic) == 0, F.when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "poor"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _keys(id_col: str, text: str) -> tuple[Column, Column]:
    """128 bits of a row's id and text, so that repeated ids with different texts stay apart."""
    return F.xxhash64(id_col, text).alias("k1"), F.xxhash64(F.lit(1), F.col(text), F.length(text), F.col(id_col)).alias("k2")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _sign(a: Column, b: Column, n_a: int, n_b: int) -> Column:
    """Log odds of a word in a of n_a toxic and b of n_b other documents."""
    return F.log((a + 0.5) / (n_a + 1.0)) - F.log((b + 0.5) / (n_b + 1.0))


def _line(bad: tuple[int, float, float], rest: tuple[int, float, float]) -> tuple[float, float]:
    """Slope and base of the toxic log odds over a document's strongest sign, from (count, mean, variance) of both classes.

    The discriminant of two normal classes of one variance; without two documents of each the smoothed share alone.
    """
    (n1, m1, v1), (n0, m0, v0) = bad, rest
    if min(n1, n0) < 2 or m1 <= m0:
        return 0.0, math.log((n1 + 1) / (n0 + 2))
    slope = (m1 - m0) / max((n1 * v1 + n0 * v0) / (n1 + n0), 0.01)
    return slope, math.log(n1 / n0) - slope * (m1 + m0) / 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, signs: int = SIGNS) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Weights (bucket, w_<domain>) for each bucket seen, signs (h, sign) of toxic documents, and the model's numbers.

    Good and poor differ in what they are written in throughout, so all words count. A toxic document may be so
    by a few words only, so its strongest word decides: the `signs` words with the largest log odds by documents.
    The strongest signs of the labelled documents, each without its own part in the counts, give the line from
    signs to toxic log odds. The classifier is fitted on the `sample` labelled documents with the smallest hashes
    of doc_id; of several labels of one document the smallest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain().alias("domain")).filter("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t")).join(F.broadcast(known), "id")
    seen = stored(texts.select("domain", *_keys("id", "t"), "t"))
    count = lambda d: F.count(F.when(F.col("domain") == d, 1))
    words = seen.select("domain", F.explode(_words("t")).alias("w")).select("domain", _bucket(F.xxhash64("w")).alias("bucket"))
    counts = cut(words.groupBy("bucket").agg(*[count(d).alias(d) for d in DOMAINS]))
    total = counts.agg(*[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS]).first()
    size = seen.agg(*[count(d).alias(d) for d in DOMAINS]).first()
    weights = counts.select("bucket", *[(F.log((F.col(d) + 1.0) / (total[d] + BUCKETS))).alias(f"w_{d}") for d in DOMAINS])
    fixed = {f"prior_{d}": math.log((size[d] + 1) / (sum(size) + len(DOMAINS))) for d in DOMAINS}
    fixed |= {f"unseen_{d}": -math.log(total[d] + BUCKETS) for d in DOMAINS}

    n_a, n_b = size["toxic"], sum(size) - size["toxic"]
    marks = seen.select("k1", "k2", (F.col("domain") == "toxic").alias("bad"), F.explode(F.array_distinct(_words("t"))).alias("w")).select("k1", "k2", "bad", F.xxhash64("w").alias("h"))
    a, b = F.col("a"), F.col("b")
    odds = marks.groupBy("h").agg(F.count(F.when(F.col("bad"), 1)).alias("a"), F.count(F.when(~F.col("bad"), 1)).alias("b")).filter("a > 0")
    best = cut(odds.withColumn("sign", _sign(a, b, n_a, n_b)).orderBy(F.desc("sign"), "h").limit(signs))
    without = F.when(~F.col("bad"), _sign(a, b - 1, n_a, n_b)).when(a > 1, _sign(a - 1, b, n_a, n_b))
    drawn = marks.join(F.broadcast(best), "h", "left").groupBy("k1", "k2", "bad").agg(F.greatest(F.max(without), F.lit(0.0)).alias("sign"))
    shape = {r["bad"]: (r["n"], r["m"], r["v"]) for r in drawn.groupBy("bad").agg(F.count("*").alias("n"), F.avg("sign").alias("m"), F.var_pop("sign").alias("v")).collect()}
    none = (0, 0.0, 0.0)
    fixed["slope"], fixed["base"] = _line(shape.get(True, none), shape.get(False, none))
    return weights, best.select("h", "sign"), fixed


def posteriors(docs: DataFrame, model: tuple[DataFrame, DataFrame, dict[str, float]]) -> DataFrame:
    """(doc_id, k1, k2, n_tokens, copies, p_<domain>): a row for each distinct row (doc_id, text), with how often it occurs.

    The toxic posterior comes from the document's strongest sign. What it leaves is divided between good and poor
    by the log likelihood, averaged over the words and sharpened by a constant, so that long documents keep soft
    memberships. Documents without words have the priors.
    """
    weights, signs, fixed = model
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", *_keys("doc_id", "text"), _words("text").alias("ws"))
    rows = rows.select("doc_id", "k1", "k2", F.size("ws").cast("long").alias("n_tokens"), F.explode_outer("ws").alias("w"))
    rows = rows.select("doc_id", "k1", "k2", "n_tokens", F.when(F.col("w").isNotNull(), F.xxhash64("w")).alias("h")).withColumn("bucket", _bucket(F.col("h")))
    rows = rows.join(F.broadcast(weights), "bucket", "left").join(F.broadcast(signs), "h", "left")
    like = lambda d: F.avg(F.coalesce(f"w_{d}", F.when(F.col("h").isNotNull(), F.lit(fixed[f"unseen_{d}"])))).alias(f"l_{d}")
    found = rows.groupBy("doc_id", "k1", "k2", "n_tokens").agg(F.count("*").alias("n"), F.greatest(F.max("sign"), F.lit(0.0)).alias("sign"), *map(like, ("good", "poor")))
    score = {d: F.coalesce(F.col(f"l_{d}"), F.lit(0.0)) * SHARPNESS + fixed[f"prior_{d}"] for d in ("good", "poor")}
    prior = fixed["prior_toxic"] - math.log(1 - math.exp(fixed["prior_toxic"]))
    bad = F.when(F.col("n_tokens") > 0, F.col("sign") * fixed["slope"] + fixed["base"]).otherwise(prior)
    found = found.withColumns({"p_toxic": 1 / (1 + F.exp(-bad)), "good": 1 / (1 + F.exp(score["poor"] - score["good"]))})
    copies = F.when(F.col("n_tokens") > 0, (F.col("n") / F.col("n_tokens")).cast("long")).otherwise(F.col("n"))
    rest = 1 - F.col("p_toxic")
    return found.select("doc_id", "k1", "k2", "n_tokens", copies.alias("copies"), (rest * F.col("good")).alias("p_good"), (rest * (1 - F.col("good"))).alias("p_poor"), "p_toxic")


def rate(pull: dict[str, float]) -> Column:
    """A document's rate: 1 less the pull of the domains that it belongs to, projected to zero or more."""
    return F.greatest(F.lit(0.0), 1.0 - sum(F.col(f"p_{d}") * F.lit(float(pull[d])) for d in DOMAINS))


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b for a small positive definite a."""
    rows = [[*r, y] for r, y in zip(a, b)]
    for i in range(len(rows)):
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(len(rows)):
            if j != i:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[-1] for r in rows]


def solve(points: DataFrame, targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> dict[str, float]:
    """The pull of each domain at which rate() minimises the objective over rows (p_<domain>, tokens).

    Each step is one pass that sums the objective, its gradient and the curvature of the rates that aren't at zero. The
    step is the gradient scaled by that curvature, and halved as long as the objective rises. It ends when no rate can move by the
    tolerance, as posteriors sum to 1.
    """
    pull = dict.fromkeys(DOMAINS, 0.0)
    scale = sum(targets.values())
    if not scale:
        return pull
    pairs = [(c, d) for i, c in enumerate(DOMAINS) for d in DOMAINS[i:]]
    w = F.col("tokens") / F.lit(float(scale))

    def sums(at: dict[str, float]) -> tuple[float, list[float], list[list[float]]]:
        r, free = F.col("r"), F.when(F.col("r") > 0, w)
        total = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
        got = points.withColumn("r", rate(at)).agg(
            total(w * r * r).alias("square"), *[total(w * r * F.col(f"p_{d}")).alias(d) for d in DOMAINS],
            *[total(free * F.col(f"p_{c}") * F.col(f"p_{d}")).alias(f"{c} {d}") for c, d in pairs],
        ).first()
        value = got["square"] / 2 + sum(at[d] * targets[d] / scale + RIDGE * at[d] ** 2 / 2 for d in DOMAINS)
        down = [got[d] - targets[d] / scale - RIDGE * at[d] for d in DOMAINS]
        curve = {x: got[f"{x[0]} {x[1]}"] for x in pairs}
        return value, down, [[curve.get((c, d), curve.get((d, c))) + (RIDGE if c == d else 0.0) for d in DOMAINS] for c in DOMAINS]

    now = sums(pull)
    for _ in range(steps):
        step = _solved(now[2], now[1])
        part = 1.0
        while True:
            moved = {d: pull[d] + part * x for d, x in zip(DOMAINS, step)}
            new = sums(moved)
            if new[0] <= now[0] + 1e-12 or part < 1e-4:
                break
            part /= 2
        pull, now = moved, new
        if max(abs(part * x) for x in step) < tolerance:
            break
    return pull


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float] | None = None, grow: bool = False) -> DataFrame:
    """(doc_id, k1, k2, n_tokens, p_<domain>, rate, copies), one row per document.

    shares are the targets' parts of all tokens. They hold for today's number of tokens, or with grow for the
    smallest number that needs no domain but the last one thinned. copies rounds the rate up or down by a hash
    of the document, so that the expected copies are the rate. Null texts have no tokens and the prior
    posteriors; null labels teach nothing; repeated rows get a row each; no documents give no rows. A long text's words
    are rows like any other's.
    """
    shares = shares or SHARES
    found = stored(posteriors(docs, fit(docs, labels)))
    points = found.select((F.col("n_tokens") * F.col("copies")).cast("double").alias("tokens"), *[f"p_{d}" for d in DOMAINS])
    now = points.agg(*[F.coalesce(F.sum(F.col("tokens") * F.col(f"p_{d}")), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    size = max(now[d] / shares[d] for d in DOMAINS[:-1]) if grow else sum(now)
    pull = solve(points, {d: size * shares[d] for d in DOMAINS})
    rows = found.withColumn("rate", rate(pull)).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    u = F.pmod(F.xxhash64("doc_id", "k1", "nth"), F.lit(1 << 30)) / float(1 << 30)
    return rows.select("doc_id", "k1", "k2", "n_tokens", *[f"p_{d}" for d in DOMAINS], "rate", F.floor(F.col("rate") + u).cast("int").alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents in their own columns, each as often as its copies, which follow the rates alone. Of rows with equal doc_id and
    text one stands for all and comes as often as their copies add up to."""
    found = mix(docs, labels, grow=True)
    a, b, c, d, i, row, times = fresh(docs.columns, "__k1", "__k2", "__k3", "__k4", "__id", "__row", "__times")
    plan = found.groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.sum("copies").cast("int").alias(times))
    k1, k2 = _keys(i, "text")
    each = docs.withColumn(i, F.col("doc_id").cast("long")).groupBy(k1.alias(c), k2.alias(d)).agg(F.first(F.struct(*[F.col(f"`{x}`") for x in docs.columns])).alias(row))
    out = each.join(plan, (F.col(c) == F.col(a)) & (F.col(d) == F.col(b))).filter(F.col(times) > 0)
    return out.select(row, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(row)[x].alias(x) for x in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k1", "k2")
