"""Toxicity: the channel against exhaustive search, the counts against plain Python, and texts with disguised words."""

import random
from array import array
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tidewater.llm import toxicity as x

DOCS = "doc_id long, text string, lang string, score string, toxic string"
SYLLABLES = "ba be bi bo da de di do fa fe fi ka ke ki la le li lo ma me mi mo na ne ni no".split()
BAD = ["zorgut", "quamplet", "wexord"]


def word(r):
    return "".join(r.choices(SYLLABLES, k=r.randint(1, 4)))


def corpus(n, r):
    docs, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        words = [word(r) for _ in range(r.randint(20, 60))]
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD))
        docs.append((i, " ".join(words), "en", "s", "t"))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(600, random.Random(2))
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    return x.fit(*frames), docs, labels


def test_counts_of_symbols(spark):
    texts = ["Ab c", "éa-b\n日x", None, "", "Q" * 9]
    got = x.language_model(spark.createDataFrame([(t,) for t in texts], "text string"))
    count = np.zeros(x.CELLS)
    s = [0]
    for t in texts:
        for c in (t or "").lower() + " ":
            k = x.symbol(c) if c.isalpha() else 0
            if k or s[-1]:
                s.append(k)
    s = [y for k in s for y in ([0, 0, 0] if k == 0 else [k])]
    for g in (g for g in zip(s, s[1:], s[2:], s[3:]) if g[2] or g[3]):
        count[sum(k * x.SYMBOLS ** (3 - i) for i, k in enumerate(g))] += 1
    want = x.log_probabilities(count)
    assert np.allclose(got, want) and np.allclose(np.exp(got.reshape(-1, x.SYMBOLS)).sum(1), 1, atol=1e-4)


def test_viterbi_against_every_path(monkeypatch):
    monkeypatch.setattr(x, "BEAM", 10**6)
    r = random.Random(3)
    logp = array("f", [-r.random() * 6 for _ in range(x.CELLS)])
    for said in ("1d10t", "m0r0n", "aaab", "s.c.u.m", "l0$er!", "b éé1", "x*y", "6g|", "++"):
        units, at = [], 0
        while at < len(said):
            start = at
            while at < len(said) and said[at] == said[start]:
                at += 1
            units.append(x.options(said[start], at - start, start > 0 and at < len(said)))
        best = {}
        for path in product(*units):
            text, cost, state = "".join(t for t, _ in path), sum(c for _, c in path), 0
            score = -cost
            for c in text:
                score += logp[state * x.SYMBOLS + x.symbol(c)]
                state = 0 if c == " " else (state * x.SYMBOLS + x.symbol(c)) % x.SYMBOLS**3
            score += logp[state * x.SYMBOLS] if state else 0
            best[text] = max(score, best.get(text, -1e9))
        top = max(best.values())
        assert best[x.decode(said, logp)[0]] == pytest.approx(top, abs=1e-4), said


def test_stretches_go_on_from_piece_to_piece(monkeypatch):
    text = "one z o r g u t two a b c three" + " x y" * 9
    want = [["z o r g u t", " ".join("xy" * 9)]]
    for size in (5, 16, 1 << 20):
        monkeypatch.setattr(x, "PIECE", size)
        got = list(x.stretches(text))
        assert [[r for _, runs in got for r in runs]] == want and [t for tokens, _ in got for t in tokens] == text.split()


def test_disguises_are_seen_through(spark, trained):
    model, docs, labels = trained
    assert {b + "$" for b in BAD} <= model.sure and all(m.rstrip("$") in "".join(BAD) for m in model.marks)
    r = random.Random(4)
    swap = {"o": "0", "e": "3", "a": "@", "t": "7", "l": "1"}
    ways = [str.upper, lambda w: "".join(swap.get(c, c) for c in w), " ".join, ".".join, lambda w: w[0] + w[1] * 5 + w[2:], lambda w: w[:3] + "​" + w[3:], lambda w: f"({w})!!", lambda w: " ".join(swap.get(c, c) for c in w)]
    hidden, clean = [], []
    for i in range(160):
        words = [word(r) for _ in range(40)]
        clean.append((i, " ".join(words), "en", "s", "t"))
        words.insert(r.randrange(40), ways[i % len(ways)](r.choice(BAD)))
        hidden.append((i, " ".join(words), "en", "s", "t"))
    caught, left = ([v.score for v in x.score(spark.createDataFrame(some, DOCS), model, added="score").collect()] for some in (hidden, clean))
    assert sum(v >= 0.5 for v in caught) >= 157 and all(v < 0.5 for v in left)
    # held-out rows of the same kind
    truth = dict(labels)
    found = {v.doc_id: v.score for v in x.score(spark.createDataFrame(docs, DOCS), model, added="score").filter(x.held_out()).collect()}
    assert len(found) > 80 and all((s >= 0.5) == truth[i] for i, s in found.items())


def test_odd_rows(spark, trained):
    model, *_ = trained
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "zorgut wexord"), (4, "é" * 100_000), (5, "0" * 100_000), (6, "ba " * 300_000 + "zorgut"), (7, "日本語 5 % !!"), (2, "")]
    got = x.score(spark.createDataFrame([(*r, "l", "s", "t") for r in rows], DOCS).repartition(3), model, added="score")
    assert got.columns == ["doc_id", "text", "lang", "toxic", "score"]
    scores = Counter((r.doc_id, round(r.score, 6)) for r in got.collect())
    base = round(model.base, 6)
    assert scores[2, base] == 2 and scores[1, base] == 1 and all(s == base for i, s in scores if i in (1, 2, 3, 4, 5, 7)) and all(s > 0.5 for i, s in scores if i in (None, 6))
    assert x.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ba be", "e", "s", "t"), (1, "ba be", "e", "s", "t"), (None, None, "e", "s", "t")], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = x.op13(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r.predicted == 0 and 0 <= r.score <= 0.5 for r in got)


def test_a_label_of_a_held_out_row_changes_nothing(spark):
    docs, labels = corpus(120, random.Random(5))
    import zlib

    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    models = [x.fit(frame, spark.createDataFrame(some, "doc_id long, toxic int")) for some in (labels, turned)]
    assert models[0].marks == models[1].marks and np.array_equal(models[0].weights, models[1].weights)
