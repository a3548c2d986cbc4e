"""Divergence of sources against exact arithmetic in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n int, at int"


def brute(rows, least=10, top=10):
    groups, docs = {}, {}
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        of = {s: c for (l, s), c in groups.items() if l == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in of.items()}, share(sum(of.values(), Counter()))
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in of:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in of if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if of[s][t] and p[s][t] > q[t]]
            for part, some, most in (("pair", pairs, None), ("term", terms, top)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(some[:most])]
    return sorted(out)


def make(n, sources, r):
    words = ["Alpha", "alpha", "été", "ÉTÉ", "x1y", "日本", "be-ta", "gamma", "the", "The"] + [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    return [(i, " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["en", "en", "de", None]), f"s{r.randint(0, sources)}", "t", 1, 2) for i in range(n)]


@pytest.mark.parametrize("terms, block", [(512, 256), (7, 3), (1, 1)])
def test_divergence(spark, monkeypatch, terms, block):
    r = random.Random(5)
    rows = make(300, 8, r)
    rows += [(1, None, "en", "empty", "t", 1, 2), (2, "word", "fr", None, "t", 1, 2), (2, "word", "fr", "one", "t", 1, 2), (3, "", "it", "alone", "t", 1, 2), rows[0], rows[0], (None, "the " * 200_000, "en", "s1", "t", 1, 2)]
    for name, v in (("TERMS", terms), ("GROUPS", block), ("ENTRIES", 50), ("PIECE", 1000)):
        monkeypatch.setattr(divergence, name, v)
    got = divergence.divergence(spark.createDataFrame(rows, DOCS).repartition(4))
    assert sorted(tuple(x) for x in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows)


def test_no_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_of_counts_beyond_the_product():
    count, total = np.array([[10**15, 7, 123_456_789_012_345]]), np.array([[3 * 10**15 + 1]])
    assert divergence.shares(count, total).tolist() == [[1 + 10**9 * int(c) // int(total[0, 0]) for c in count[0]]]
