"""The ten operators against brute force, and their hard cases: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import ann, common, langid, mixing, packing, sharding, simhash, sketch, substring, warc, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, label string"
rng = random.Random(7)


def word():
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))


def prose(n):
    return " ".join(word() for _ in range(n))


def make_docs():
    base = [prose(rng.randint(60, 300)) for _ in range(30)]
    passage = prose(70)
    texts = base + base[:5] + [t.replace(" ", "  ", 1) for t in base[5:8]] + [b + "\n" + passage for b in base[8:12]] + [passage + " " + prose(20), passage[3:]]
    texts += [base[0] + " tail", None, "", "  \t\n", "one", "Two words", "　가나 다", "é" * 40, prose(20_000), "123 456 !!", "x " * 500, "x " * 200]
    rows = [(3 * i + 1, t, "en" if i % 3 else "fr", "s", None, "k", 1, "l") for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, "no id here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def components(ids, near):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and near(i, j):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- common


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (5, 5), (7, None)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and got[249] == 200 and len(got) == 94
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stored_tables_are_deleted(spark):
    import os

    a, b = (common.stored(spark.range(3)) for _ in range(2))
    paths = [x._stored_at.removeprefix("file://") for x in (a, b)]
    assert a.count() == 3 and all(map(os.path.isdir, paths))
    common.drop(a)
    assert [os.path.isdir(p) for p in paths] == [False, True]
    common.clean()
    assert not os.path.isdir(paths[1])


# --- 1


def vectors():
    g = np.random.default_rng(3)
    v = g.normal(size=(300, 16))
    v[10:40] = v[9]
    v[40:60] = v[8] + g.normal(size=(20, 16)) * 0.01
    rows = [(i, x.tolist(), 1, "v") for i, x in enumerate(v)]
    rows += [(300, None, 1, "v"), (350, [0.0] * 16, 1, "v"), (301, [float("nan")] + [1.0] * 15, 1, "v"), (302, [None] + [1.0] * 15, 1, "v"), (303, [float("inf")] + [1.0] * 15, 1, "v"), (304, [], 1, "v"), (None, v[0].tolist(), 1, "v"), (50, v[50].tolist(), 1, "v")]
    return rows


def test_ann_small_is_exact(spark):
    rows = [r for r in vectors() if r[0] is None or r[0] >= 280 or r[0] < 40]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cid int, v string")
    got = {}
    for r in ann.nearest(df, F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ok = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in rows if r[0] is not None and r[0] < 300}
    assert set(got) == {i for i in ok if i % 10 == 0}
    for q, found in got.items():
        want = sorted(((-round(float(ok[q] @ ok[i]), 9), i) for i in ok if i != q))[:5]
        assert [x[1] for x in sorted(found)] == [i for _, i in want] and [x[0] for x in sorted(found)] == [1, 2, 3, 4, 5]


def test_ann_recall(spark):
    g = np.random.default_rng(5)
    v = g.normal(size=(3000, 32))
    v[:600] = v[0] + g.normal(size=(600, 32)) * 0.05
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("id") % 50 == 0).collect()
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert hits / (5 * 60) >= 0.9 and len(found) == 300


def test_ann_hot_file_and_repeated_ids(spark):
    """A third of the vectors in one dense cluster, whose files are split into blocks; ids with two vectors give one, always the same."""
    g = np.random.default_rng(6)
    v = g.normal(size=(900, 16))
    v[:300] = v[0] + g.normal(size=(300, 16)) * 0.05
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(7, v[500].tolist()), (9, v[600].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    runs = [sorted(map(tuple, ann.nearest(x, F.col("id") % 50 == 0, block=100).collect())) for x in (df.repartition(3), df.repartition(7))]
    assert runs[0] == runs[1] and len(runs[0]) == 90
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = u @ u[q]
        s[[q, 7, 9]] = -9
        found = [r for r in runs[0] if r[0] == q]
        assert len({r[2] for r in found}) == 5 and q not in {r[2] for r in found}
        hits += len(set(np.argsort(-s)[:5].tolist()) & {r[2] for r in found})
    assert hits >= 0.9 * 90


def test_pivots_are_drawn_without_one_task(spark):
    classes = spark.createDataFrame([(i, [float(i), 1.0], 2) for i in range(2000)] + [(5000, [1.0], 1)], "cid long, v array<double>, dim int")
    out = ann.drawn(classes, 2, 1024)
    want = [r.cid for r in classes.filter("dim = 2").orderBy(F.xxhash64("v"), "cid").collect()][:1024]
    assert [r.cid for r in out.collect()] == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" in plan and "Window" not in plan


def test_ann_few_and_none(spark):
    s = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], s), F.col("id") % 50 == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], s), F.col("id") % 50 == 0).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 2.0, 3.0])], s), F.col("id") % 50 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 1.0)]


# --- 2


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="x"><header><a>Logo</a></header>
<nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h1>Head {n}</h1></header><!-- c --><p>First &amp; <b>bold{n}</b>&nbsp;text<br>more
<p>Second <i>para {n}</i><script>x()</script><div class="ad">Buy</div><p>Follow our channel for news</p><section class="comments"><p>Nice!</p></section><form><input value=1>Name</form></article></main><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_wrapper(spark):
    pages = [(i, f"https://h.example/{i}", PAGE.format(n=i), "t", "h") for i in range(12)]
    odd = [(100, None, None, "t", "h"), (101, "x", "", "t", "h"), (102, "http://a/b", "<p>lone & plain", "t", "h"), (103, "http://a/b", "<div>" * 3000 + "deep" + "</div>" * 3000, "t", "h"), (104, "http://b", "a<br/>b<p>c</span>d<hr>e", "t", "h"), (0, pages[0][1], pages[0][2], "t", "h")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string, text string, host string")
    rows = wrapper.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 18 and all(r.n_chars == len(r.text) for r in rows)
    assert got[5] == "Head 5\nFirst & bold5 text more\nSecond para 5"
    assert (got[100], got[101], got[102], got[103], got[104]) == ("", "", "lone & plain", "deep", "a b\ncd\ne")
    assert wrapper.extract(df.limit(0)).count() == 0


def test_simple_tree_matching():
    def best(a, b):
        if isinstance(a, int) or isinstance(b, int):
            return int(isinstance(a, int) and isinstance(b, int))
        if a[0] != b[0]:
            return 0
        m = [[0] * len(b) for _ in a]
        for i in range(1, len(a)):
            for j in range(1, len(b)):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + best(a[i], b[j]))
        return m[-1][-1] + 1

    r = random.Random(2)

    def tree(d):
        return [r.choice("ab"), *(r.choice([1, 2]) if d == 0 or r.random() < 0.3 else tree(d - 1) for _ in range(r.randint(0, 4)))]

    for _ in range(200):
        a, b = tree(3), tree(3)
        m = wrapper.Matcher()
        assert m.score(m.shape(a), m.shape(b)) == best(a, b)


def test_wrapper_finds_template_in_any_element():
    trees = [["#region", ["div.", ["p.", 1], ["p.", 100 + i]], ["p.", 7]] for i in range(9)]
    found = wrapper.wrap(trees)
    assert {t for t, n, of in found if n == of == 9} == {wrapper.slot("/div./p./#", 1), wrapper.slot("/p./#", 7)}


def test_template_behind_varying_siblings_at_any_host_size(spark):
    def page(host, i):
        blocks = "".join(f"<div>own {host} {i} {k}</div>" for k in range(2 + i * 7 % 11))
        return f'<body class="post-{i}">{blocks}<div>same on each page</div><article class="share-prices"><p>short {i}</article><article>' + "".join(f"<p>para {i} {k}" for k in range(1 + i % 5)) + "<p>the last words</article></body>"

    for n in (20, 700):
        rows = [(i, f"https://h{n}.example/{i}", page(n, i)) for i in range(n)]
        got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        for i in range(n):
            want = [f"own {n} {i} {k}" for k in range(2 + i * 7 % 11)] + [f"short {i}"] + [f"para {i} {k}" for k in range(1 + i % 5)]
            assert got[i].split("\n") == want


def test_induction_without_hints_over_many_hosts(spark):
    """Tags, roles and classes are switched off: alignment finds what repeats, the region what varies around the content."""
    r = random.Random(11)
    blocks = {"n": 0, "gone": 0}

    def page(host, i):
        menu = "".join(f"<li><a href=x>{word()}</a>" for _ in range(3 + i % 4))
        body = [prose(30 + 7 * (i % 5)) for _ in range(2 + i % 4)]
        legal = f"All rights of {host} are reserved"
        html = f"<body><div id=a><ul>{menu}</ul></div><div class=x1><p>{prose(6)}</p></div><div class=x2><h1>Title {host} {i}</h1>" + "".join(f"<p>{p}</p>" for p in body) + f"<p>Write to {host}</p></div><div class=x3>{legal}</div><div class=x4>{prose(4)}</div></body>"
        blocks["n"] += 3 + i % 4 + 1 + len(body) + 2 + 2
        blocks["gone"] += 3 + i % 4 + 1 + 1 + 2
        return html, "\n".join([f"Title {host} {i}", *body])

    rows, want = [], {}
    for h in range(12):
        for i in range((5, 30, 150)[h % 3]):
            html, text = page(f"h{h}", i)
            want[len(rows)] = text
            rows.append((len(rows), f"http://h{h}.example/{i}", html))
    r.shuffle(rows)
    got = {x.page_id: x.text for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), hints=False).collect()}
    assert got == want and blocks["gone"] > blocks["n"] / 3


def test_equal_text_at_another_path_stays(spark):
    rows = [(i, f"http://h/{i}", f"<body><div class=bar>Follow us</div><article><h1>T {i}</h1><p>{prose(30)}</p><p>{'Follow us' if i == 3 else prose(5)}</p></article></body>") for i in range(20)]
    got = {x.page_id: x.text for x in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].endswith("\nFollow us") and sum("Follow us" in t for t in got.values()) == 1


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a x='", "</p>", "<i></b>", "<b><div>", "<!", "<![CDATA[", "a<", "&amp", "<script>", "<li><p>"])
def test_long_broken_pages_are_read_once(piece):
    import time

    began = time.perf_counter()
    wrapper.page_tree("<p>start" + piece * 60_000)
    assert time.perf_counter() - began < 10


def test_many_children_align_by_equal_subtrees(monkeypatch):
    monkeypatch.setattr(wrapper, "LONG", 50)
    trees = [["#region", ["div.", *range(1000 * i + 1000, 1000 * i + 1012), 7, *range(1000 * i + 1500, 1000 * i + 1510 + i)]] for i in range(6)]
    assert {t for t, n, of in wrapper.wrap(trees) if n == 6} == {wrapper.slot("/div./#", 7)}


# --- 3


def shingle_bits(text, n=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(ROWS)
    fp = {r[0]: shingle_bits(r[1]) for r in ROWS if r[0] is not None}
    want = components(sorted(fp), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fp[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *want.values()}


def test_links_at_any_bits_and_in_dense_groups(spark, monkeypatch):
    r = random.Random(4)
    centre = r.getrandbits(64)
    near = {centre ^ sum(1 << b for b in r.sample(range(12), k)) for k in (0, 1, 2, 3, 4) for _ in range(120)}
    apart = [r.getrandbits(64) for _ in range(300)]
    chain = [apart[0]]
    for _ in range(12):
        chain.append(chain[-1] ^ sum(1 << b for b in r.sample(range(64), 3)))
    fps = list(dict.fromkeys([*near, *apart, *chain, 0, (1 << 64) - 1, 7, 1 << 63]))
    r.shuffle(fps)
    monkeypatch.setattr(simhash, "TILE", 40)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "id long, fp long")
    got = {x.id: x.component for x in simhash.near_components(df).collect()}
    a = np.array(fps, np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    assert got == components(range(len(fps)), lambda i, j: d[i, j])


# --- 4


def test_sketch(spark, docs, empty):
    rows = sketch.edit_report(docs, n_parts=7).collect()
    assert len(rows) == len(ROWS)
    fps = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = sorted(((r[0], r[1] or "") for r in ROWS if r[0] is not None), key=lambda x: -x[0])
    ids = [i for i, _ in texts]
    unique = [x for i, x in enumerate(texts) if ids.count(x[0]) == 1]
    got = {r.doc_id: r for r in rows}
    for (i, t), (_, following) in zip(texts, texts[1:]):
        if (i, t) in unique:
            e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
            assert got[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and got[i].n_chars == len(t)
            assert got[i].edited_fingerprint == sketch.encode(sketch.sketches([e.encode()])[0])
            assert fps.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    assert sketch.edit_report(empty).count() == 0
    one = sketch.edit_report(spark.createDataFrame([(1, "abcd ef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()
    assert {r.fingerprint for r in sketch.document_sketches(docs).filter("id is null").collect()} >= {""}


def test_sketch_estimates():
    r = random.Random(1)
    words = [f"w{i}" for i in range(12_000)]
    a, b = words[:8000], words[4000:]
    sa, sb = sketch.sketches([" ".join(a).encode(), " ".join(b).encode()])
    assert abs(sketch.likeness(sa, sb) - 1 / 3) < 0.08
    small = sketch.sketches([" ".join(a[100:400]).encode()])[0]
    assert sketch.containment(small, sa) > 0.95 and sketch.containment(sa, small) < 0.15
    both = sketch.sketches([" ".join(a).encode() + b" " + " ".join(r.sample(words, 10)).encode()])[0]
    assert set(both.tolist()) <= set(sketch.merge(both, sa).tolist())
    assert (sketch.decode(sketch.encode(sa)) == sa).all() and sketch.likeness(sa, sa) == 1.0


# --- 5


def test_sharding(spark, docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(ROWS) and {r.law for r in rows} == {"key"}
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    text = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for r in rows:
        assert r.grown_shard in (r.shard, 16)
        if r.doc_id is not None:
            b = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
    assert sharding.shard_documents(empty).count() == 0


def _brute_shard(i, shards):
    key = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), 42)
    draw = {s.number: -np.log(((xxhash.xxh64_intdigest(s.number.to_bytes(4, "little"), key) >> 12) + 0.5) / 2**52) / s.weight for s in shards if s.weight}
    return min(draw, key=lambda n: (draw[n], n))


def test_hash_tree_moves_only_with_weights(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = [sharding.Shard(i, i // 8, i // 4, 1 + i % 3) for i in range(16)]
    heavier = [s if s.number != 5 else sharding.Shard(5, 0, 1, 9) for s in before]
    rows = sharding.place(sharding.place(ids, ["doc_id"], before, "a"), ["doc_id"], heavier, "b").collect()
    assert all(r.a == r.b or r.b == 5 for r in rows)
    assert all(r.a == _brute_shard(r.doc_id, before) for r in rows[:300])
    share = sum(r.a == 2 for r in rows) / 4000
    assert abs(share - 3 / sum(s.weight for s in before)) < 0.02


# --- 6


def test_mixing(spark):
    r = random.Random(9)
    topic = {"good": [word() for _ in range(80)], "poor": [word() for _ in range(80)], "toxic": [word() for _ in range(80)]}
    rows, labels = [], []
    for i in range(600):
        d = ("good", "good", "good", "poor", "toxic", "toxic")[i % 6]
        rows.append((i, " ".join(r.choice(topic[d]) for _ in range(60)), "x", 1))
        if i % 2:
            labels.append((i, int(d == "good"), int(d == "toxic")))
    rows += [(1000, None, "x", 1), (1001, "", "x", 1), (None, "a b", "x", 1), rows[0], rows[0]]
    labels += [(None, 1, 0), (5, None, None), (4, None, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, rate int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, lab, {"good": 0.6, "poor": 0.3, "toxic": 0.1}).collect()
    assert len(got) == len(rows) and all(x.rate >= 0 for x in got)
    total = sum(x.n_tokens for x in got)
    for d, share in (("good", 0.6), ("poor", 0.3), ("toxic", 0.1)):
        assert abs(sum(x.rate * x.n_tokens * x[f"p_{d}"] for x in got) / total - share) < 0.01
        assert abs(sum(x.copies * x.n_tokens * x[f"p_{d}"] for x in got) / total - share) < 0.06
    out = mixing.mixed(docs, lab)
    assert out.columns == docs.columns
    ids = [x.doc_id for x in out.collect()]
    assert all(i in ids for i in range(0, 600, 6)) and ids.count(3) >= 1
    assert mixing.mix(docs.limit(0), lab).count() == 0 and mixing.mix(docs, lab.limit(0)).count() == len(rows)


def test_mixing_of_a_very_long_text(spark):
    docs = spark.createDataFrame([(i, prose(30)) for i in range(40)] + [(99, prose(60_000))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in mixing.mix(docs, labels).collect()}
    assert len(got) == 41 and got[99].n_tokens == 60_000 and abs(got[99].p_good + got[99].p_poor + got[99].p_toxic - 1) < 1e-9


def test_rates_match_least_squares(spark):
    q = np.array([[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6], [1 / 3] * 3])
    t = np.array([100.0, 50.0, 30.0, 20.0])
    points = spark.createDataFrame([(float(t[i]), *map(float, q[i])) for i in range(4)], "tokens double, p_good double, p_poor double, p_toxic double")
    for target in ([120.0, 60.0, 20.0], [20.0, 20.0, 160.0], [198.0, 1.0, 1.0]):
        pull = mixing.solve(points, dict(zip(mixing.DOMAINS, target)))
        got = {round(x.p_good, 3): x.rate for x in points.withColumn("rate", mixing.rate(pull)).collect()}
        rate = np.ones(4)
        for _ in range(200_000):
            res = ((rate * t) @ q - target) / 200
            rate = np.maximum(0, rate - 0.9 * (q @ res + mixing.RIDGE * (rate - 1)))
        assert np.allclose([got[round(x, 3)] for x in q[:, 0]], rate, atol=1e-3)
    assert set(mixing.solve(points, dict.fromkeys(mixing.DOMAINS, 0.0)).values()) == {0.0}


def test_mixed_documents_meet_the_targets(spark):
    r = random.Random(2)
    topic = {d: [word() for _ in range(60)] for d in ("good", "poor", "toxic")}
    kind = lambda i: ("good", "good", "poor", "toxic")[i % 4]
    docs = spark.createDataFrame([(i, " ".join(r.choice(topic[kind(i)]) for _ in range(40 + i % 30))) for i in range(1200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(kind(i) == "good"), int(kind(i) == "toxic")) for i in range(0, 1200, 3)], "doc_id long, quality int, toxic int")
    out = mixing.mixed(docs, labels).collect()
    tokens: dict = {}
    for x in out:
        tokens[kind(x.doc_id)] = tokens.get(kind(x.doc_id), 0) + len(x.text.split())
    for d, share in mixing.SHARES.items():
        assert abs(tokens[d] / sum(tokens.values()) - share) < 0.02


def test_repeated_rows_come_as_often_as_their_copies_add_up_to(spark):
    r = random.Random(3)
    topic = {d: [word() for _ in range(60)] for d in ("good", "poor", "toxic")}
    kind = lambda i: ("good", "good", "poor", "toxic")[i % 4]
    rows = [(i, " ".join(r.choice(topic[kind(i)]) for _ in range(40)), "k") for i in range(400)]
    docs = spark.createDataFrame([x for x in rows for _ in range(8)], "doc_id long, text string, __k1 string").repartition(7)
    labels = spark.createDataFrame([(i, int(kind(i) == "good"), int(kind(i) == "toxic")) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    plan = mixing.mix(docs, labels, grow=True).collect()
    want: dict = {}
    for x in plan:
        want[x.doc_id] = want.get(x.doc_id, 0) + x.copies
    out = mixing.mixed(docs, labels)
    got = {x.doc_id: x["count"] for x in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and got == {k: n for k, n in want.items() if n}
    assert abs(sum(got.values()) / sum(x.rate for x in plan) - 1) < 0.02


# --- 7


@pytest.mark.parametrize("block", [2048, 7, 1])
def test_automaton_parses_as_brute_force(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(3)
    ref = "".join(r.choice("abc ") for _ in range(400))
    m = langid.Model({"x": ref, "y": "abcabc" * 10})
    for _ in range(50):
        t = "".join(r.choice("abcd") for _ in range(r.randint(1, 60)))
        sym = m.symbols([t])[0].tolist()
        known = m.symbols([ref])[0].tolist()
        hay = ",".join(map(str, known)) + ","
        n, i = 1, 0
        cur: list[int] = []
        for c in sym:
            if ("," + ",".join(map(str, cur + [c])) + ",") in "," + hay:
                cur.append(c)
            else:
                n, cur = n + 1, [c]
                if ("," + str(c) + ",") not in "," + hay:
                    cur = []
        assert m.phrases(["b", "", t, "abcabcabcabd" * 9], m.lookup())[0][2, 0] == n


def test_language(spark):
    r = random.Random(5)
    syllables = {"aa": ["ba", "ko", "ti", "mu"], "bb": ["éch", "ou", "ier", "la"], "cc": ["가", "나다", "라마", "바"]}
    say = lambda l, n: " ".join("".join(r.choice(syllables[l]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, say(l, r.randint(3, 80)), l, 1.0, "x") for i in range(120) for l in [("aa", "bb", "cc")[i % 3]]]
    rows += [(500, None, "aa", 1.0, "x"), (501, "", "aa", 1.0, "x"), (502, "123 !?", None, 1.0, "x"), (503, say("bb", 30_000), None, 1.0, "x"), (None, say("cc", 9), "cc", 1.0, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_score string")
    got = langid.predict(docs, langid.fit(docs.filter(~langid.held_out())), added=("p", "s")).withColumn("h", langid.held_out()).collect()
    assert len(got) == len(rows)
    assert all(x.p == x.lang for x in got if x.lang and x.text and x.h)
    assert {x.doc_id for x in got if x.p == "und"} == {500, 501, 502} and all(0 <= x.s <= 1 for x in got)
    assert [x.p for x in got if x.doc_id == 503] == ["bb"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert langid.keep_identified(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {x.lang_pred for x in langid.predict(unlabelled.drop("lang_score"), langid.fit(unlabelled)).collect()} == {"und"}


def test_language_with_many_letters_and_late_text(spark):
    r = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(900)]
    say = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))
    head = "same licence text " * 150
    own = {"p": han[:300], "q": han[300:600], "r": han[600:], "s": "бгджзл", "t": "αβγδεζ"}
    rows = [(i, head + say(own[l], 400), l) for i in range(150) for l in ["pqrst"[i % 5]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {c for t in own.values() for c in t} <= set(model.known)
    probes = spark.createDataFrame([(f"{l}{k}", say(own[l], 30), l) for l in own for k in range(6)], "doc_id string, text string, lang string")
    assert all(x.lang_pred == x.lang for x in langid.predict(probes, model).collect())
    assert langid.Model({"x": "\U00020001\U00020002" * 9, "y": "\U00020003\U00020004" * 9}).predict(["\U00020003\U00020004"], model.lookup())[0] == ["y"]


def test_pipeline_stages_follow_rates_and_keep_unlabelled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ab cd", None), (2, "12 !", None), (3, "ef", None)], "doc_id long, text string, lang string")
    assert {x.doc_id for x in langid.keep_identified(docs).collect()} == {1, 3}
    known = spark.createDataFrame([(i, "abab cdcd", "x") for i in range(40)] + [(99, "жзжз", None)], docs.schema)
    assert {x.doc_id for x in langid.keep_identified(known).collect()} == {*range(40), 99}
    plan = docs.select(*mixing._keys("doc_id", "text"), F.lit(0.6).alias("p_toxic"), (F.col("doc_id") - 1).cast("int").alias("copies"))
    monkeypatch.setattr(mixing, "mix", lambda *a, **k: plan)
    assert sorted(x.doc_id for x in mixing.mixed(docs, None).collect()) == [2, 3, 3]


# --- 8


def test_warc(spark):
    big = "<p>" + prose(200)
    pages = [(4, "http://a/1", big, "r"), (2, "http://a/2\r\nX: y", big, "r"), (9, None, big, "r"), (5, "", None, "r"), (6, "u", "", "r"), (7, "u", "é\r\n\r\nWARC/1.1", "r"), (8, "u", "é\r\n\r\nWARC/1.1", "r"), (None, "u", big, "r"), (2, "http://a/2", big, "r")]
    pages += [(100 + i, "u", f"{i} " + prose(400), "r") for i in range(200)] + [(500, "u", "long " * 300_000, "r")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type string").repartition(3)
    index = warc.write(df, frame=1 << 14)
    rows = warc.read(index).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    for page, _, text, _ in pages:
        assert (got[page].payload_bytes, got[page].payload_digest) == (len((text or "").encode()), sha(text))
        assert got[page].record_type == "revisit" or got[page].payload == (text or "")
    assert (got[None].record_type, got[None].refers_to) == ("revisit", 2)
    assert (got[4].record_type, got[4].refers_to, got[9].refers_to, got[2].record_type, got[2].refers_to) == ("revisit", 2, 2, "response", None)
    assert got[7].record_type == got[8].record_type == got[5].record_type == got[6].record_type == "response"
    one = warc.fetch(index.filter("page_id = 150")).first()
    assert one.payload == pages[9 + 50][2] and index.select("frame").distinct().count() > 3
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_seek_table_round_trip():
    frames = [(10, 20), (3, 7)]
    assert warc.read_seek_table(b"junk" + warc.seek_table(frames)) == frames
    with pytest.raises(ValueError):
        warc.read_seek_table(b"0" * 40)


# --- 9


def test_substrings(spark, docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    got = substring.dedup_substrings(docs).collect()
    assert len(got) == len(ROWS)
    want = substring.brute_force({r[0]: r[1] for r in rows})
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) == want[r.doc_id]
    assert substring.dedup_substrings(empty).count() == 0
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns and all(r.text is None or len(r.text) == r.n_chars or r.n_chars is None for r in out.collect())


@pytest.mark.parametrize("seed, limit", [(0, 1 << 19), (1, 1 << 19), (2, 60), (3, 60), (4, 0)])
def test_substrings_of_few_words(spark, seed, limit):
    """A tiny vocabulary, so that periods, overlaps and chance repeats abound; small limits lead to longer prefixes."""
    r = random.Random(seed)
    words = ["a", "b", "cc"][: 2 + seed % 2]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 60))) for i in range(60)}
    texts |= {100: "a " * 300, 101: "a b " * 200, 102: "b " + "a " * 120, 103: texts[3], 104: texts[3] + " " + texts[4]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in substring.dedup_substrings(df, window=12, prefix=5, limit=limit).collect()}
    assert got == substring.brute_force(texts, 12)


def test_words_that_defeat_polynomial_hashes_stay_apart(spark):
    """Two words of 1,024 bytes whose polynomials modulo 2**64 are equal for any odd base, and runs of words alike."""
    s = [0]
    while len(s) < 1024:
        s += [1 - x for x in s]
    one, two = ("".join("ab"[x ^ k] for x in s) for k in (0, 1))
    rows = [(k, " ".join(["w"] * 25 + [x] + ["w"] * 24)) for k, x in ((1, one), (2, two))]
    rows += [(k + 2, " ".join(x)) for k, x in ((1, one), (2, two))] + [(9, rows[1][1])]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (n, gone) for d, (n, gone, _) in substring.brute_force(dict(rows)).items()}
    assert (got[1], got[2], got[9]) == ((50, 0), (50, 0), (50, 50))


def test_substrings_when_every_hash_collides(spark, monkeypatch):
    """Only words decide: with labels that are all the same the result is too."""
    texts = {1: prose(80), 2: prose(70)}
    texts |= {3: texts[1], 4: texts[2] + " end", 5: prose(60), 6: None, 7: "short"}
    rows = [(k, v) for k, v in texts.items()]
    whole = substring.Edges.__init__

    def same(self, w, window, k, open):
        whole(self, w, window, k, open)
        self.group, self.label = self.group * np.uint64(0), self.label * np.uint64(0) + self.count.astype(np.uint64)

    monkeypatch.setattr(substring.Edges, "__init__", same)
    got = {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept.encode()).hexdigest()) for x in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == substring.brute_force(texts)


def test_clashing_names(spark):
    """Columns with the names that the operators use inside or add: inner ones stay as they are, added ones are replaced."""
    own = ["__id", "__k1", "__k2", "__marks", "__open", "__gone", "__times", "__nth", "__lang", "__score", "__n_words", "__n_removed", "__kept"]
    texts = [prose(60)] * 2 + [prose(70), "12 3", None]
    rows = [(i, t, "en", *["mine"] * (len(own) + 3)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, lang_pred string, copies string, " + ", ".join(f"{c} string" for c in own))
    got = substring.dedup_substrings(df)
    assert got.columns == [*(c for c in df.columns if c != "n_words"), "n_words", "n_removed", "kept"]
    assert {(r.doc_id, r.n_removed, r["__marks"]) for r in got.collect()} == {(0, 0, "mine"), (1, 60, "mine"), (2, 0, "mine"), (3, 0, "mine"), (4, 0, "mine")}
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for stage, ids in ((langid.keep_identified, {0, 1, 2}), (simhash.keep_one, {0, 2, 3, 4}), (substring.without_repeats, {0, 2, 3, 4}), (lambda d: mixing.mixed(d, labels), None)):
        out = stage(df)
        kept = out.collect()
        assert out.columns == df.columns and all(r[c] == "mine" for r in kept for c in [*own, "lang_pred", "copies"]) and ids in (None, {r.doc_id for r in kept})
    assert langid.predict(df, langid.fit(df)).columns.count("lang_pred") == 1
    assert simhash.simhash_components(df).count() == sketch.edit_report(df).count() == sharding.shard_documents(df).count() == 5


# --- 10


def test_packing(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    files = packing.default_files()
    enc = tokenizers.Tokenizer.from_file(files[0])
    texts = {r[0]: (r[1] or "") + ("<|endoftext|> it's  1234" if r[0] == 1 else "") for r in ROWS if r[0] is not None}
    df = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit("<|endoftext|> it's  1234"))).otherwise(F.col("text")))
    rows = packing.pack_documents(df).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {None, *texts}
    for doc, text in texts.items():
        ids = np.array([*enc.encode(text, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(by[doc], key=lambda r: r.piece)
        if doc == 1:  # three equal rows
            mine = mine[::3]
        at = 0
        for r in mine:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    check_places(rows)
    assert packing.pack_documents(empty).count() == 0


def test_packing_of_long_runs(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "x" * 300_000), (2, " " * 5000), (3, "\n".join(["a"] * 4000))], "doc_id long, text string")).collect()
    enc = pytest.importorskip("tokenizers").Tokenizer.from_file(packing.default_files()[0])
    for doc, text in ((1, "x" * 300_000), (2, " " * 5000), (3, "\n".join(["a"] * 4000))):
        assert sum(r.length for r in rows if r.doc_id == doc) == len(enc.encode(text, add_special_tokens=False).ids) + 1
    check_places(rows)


def check_places(rows):
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_plan_is_best_fit_decreasing():
    r = random.Random(8)
    for capacity in (10, 64, 1024):
        counts = {n: r.randint(1, 40) for n in r.sample(range(1, capacity + 1), min(capacity, 30))}
        left: list[int] = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fit = min((x for x in left if x >= n), default=None)
                if fit is None:
                    left.append(capacity - n)
                else:
                    left[left.index(fit)] = fit - n
        steps = packing.plan(counts, capacity)
        used: dict[int, int] = {}
        placed: dict[int, int] = {}
        for length, rank, first, bins, each, offset in steps:
            assert placed.get(length, 0) == rank
            placed[length] = rank + bins * each
            for b in range(first, first + bins):
                assert used.get(b, 0) == offset
                used[b] = offset + each * length
        assert placed == counts and sorted(capacity - x for x in used.values()) == sorted(left)


def test_trees_serialise():
    t = wrapper.page_tree(PAGE.format(n=1))
    assert json.loads(json.dumps(wrapper.serialise(t))) == wrapper.serialise(t)
