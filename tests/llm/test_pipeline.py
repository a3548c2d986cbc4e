"""The pipeline's stages in turn against brute force, and the queries with SQL against DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from tidewater.llm import mixing, simhash, substring
from tidewater.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["language ID", "near copies", "repeated passages", "mixing", "packing"]
    identified = stages["language ID"](spark, docs, DIR).cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in identified.collect()} == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}

    kept = stages["near copies"](spark, identified, DIR).cache()
    rows = identified.collect()
    fp = np.array([simhash.fingerprint(r.text.encode()) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.array([r.doc_id for r in rows])
    while True:
        new = np.where(near, label[None, :], 1 << 60).min(1)
        if (new == label).all():
            break
        label = new
    assert {r.doc_id for r in kept.collect()} == set(label.tolist())

    cut = stages["repeated passages"](spark, kept, DIR).cache()
    want = substring.brute_force({r.doc_id: r.text for r in kept.collect()})
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == {i for i, (n, gone, _) in want.items() if n > gone or n == 0}
    assert all(len(got[i].text.split()) == want[i][0] - want[i][1] for i in got if want[i][1])
    assert all(got[i].text == before[i] for i in got if not want[i][1])

    mixed = stages["mixing"](spark, cut, DIR).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(got)
    # the rates meet the targets in expectation, and the drawn copies come close
    found = mixing.mix(cut, spark.read.parquet(f"{DIR}/labels.parquet"), grow=True).collect()
    for times, near in ((lambda x: x.rate, 0.003), (lambda x: x.copies, 0.02)):
        total = sum(times(x) * x.n_tokens for x in found)
        for d, share in mixing.SHARES.items():
            assert abs(sum(times(x) * x.n_tokens * x[f"p_{d}"] for x in found) / total - share) < near
    copies = {x.doc_id: x.copies for x in found}
    assert {k: n for k, n in copies.items() if n} == {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}

    packed = stages["packing"](spark, mixed, DIR).collect()
    assert sum(r.piece == 0 for r in packed) == mixed.count()
    left: list[int] = []
    for n in sorted((r.length for r in packed), reverse=True):
        fit = min((x for x in left if x >= n), default=None)
        if fit is None:
            left.append(1024 - n)
        else:
            left[left.index(fit)] = fit - n
    assert len({r.sequence_id for r in packed}) == len(left)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = c.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    got = QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
