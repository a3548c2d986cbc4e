"""Every query of the catalog against its SQL on DuckDB, over the whole tables."""

import math
import os

import duckdb
import pytest

from tidewater.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {c: kinds[c] for c, t in got.dtypes if t in ("int", "bigint", "double", "boolean")} == {c: {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}[t] for c, t in got.dtypes if t in ("int", "bigint", "double", "boolean")}
    assert rows(names, cur.fetchall()) == rows(got.columns, [tuple(r) for r in got.collect()])


def test_every_query_has_sql_but_texts_of_formatted_numbers():
    assert set(QUERIES) - set(ORACLES) == {"report_lines", "report_texts", "card_of_documents"}


def test_cards_of_all_documents_fit(spark):
    rows = QUERIES["card_of_documents"](spark, DIR).collect()
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count() and all(r.fits or r.tables for r in rows)


def test_whole_reports(spark):
    from tidewater.plans import catalog

    heads, lines = {}, {}
    for r in QUERIES["report_heads"](spark, DIR).orderBy("place", "nth").collect():
        heads.setdefault(r.place, []).append(r.line)
    rows, _ = catalog._reported(spark, DIR)
    for r in catalog.indicators.report_lines(rows, 1, "province").orderBy("place", "nth").collect():
        lines.setdefault(r.place, {}).setdefault(r.list, []).append(r.line)
    got = {r.place: r.text for r in QUERIES["report_texts"](spark, DIR).collect()}
    assert set(got) == set(heads) and lines
    for place, text in got.items():
        own = lines.get(place, {})
        at = text.index("\n".join(heads[place]))
        for name in ("high", "low", "outside"):
            for line in own.get(name, []):
                at = text.index(line, at)
        assert not own.get("inside") or "- " + ", ".join(own["inside"]) in text
        assert ("판단을 미룬다" in text) == (not own.get("high") or not own.get("low")) and text.count("○ 종합 진단") == text.count("※ 자료") == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
