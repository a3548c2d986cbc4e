"""Small cases with known results."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.functions import numbers, text
from tidewater.operators import cards, indicators, ledger, outline, tables, tree
from tidewater.session import shared_dir
from tidewater.sources import attachments, series

# Published sample quantiles and means.
GOLD = {
    (1.0, 2.0, 3.0, 4.0): (1.75, 3.25, 2.5),
    (0.5, 1.25, 3.5, 7.0, 9.0, 11.5): (1.8125, 8.5, 5.458333333333333),
    (-4.0, -1.0, 0.0, 2.0, 8.0, 13.0, 21.0): (-0.5, 10.5, 5.571428571428571),
    (5.0,): (5.0, 5.0, 5.0),
    (2.0,) * 5: (2.0, 2.0, 2.0),
}


def test_gold_quartiles(spark):
    data = [(i, v) for i, vs in enumerate(GOLD) for v in vs]
    got = {r.k: (r.q1, r.q3, r.avg) for r in indicators.box_stats(spark.createDataFrame(data, "k int, value double"), "k").collect()}
    for i, want in enumerate(GOLD.values()):
        assert got[i] == pytest.approx(want, rel=1e-12)


def test_untyped_place_has_no_type_group(spark):
    places = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", None)], "place int, province string, type int")
    values = spark.createDataFrame([("x", 2020, 1, 5.0), ("x", 2020, 2, 5.0), ("x", 2021, 1, None), ("x", 2021, 3, 7.0)], "code string, year int, place int, value double")
    assert {r.place for r in indicators.peers(places, "type").collect()} == {1, 2}
    got = {r.place: r for r in indicators.analyze(values, places, "province").collect()}
    assert (got[1].year, got[1].mine, got[1].rank, got[2].rank, got[1].n) == (2020, 5.0, 1, 1, 2)
    assert got[3].year == 2021 and got[3].peer_avg is None and got[3].n == 1
    with pytest.raises(ValueError):
        indicators.analyze(values, places, "planet")


def test_trend_needs_four_members_for_quartiles(spark):
    places = spark.createDataFrame([(i, "a" if i else "z", 1) for i in range(5)], "place int, province string, type int")
    own = [10.0, 12.0, None, 16.0]
    values = [("x", 2018 + j, 0, own[j]) for j in range(4)] + [("x", 2018 + j, i, float(i + 2 * j)) for i in range(1, 5) for j in range(4)]
    rows = indicators.trend(spark.createDataFrame(values, "code string, year int, place int, value double"), places, "province").filter("place = 1").orderBy("year").collect()
    assert [r.avg for r in rows] == [2.5, 4.5, 6.5, 8.5] and (rows[0].q1, rows[0].q3, rows[0].n) == (1.75, 3.25, 4)
    assert indicators.trend(spark.createDataFrame(values, "code string, year int, place int, value double"), places, "province").filter("place = 0 and q1 is not null").count() == 0


@pytest.mark.parametrize("n, want", [(22, [11, 11]), (12, [12]), (1, [1]), (13, [7, 6]), (25, [9, 9, 7])])
def test_chunks(spark, n, want):
    rows = indicators.chunks(spark.range(n).withColumn("k", F.lit(1)), ["id"], 12, "k")
    assert [r["count"] for r in rows.groupBy("chunk").count().orderBy("chunk").collect()] == want


def test_tree(spark):
    nodes = [("02", None, "B", 5), ("01", None, "A", 0), ("01-b", "01", "y", 4), ("01-a", "01", "x", 1), ("01-a-1", "01-a", "q", 2)]
    df = spark.createDataFrame(nodes, "id string, parent string, title string, ord int")
    assert [r.id for r in tree.preorder(df).orderBy("pos").collect()] == ["01", "01-a", "01-a-1", "01-b", "02"]
    assert tree.trails(df).filter("id = '01-a-1'").first().trail == "A › x › q"
    shares = tree.column_shares(spark.createDataFrame([(1, i, 1) for i in range(3)], "k int, i int, w int"), ["k"], "w", "i")
    assert [r.pct for r in shares.orderBy("i").collect()] == [34, 33, 33]


def test_nearest_example_of_a_hot_shape(spark):
    rows = [(i, "s", i * 7919 % 3001, i % 9 > 0) for i in range(3000)] + [(5000, "t", 4, True), (5001, None, 4, True), (5002, "s", None, True), (5003, "s", 8, False), (5004, "s", 8, False)]
    df = spark.createDataFrame(rows, "id long, shape string, ord int, blank boolean")
    out = tree.nearest_example(df.filter("blank"), df.filter("not blank"), ["shape"])
    assert "BroadcastNestedLoop" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "abs(" not in plan
    examples = [(o, i) for i, s, o, blank in rows if not blank]
    for i, e in out.collect():
        o = next(o for k, _, o, _ in rows if k == i)
        assert e == (None if i >= 5000 else min(examples, key=lambda x: (abs(x[0] - o), x))[1])
    assert out.count() == sum(r[3] for r in rows)


def test_outline_and_limits(spark):
    doc = "# Plan\n## Goals\n- a\n- b\n- c\n※ note\n## Table\n| h |\n|---|\n| 1 |\n| 2 |\n\ntext\n## None"
    m = outline.lines(spark.createDataFrame([(1, doc), (2, None)], "d int, t string"), "d", "t")
    assert [r.kind for r in m.filter("d = 1").orderBy("ln").collect()] == ["item", "item", "item", "item", "item", "note", "item", "table", "sep", "table", "table", "blank", "text", "item"]
    n = {r.ln: r.n for r in outline.count_under(m, "d").collect()}
    assert (n[0], n[1], n[6], n[13]) == (3, 3, 2, None)
    limits = [("Goals", "max", 2), ("Table", "min", 1), ("None", "max", 9), ("zz", "max", 1)]
    limits = spark.createDataFrame([(d, *x) for d in (1, 2) for x in limits], "d int, scope string, op string, n int")
    got = {(r.d, r.scope): r.verdict for r in outline.check_limits(m, limits, "d").collect()}
    assert [got[1, s] for s in ("Goals", "Table", "None", "zz")] == ["over", "ok", "empty", "missing"] and got[2, "Goals"] == "missing"


def test_lines_by_kind(spark):
    said = ["a | b", "---", "○x", "○ x", "○", "주) y", "자료: z", "| a", "|--|", "|:-─|", "##", "## t", "- ", "-x", "", " ※ n"]
    df = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = [r.k for r in df.select("i", text.line_kind(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == ["text", "text", "text", "item", "item", "note", "note", "table", "sep", "sep", "text", "item", "item", "text", "blank", "note"]


def test_model_order(spark):
    names = ["x-pro", "m-2.0-flash", "m-1.5-flash-lite", "m-2.5-flash", "m-2.5-flash-lite", "a-pro", "m-3.0-flash-exp", "models/m-2.0-flash-lite", "b/../c"]
    df = spark.createDataFrame([(1, n, i) for i, n in enumerate(names)], "k int, name string, i int")
    got = [r.name for r in ledger.ordered_models(df, ["k"], "name", "i").orderBy("nth").collect()]
    assert got == ["m-2.5-flash-lite", "m-2.0-flash-lite", "m-1.5-flash-lite", "m-2.5-flash", "m-2.0-flash", "x-pro", "a-pro"]
    assert ledger.default_model(df, ["k"], "name", "i").first().name == "m-2.5-flash-lite"


def test_few_rankable_codes_are_halved(spark):
    ranks = {"a": (1, 5), "b": (2, 100), "c": (50, 100), "d": (5, 5), "e": (1, 4)}
    rows = [(1, c, 1.0, r, n, None, None) for c, (r, n) in ranks.items()]
    df = spark.createDataFrame(rows, "place int, code string, mine double, rank int, n int, q1 double, q3 double")
    got = {(r.code, r.list) for r in indicators.top_bottom(df, 3).collect()}
    assert got == {("b", "top"), ("a", "top"), ("c", "bottom"), ("d", "bottom")}  # 2 of 100 is before 1 of 5, and four members are too few
    lists = {r.code: (r.list, r.nth) for r in indicators.listed(df, 1).collect()}
    assert lists == {"b": ("high", 1), "d": ("low", 1), "a": ("inside", 1), "c": ("inside", 2)}


def test_analyze_one_place(spark):
    places = spark.createDataFrame([(1, "a", 1, "시군구"), (2, "a", None, "시군구"), (3, "a", 1, "시도")], "place int, province string, type int, level string")
    values = spark.createDataFrame([("x", 2020, 1, 5.0), ("x", 2020, 2, float("nan")), ("x", 2021, 3, 7.0)], "code string, year int, place int, value double")
    items = spark.createDataFrame([("x", "name", None, None, None)], "code string, name string, unit string, area string, area_name string")
    r = indicators.analyze_place(values, places, items, 1, "province", ["y", "x"]).first()
    assert (r.ord, r.year, r.mine, r["rank"], r.n, r.name, r.unit, r.nation_n) == (1, 2020, 5.0, 1, 1, "name", "", 1)
    assert indicators.analyze_place(values, places, items, 1, "province", ["x"], "2021").count() == 0
    for bad in ((9, "province", ["x"], None), (3, "province", ["x"], None), (2, "type", ["x"], None), (1, "province", ["x"], "soon")):
        with pytest.raises(ValueError):
            indicators.analyze_place(values, places, items, *bad)


def test_limits_in_a_text(spark):
    said = "전략 계획을 쓰되 추진전략은 3개\n이내, 전략 2건 이상으로 하고 4명 이하. 추진전략 3개 이내. 있는 5개 이내"
    got = [(r.i, r.text, r.scope, r.op, r.n, r.unit) for r in outline.find_limits(spark.createDataFrame([(1, said), (2, None)], "k int, t string"), "k", "t").orderBy("i").collect()]
    assert got == [(0, "추진전략은 3개 이내", "추진전략", "max", 3, "개"), (1, "전략 2건 이상", "전략", "min", 2, "건"), (2, "전략 2건 이상으로 하고 4명 이하", "전략", "max", 4, "명"), (3, "추진전략 3개 이내. 있는 5개 이내", "추진전략", "max", 5, "개")]


def test_numbers_with_their_units(spark):
    r = spark.range(1).select(text.number_tokens(F.lit("1,200 억원, 30%와 30 %, 2.5회 7 x 3개소")).alias("n")).first()
    assert r.n == ["1,200억원", "30%", "2.5회", "3개소"]


def test_deep_trees_orphans_and_circles(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "t", i) for i in range(300)]
    odd = [("o", "nobody", "t", -5), ("o1", "o", "t", 2_000_000), ("o2", "o", "t", 1_000_000), ("c1", "c2", "t", 3), ("c2", "c1", "t", 4), ("c3", "c3", "t", 5), ("below", "c1", "t", 6), ("first", None, "t", -1)]
    df = spark.createDataFrame(chain + odd, "id string, parent string, title string, ord long")
    pos = {r.id: r.pos for r in tree.preorder(df).collect()}
    order = sorted(pos, key=pos.get)
    assert sorted(pos.values()) == list(range(1, 309)) and order == ["first", *[f"n{i}" for i in range(300)], "o", "o2", "o1", "c1", "c2", "c3", "below"]
    assert tree.trails(df).filter("id = 'n299'").first().depth == 299
    assert {(r.id, r.problem) for r in tree.catalog_problems(df).collect()} == {("o", "unknown parent"), *((c, "cycle") for c in ("c1", "c2", "c3", "below"))}


def test_ended_paths_are_joined_no_more(spark, monkeypatch):
    rounds = []

    def cut(df):
        out = df.checkpoint(eager=True)
        rounds.append(out.count())
        return out

    shared_dir(spark)
    monkeypatch.setattr(tree, "cut", cut)
    rows = [(f"r{i}", None, "t", i) for i in range(200)] + [("a0", "r0", "t", 0)] + [(f"a{i}", f"a{i - 1}", "t", i) for i in range(1, 8)]
    got = {r.id: (r.state, len(r.steps)) for r in tree.climbed(spark.createDataFrame(rows, "id string, parent string, title string, ord long")).collect()}
    assert got["r7"] == ("root", 1) and got["a7"] == ("root", 9)
    assert rounds[0] == 208 and max(rounds[1:]) <= 8  # the roots, which share a null parent, aren't dealt out again


def test_count_under_is_linear_and_right(spark):
    import random

    r = random.Random(1)
    kinds = ["item"] * 5 + ["table"] * 4 + ["sep", "blank", "text", "note"]
    rows = [(k, i, kind, r.randint(1, 8) if kind == "item" else None, "x") for k in range(30) for i, kind in enumerate(r.choice(kinds) for _ in range(r.randint(1, 60)))]

    def slow(lines, at):
        level, child, n, table = lines[at][3], None, 0, None
        for j in range(at + 1, len(lines)):
            kind = lines[j][2]
            if kind == "table" and child is None and table is None:
                table = -1
                for x in lines[j:]:
                    if x[2] == "sep":
                        continue
                    if x[2] != "table":
                        break
                    table += 1
            elif kind == "item":
                if lines[j][3] <= level:
                    break
                child = child or lines[j][3]
                n += lines[j][3] == child
        return n or table or None

    got = {(x.k, x.ln): x.n for x in outline.count_under(spark.createDataFrame(rows, "k int, ln int, kind string, level int, text string"), "k").collect()}
    for k in range(30):
        lines = [x for x in rows if x[0] == k]
        assert {i: got[k, i] for i, x in enumerate(lines) if x[2] == "item"} == {i: slow(lines, i) for i, x in enumerate(lines) if x[2] == "item"}


def test_cards_shrink_to_their_bound(spark):
    long = "\n".join(["# 목표 " + "가" * 80] + [f"○ {i} " + "나" * 120 for i in range(24)] + [f"- 사업 {i} " + "다" * 70 for i in range(20)] + ["| a | b |", "| 1 | 2 |"] + [f"{i}명" for i in range(30)])
    got = cards.cards(spark.createDataFrame([("01-x", "1", "t", long)], "id string, no string, title string, text string"), "id", "no", "title", "text").first()
    names = ["id", "no", "title", "names", "points", "tables", "numbers"]
    card = spark.createDataFrame([got]).select(cards.card_text(*[F.col(n) for n in names]).alias("c")).first().c
    assert len(card) == 685 and len(got.numbers) == 3 and len(got.points) == 1 and len(got.names) == 8 and len(got.tables) == 1
    assert len(got.heads) == 1 and got.heads[0].endswith("…") and len(got.heads[0]) == 60


def test_blocks_of_odd_manuscripts(spark):
    from tidewater.operators import markers

    texts = [(1, "\n\n# a\n\n[^1]: note\n\n\n- b\nplain\nmore\n\nalone"), (2, "|--|\n# x"), (3, "[표: t]\n![p](q.png)\n| a | b |\n| c |\n"), (4, None)]
    got = [(r.k, r.line, r.kind, r.text, r.caption) for r in markers.blocks(spark.createDataFrame(texts, "k int, t string"), "k", "t").orderBy("k", "line").collect()]
    assert got == [
        (1, 3, "para", "a", None), (1, 6, "blank", "", None), (1, 8, "para", "b plain more", None), (1, 11, "blank", "", None), (1, 12, "para", "alone", None),
        (2, 2, "para", "x", None), (3, 2, "image", "", None), (3, 3, "table", "", "t"),
    ]


def test_cards_pass_over_what_does_not_fit(spark):
    rows = [("t", 1, 0, 50, 30), ("t", 2, 1, 40, 80), ("t", 3, 2, 30, 20), ("t", 4, 3, 0, 1)]
    got = cards.pick(spark.createDataFrame(rows, "k string, id long, ord int, score int, size int"), "k", 60, 5).orderBy("ord").collect()
    assert [r.id for r in got] == [1, 3]


@pytest.mark.parametrize("instant, day, reset", [("2026-09-08 13:00:00", "2026-09-08", "2026-09-09 07:00:00"), ("2026-01-15 13:00:00", "2026-01-15", "2026-01-16 08:00:00"), ("2026-03-07 20:00:00", "2026-03-07", "2026-03-08 08:00:00"), ("2026-03-08 20:00:00", "2026-03-08", "2026-03-09 07:00:00"), ("2026-09-08 06:59:59", "2026-09-07", "2026-09-08 07:00:00")])
def test_zone_days(spark, instant, day, reset):
    r = spark.range(1).select(ledger.zone_day(F.lit(instant).cast("timestamp")).alias("d"), ledger.next_reset(F.lit(instant).cast("timestamp")).cast("string").alias("r")).first()
    assert (str(r.d), r.r) == (day, reset)


def test_numbers_and_text(spark):
    values = [0.123456, 12.5, 250.4, 1234.5, 3.4e8, 5.1e12, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", numbers.amount(F.col("v"), "%").alias("a")).orderBy("i")
    assert [r.a for r in df.collect()] == ["0.12 %", "12.5 %", "250.4 %", "1,234.5 %", "3.4억 %", "5.1조 %", "—"]
    df = spark.createDataFrame([(0, 1234.56), (1, 250.44), (2, 1.239), (3, None), (4, 1.005)], "i int, v double").select("i", numbers.reference(F.col("v")).alias("a")).orderBy("i")
    assert [r.a for r in df.collect()] == ["1,235", "250.4", "1.24", "–", "1.00"]
    r = spark.range(1).select(text.column_index(F.lit("BC12")).alias("c"), text.column_index(F.lit("1")).alias("z"), text.particle(F.lit("집")).alias("p"), text.particle(F.lit("가")).alias("q"), text.clip(F.lit(" a　 bcdef"), 4).alias("k")).first()
    assert (r.c, r.z, r.p, r.q, r.k) == (54, -1, "은", "는", "a b…")


def test_tables(spark):
    df = spark.createDataFrame([(1, 1, 4, 5), (1, 2, 9, 3), (1, 3, 2, 1), (1, 4, 2, 1)], "k int, o int, rows int, width int")
    assert [r.kept for r in tables.cap_cells(df, "k", "o", 30).orderBy("o").collect()] == [4, 3, 1, 0]
    r = spark.range(1).select(tables.sniff(F.lit("a;b\nc;d")).alias("s"), tables.square(F.array(F.array(F.lit("a")), F.array(F.lit("")), F.array(F.lit("b"), F.lit("c")))).alias("q")).first()
    assert r.s == ";" and r.q == [["a", ""], ["b", "c"]]


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in files.items():
            z.writestr(n, x)
    return out.getvalue()


def test_attachments(spark):
    sheet = '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="ZZZZZZ1"><v>9</v></c></row></sheetData></worksheet>'
    xlsx = _zip({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<sst xmlns="m"><si><r><t>h</t></r><r><t>i</t></r><rPh><t>x</t></rPh></si></sst>'})
    slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>'
    pptx = _zip({"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two")})
    files = [
        ("a.csv", '﻿x;y\r\n"p;q";"l1\nl2"\n;\nz'.encode()), ("b.html", b"<p>A &amp; B</p><script>x</script><table><tr><td colspan=2>c<td>d</table>"), ("c.xlsx", xlsx), ("d.pptx", pptx),
        ("e.txt", "가나".encode("euc-kr")), ("f.png", b"12"), ("g.exe", b"1"), ("h.csv", b""), ("i.xlsx", b"broken"), (None, None),
    ]
    got = {r.name: r for r in attachments.extract_files(spark.createDataFrame(files, "name string, content binary")).collect()}
    assert got["a.csv"].tables == [[["x", "y"], ["p;q", "l1\nl2"], ["z", ""]]]
    assert got["b.html"].text == "A & B" and got["b.html"].tables[0][0][0] == "c"
    assert got["c.xlsx"].tables == [[["hi", "", "7"], ["9", "", ""]]]
    assert got["d.pptx"].text == "two\nten" and got["e.txt"].text == "가나" and got["f.png"].inline == "MTI="
    assert all(got[n].error and got[n].text is None for n in ("g.exe", "h.csv", "i.xlsx", ""))


def test_series(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"code": "A", "name": "n", "unit": "", "years": [2020, 2021], "values": {"11": [1, null], "12": [2.5, 3]}}')
    got = series.read_series(spark, str(tmp_path))
    assert got.count() == 4 and got.filter("value is null").first().year == 2021 and got.filter("place = '12'").agg(F.sum("value")).first()[0] == 5.5


def test_usage_stream(spark, tmp_path):
    from tidewater.streaming.usage import usage_stream

    src = str(tmp_path / "src")
    spark.sql("SELECT timestamp'2026-09-08 06:30:00' AS ts, 'a' AS m UNION ALL SELECT timestamp'2026-09-08 07:30:00', 'a' UNION ALL SELECT timestamp'2026-09-08 07:40:00', 'a'").write.parquet(src)
    q = usage_stream(spark.readStream.schema("ts timestamp, m string").parquet(src), "m", "ts").writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r.day), r.n) for r in spark.table("usage").collect()} == {("2026-09-07", 1), ("2026-09-08", 2)}


def test_usage_stream_drops_what_comes_too_late(spark, tmp_path):
    from tidewater.streaming.usage import usage_stream

    src = str(tmp_path / "src")
    for hours in ((6, 12), (13,), (6, 20), (7,)):
        spark.createDataFrame([(f"2026-09-08 {h:02}:30:00", "a") for h in hours], "ts string, m string").selectExpr("cast(ts as timestamp) as ts", "m").coalesce(1).write.mode("append").parquet(src)
    rows = []
    stream = spark.readStream.schema("ts timestamp, m string").option("maxFilesPerTrigger", 1).parquet(src)
    q = usage_stream(stream, "m", "ts", late="1 hour").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: rows.extend(b.collect())).start()
    q.awaitTermination()
    hours = {r.hour.hour: r.n for r in rows}
    # the second 6:30 and 7:30 come after the watermark has passed them
    assert hours.get(12) == 1 and hours.get(6) == 1 and 7 not in hours


def test_reports_in_words(spark):
    rows = [(1, c, c.upper(), "건", 2024, m, r, 10, 5.0, 4.0, 6.0, 5.5, 3, 5.25, 20) for c, m, r in (("a", 9.0, 1), ("b", 8.0, 2), ("c", 5.0, 5), ("d", 1.0, 10))]
    df = spark.createDataFrame(rows, "place int, code string, name string, unit string, year int, mine double, rank int, n int, avg double, q1 double, q3 double, peer_avg double, peer_n int, nation_avg double, nation_n int")
    got = {(r.list, r.nth): r.line for r in indicators.report_lines(df, 1, "province").collect()}
    assert got == {
        ("high", 1): "- A 9.00 건(2024년) — 비교집단 10곳 중 1위(상위 5%), 비교평균 5.00 건\n· 같은 유형 3곳 평균 5.50 건 / 전국 20곳 평균 5.25 건",
        ("low", 1): "- D 1.00 건(2024년) — 비교집단 10곳 중 10위(하위 5%), 비교평균 5.00 건\n· 같은 유형 3곳 평균 5.50 건 / 전국 20곳 평균 5.25 건",
        ("outside", 1): "- B 8.00 건(2024년) — 비교집단 10곳 중 2위, Q1~Q3 4.00~6.00 건 위", ("inside", 1): "C",
    }


def test_kinds_of_tables_sort_facts_once_and_no_grids(spark, tmp_path):
    from tidewater.plans import adapters, texts

    lines = [(o, p, 1, k, float(o * 7 % 50 + 1), float(o), "A", "F") for p in range(3) for o in range(20) for k in (1, 2)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = texts.table_kinds(spark, str(tmp_path))
    assert sorted((r.l_partkey, r.seq) for r in got.collect()) == [(p, i + 1) for p in range(3) for i in range(40)]
    plan = got._jdf.queryExecution().optimizedPlan()
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window [") == plan.toString().count("Window [") == 1
    while plan.nodeName() != "Window":
        plan = plan.children().head()
    carried = plan.children().head().schema()
    assert "array" not in carried.simpleString() and "struct<" not in carried.simpleString()[7:]
    # tasks grow in number with their input
    small = spark.range(10)
    assert adapters.dealt(small, "id", 10, 100).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert adapters.dealt(small, "id", 10_001, 100).rdd.getNumPartitions() == 101
