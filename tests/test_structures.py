"""Hard cases of tags, fields, cards, places, buckets and the keyed ledger against plain Python."""

import glob
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tidewater.operators import cards, markers, order, profiles, readback, tables, tags
from tidewater.streaming import cards as card_stream
from tidewater.streaming import ledger

TAG = re.compile(r"""<(/?)([\w:]+)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.A)


def verdict(text):
    stack, roots = [], 0
    for m in TAG.finditer(text or ""):
        if m[4]:
            roots += not stack
        elif m[1]:
            if not stack:
                return "left over", m[2], None, None
            top = stack.pop()
            if top != m[2]:
                return "crossed", m[2], top, None
            roots += not stack
        else:
            stack.append(m[2])
    return ("not closed", stack[-1], None, None) if stack else (None if roots == 1 else "roots", None, None, None if roots == 1 else roots)


def outermost(text, tag):
    out, depth, start = [], 0, None
    for m in TAG.finditer(text or ""):
        if m[2] != tag:
            continue
        if m[4]:
            if not depth:
                out.append((m.start(), m.end(), m.end(), m.end()))
        elif m[1]:
            if depth == 1:
                out.append((*start, m.start(), m.end()))
            depth = max(0, depth - 1)
        else:
            if not depth:
                start = (m.start(), m.end())
            depth += 1
    return out


def test_tags_of_random_texts(spark):
    r = random.Random(1)
    parts = ["<a>", "</a>", "<b x=\"1>2\">", "</b>", "<a/>", "<h:p c='/'>", "</h:p>", "text 가", "<", ">", "<!-- -->", "<br />", '<a t="x">', "<1>"]
    texts = [None, "", "plain", "<a", "</a>", '<a x="' + "y" * 50_000 + '">z</a>', "<a>" * 3000 + "</a>" * 3000] + ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    t = tags.tokens(df, "k", "t")
    got = {x.k: (x.problem, x.tag, x.opened, x.roots) for x in tags.verdicts(t, df, "k").collect()}
    assert got == {k: verdict(x) for k, x in enumerate(texts)}
    spans = {}
    for x in tags.spans(t, "k").orderBy("k", "raw", "span").collect():
        spans.setdefault((x.k, x.raw), []).append((x.start, x.inner_start, x.inner_end, x.end))
    for k, x in enumerate(texts):
        for tag in ("a", "b", "h:p", "br"):
            assert spans.get((k, tag), []) == outermost(x, tag), (k, tag)


def test_verdicts_of_insides_are_found_in_the_tags_of_whole_texts(spark, tmp_path):
    r = random.Random(2)
    parts = ["<a>", "</a>", "<b x=\"1>2\">", "</b>", "<a/>", "<h:p c='/'>", "</h:p>", "text 가", "<", ">", "<br />", '<a t="x', "<c>", "</c>", "<c/>"]
    texts = [None, "", "plain", "<a", "</a>", "<a>" * 3000 + "</a>" * 3000, "<a><b></a></b>", "<a></a></a><b>", "<a></b><a></a></a>", "<a><b/><c></c></a>", '<a><b x="</a>">', "<a><b x='</a>'</a>"]
    texts += ["".join(r.choices(parts[: r.choice((6, 15))], k=r.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([*enumerate(texts), (None, "<a></a>"), (None, None)], "page_id long, html string")
    edges = tags.edged(tags.tokens(df, "page_id", "html"), df, "page_id")
    want = [(None, "", 0, "roots", None, None, 0)]
    for k, x in enumerate(texts):
        want.append((k, "", 0, *verdict(x)))
        for tag in {m[2] for m in TAG.finditer(x or "")}:
            want += [(k, tag, i, *verdict(x[a:b])) for i, (_, a, b, _) in enumerate(outermost(x, tag))]
    got = [tuple(x) for x in tags.part_verdicts(edges, "page_id").collect()]
    order = lambda x: (x[0] is None, x)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert {x[3] for x in want if x[1]} == {None, "roots", "not closed", "crossed", "left over"}
    # texts of insides are neither cut out nor joined, and tasks sort steps and names only
    from tidewater.plans import structures

    df.filter("page_id is not null").withColumn("url", F.lit("")).write.parquet(f"{tmp_path}/pages.parquet")
    q = structures.page_verdicts(spark, str(tmp_path))
    plan = q._jdf.queryExecution()
    assert "Join" not in plan.optimizedPlan().toString() and plan.executedPlan().toString().count("Sort [") == 4
    assert q.count() == len(want) - 1


def fields(text):
    rows, row, field, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c != '"':
                field += c
            elif text[i + 1 : i + 2] == '"':
                field += '"'
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        elif c == ";":
            row.append(field)
            field = ""
        elif c in "\r\n":
            i += text[i : i + 2] == "\r\n"
            rows.append([*row, field])
            row, field = [], ""
        else:
            field += c
        i += 1
    return rows + ([[*row, field]] if field or row else [])


def test_fields_of_random_texts(spark):
    r = random.Random(2)
    texts = ["", '""', '""""', '"a""b";c\n', "a\n\nb", '"open'] + ["".join(r.choices('ab"";\n\r', k=r.randint(1, 25))) for _ in range(800)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tables.csv_rows(F.col("t"), F.lit(";")).alias("r")).collect()
    assert {x.k: x.r for x in got} == {k: fields(t) for k, t in enumerate(texts)}


def test_cards_of_a_hot_document(spark):
    r = random.Random(3)

    def document(n):
        return [("d", i, i, f"{r.randint(1, 5):02}", r.choice([None, r.randrange(max(1, i))]) if i else None, r.choice([3, 20, 40, 41, 90, 200])) for i in range(n)]

    def made(n):
        df = spark.createDataFrame(document(n) + [("e", 0, 0, "01", None, 5)], "doc string, id int, ord int, chapter string, mirrors int, size int")
        few = cards.candidates(df, df, 120).withColumn("key", F.concat_ws("-", "doc", "target")).cache()
        every = df.alias("t").join(df.alias("c"), (F.col("t.doc") == F.col("c.doc")) & (F.col("c.ord") <= F.col("t.ord")))
        every = every.select(F.concat_ws("-", "t.doc", "t.id").alias("key"), F.col("c.id").alias("id"), F.col("c.ord").alias("ord"), cards.score().alias("score"), F.col("c.size").alias("size"))
        taken = [sorted(map(tuple, cards.pick(x, "key", 120, 5).collect())) for x in (few, every)]
        assert taken[0] == taken[1] and few.count() == few.dropDuplicates(["key", "id"]).count()
        return few.count()

    small, large = made(250), made(750)
    assert large < 5 * small  # all pairs would be nine times as many


def test_chosen_cards_of_documents_of_all_sizes(spark, monkeypatch):
    r, few = random.Random(4), 60
    monkeypatch.setattr(cards, "FEW", few)

    def document(name, n):
        return [(name, i * 3, i * 2, r.choice(["01", "02", "03", None]), r.choice([None, 3 * r.randrange(max(1, i))]), r.choice([3, 20, 40, 41, 90, 200, None])) for i in range(n)]

    rows = [x for k in range(60) for x in document(f"d{k}", r.randint(1, few))]
    kinds = "doc string, id int, ord int, chapter string, mirrors int, size int"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for some in (rows, [x for x in rows if x[3] and x[5]] + [x for x in document("large", 150) if x[3] and x[5]]):
            df = spark.createDataFrame(some, kinds)
            every = df.alias("t").join(df.alias("c"), (F.col("t.doc") == F.col("c.doc")) & (F.col("c.ord") <= F.col("t.ord"))).filter("c.size is not null")
            every = every.select(F.concat_ws("-", "t.doc", "t.id").alias("key"), F.col("c.id").alias("id"), F.col("c.ord").alias("ord"), cards.score().alias("score"), F.col("c.size").alias("size"))
            want = sorted(map(tuple, cards.pick(every, "key", 120, 5).collect()))
            chosen = cards.chosen(df, 120, 5)
            assert sorted(map(tuple, chosen.select(F.concat_ws("-", "doc", "target"), "ord", "id").collect())) == want
            if some is rows:  # no pair is a row of its own
                plan = chosen._jdf.queryExecution().executedPlan().toString()
                assert "Join" not in plan and "Generate" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_places(spark):
    rows = [(i * 7919 % 1000, "x") for i in range(1000)]
    got = order.positions(spark.createDataFrame(rows, "k int, v string").repartition(7), "k").collect()
    assert [x.pos for x in sorted(got, key=lambda x: x.k)] == list(range(1000))
    assert order.positions(spark.createDataFrame([], "k int"), "k").count() == 0


def test_buckets_are_rewritten_only_where_touched(spark, tmp_path):
    batches = [[("a", 0, "x"), ("b", 1, "y"), ("z", 2, "q")], [("b", 0, "Y"), ("b", 5, "YY"), ("c", 1, "z")], [("a", 0, "X"), ("d", 1, "n")]]
    schema = "id string, ord int, card string"
    src = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)

    def run(folder, n):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(src)
        card_stream.keep_latest(stream, folder, buckets=16).awaitTermination()
        return sorted(map(tuple, card_stream.read(spark, folder).select("ord", "id", "card").collect()))

    assert run(str(tmp_path / "many"), 1) == [(0, "a", "X"), (1, "b", "YY"), (2, "z", "q"), (3, "c", "z"), (4, "d", "n")]
    # the bucket of z was written by the first batch only
    of = {x.id: x.b for x in spark.createDataFrame([(k,) for k in "abczd"], "id string").select("id", F.pmod(F.xxhash64("id"), F.lit(16)).alias("b")).collect()}
    last = {b: max(int(p.rsplit("=", 1)[1]) for p in glob.glob(f"{tmp_path}/many/cards/bucket={b}/batch=*")) for b in of.values()}
    assert last[of["a"]] == 2 and last[of["z"]] == max(i for i, rows in enumerate(batches) if of["z"] in {of[k] for k, *_ in rows})


def test_ledger_drops_what_comes_after_its_day_is_over(spark, tmp_path):
    src, rows = str(tmp_path / "src"), []
    files = [
        [("2026-03-08 07:30:00", "a", False, None), ("2026-03-08 09:00:00", "a", True, 5), ("2026-03-08 08:30:00", "a", False, 9)],  # the day of the 8th begins at 8:00 UTC
        [("2026-03-09 06:59:00", "a", False, None), ("2026-03-09 07:01:00", "a", False, 0)],  # and ends at 7:00, as the clocks change
        [("2026-03-11 00:00:00", "b", False, None)], [("2026-03-08 10:00:00", "a", False, None), ("2026-03-11 01:00:00", "a", True, None)],
    ]
    for f in files:
        spark.createDataFrame(f, "t string, m string, out boolean, lim int").selectExpr("cast(t as timestamp) as ts", "m", "out", "lim").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, m string, out boolean, lim int").option("maxFilesPerTrigger", 1).parquet(src)
    told = ledger.ledger_stream(stream, "m", "ts", F.col("out"), F.col("lim"), late="1 hour")
    writer = told.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda b, n: rows.extend((n, *x) for x in b.collect()))
    before = spark.conf.get(ledger.PROVIDER, None)
    ledger.start_with_rocks(writer, spark).awaitTermination()
    assert spark.conf.get(ledger.PROVIDER, None) == before
    final = {(m, day): (n, out, lim) for _, m, day, n, out, lim, done in rows if done}
    assert final == {("a", "2026-03-07"): (1, False, 0), ("a", "2026-03-08"): (3, True, 5), ("a", "2026-03-09"): (1, False, 0)}
    latest = {(m, day): (n, out, lim) for _, m, day, n, out, lim, _ in rows}
    assert latest["a", "2026-03-10"] == (1, True, 0) and latest["b", "2026-03-10"] == (1, False, 0)


def test_notes_go_back_where_they_were(spark):
    rows = [(1, 0, "para", "1. ", 12, []), (1, 1, "para", "①", 12, [(0, "n")]), (1, 2, "para", "○ some text", 10, [(7, "a"), (7, "b"), (99, "c"), (1, "d")]), (1, 3, "picture", "", None, []), (1, 4, "para", "big", 20, [])]
    df = spark.createDataFrame([(*r, None) for r in rows], "d int, ln int, kind string, text string, size int, notes array<struct<at:int,note:string>>, rows array<array<string>>")
    x = readback.depths(readback.cut(df), "d")
    assert readback.marked(x, "d", ["#", "-", "·"]).first().text == (
        "# \n- [^1]\n· [^2]some [^4][^3]text[^5]\n\n" + readback.PICTURE + "\n· big\n\n[^1]: n\n[^2]: d\n[^3]: a\n[^4]: b\n[^5]: c\n"
    ).replace("# \n", "#\n")


def test_settings_of_one_file_are_dealt_out(spark):
    layers = spark.range(64).selectExpr("id as k", "0 as layer", "'{\"a\": {\"b\": 1}}' as text").coalesce(1)
    found = profiles.paths(layers, "k", "layer", "text")
    filled = found.select(F.spark_partition_id().alias("part")).distinct().count()
    assert found.count() == 128 and filled > 4  # two levels; one task each before


def test_the_ledger_keeps_models_together():
    calls = []

    class Pages:
        def __init__(self):
            self.kept = {}

        def containsKey(self, key):
            calls.append("containsKey")
            return key in self.kept

        def getValue(self, key):
            calls.append("getValue")
            return self.kept[key]

        def updateValue(self, key, value):
            calls.append("updateValue")
            self.kept[key] = value

    class Handle:
        def getMapState(self, *_):
            return Pages()

        def registerTimer(self, ends):
            calls.append("registerTimer")

    keeper = ledger.Ledger()
    keeper.init(Handle())
    b = pd.DataFrame([(f"m{i % 50}", "d", 10, i == 3, i % 7, i) for i in range(200)], columns=["model", "day", "ends", "out", "limit", "at"])
    (told,) = keeper.handleInputRows((0,), iter([b[:90], b[90:]]), None)
    assert len(calls) == 3 and len(told) == 50 and told["n"].tolist() == [4] * 50  # one page, one call; before, a model's page each
    assert told.set_index("model").loc["m3"].tolist() == ["d", 4, True, 6, False]


def test_manuscripts_are_read_once_for_all_issues(spark, monkeypatch):
    read, lines = [], markers.lines
    monkeypatch.setattr(markers, "lines", lambda *a: read.append(1) or lines(*a))
    markers.issues(spark.createDataFrame([(1, "# a\n\nb[^1]\n[^1]: c")], "k int, t string"), "k", "t")
    assert len(read) == 1
