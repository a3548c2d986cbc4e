"""All queries of the engine by name, over the test tables, and the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import numbers, text
from tidewater.operators import cards, forms, indicators, ledger, outline, tables, tree

from . import adapters as a
from . import manuscripts, structures, texts


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return a.indicators(spark, d), a.places(spark, d)


def _analyze(basis: str, place: int | None = None):
    return lambda s, d: _rounded(indicators.analyze(*_both(s, d), basis, place))


def _trend(s: SparkSession, d: str) -> DataFrame:
    return indicators.trend(*_both(s, d), "province")


def peer_groups(s: SparkSession, d: str) -> DataFrame:
    return indicators.peers(a.places(s, d), "type")


def box_stats(s: SparkSession, d: str) -> DataFrame:
    return _rounded(indicators.box_stats(a.indicators(s, d), "code", "year"))


def chunk_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts by brand in sheets of at most 12."""
    parts = a.table(s, d, "part").select("p_brand", "p_partkey")
    return indicators.chunks(parts, ["p_partkey"], 12, "p_brand")


def nearest_example_all(s: SparkSession, d: str) -> DataFrame:
    """All parts: of size up to 25 as blanks, the others as examples, of equal brand and type."""
    p = a.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", F.col("p_partkey").alias("ord"), "p_size")
    blank = F.coalesce(F.col("p_size") <= 25, F.lit(False))
    return tree.nearest_example(p.filter(blank), p.filter(~blank), ["p_brand", "p_type"])


def title_dedupe(s: SparkSession, d: str) -> DataFrame:
    p = a.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return tree.distinct_titles(p, ["c_nationkey"], "c_mktsegment", ["c_custkey"]).select("c_custkey", "title")


def id_dedupe(s: SparkSession, d: str) -> DataFrame:
    p = a.table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return tree.distinct_ids(p, ["c_nationkey"], "c_mktsegment", ["c_custkey"]).select("c_custkey", "id")


def tree_stats(s: SparkSession, d: str) -> DataFrame:
    return tree.tree_stats(a.nodes(s, d))


def col_percent(s: SparkSession, d: str) -> DataFrame:
    """Nations' customers as widths of a region's columns."""
    c = a.table(s, d, "customer").groupBy("c_nationkey").count().join(a.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return tree.column_shares(c.select("n_regionkey", "n_nationkey", F.col("count").alias("width")), ["n_regionkey"], "width", "n_nationkey").select("n_regionkey", "n_nationkey", "pct")


def col_percent_parts(s: SparkSession, d: str) -> DataFrame:
    """Sizes of a brand's parts as widths of more than 100 columns; those of size 1 count as unknown."""
    p = a.table(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 1, F.col("p_size")).alias("width"))
    return tree.column_shares(p, ["p_brand"], "width", "p_partkey").select("p_brand", "p_partkey", "pct")


def outline_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents by kind."""
    return outline.lines(a.table(s, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min("ln").alias("first"))


def table_islands(s: SparkSession, d: str) -> DataFrame:
    return outline.islands(a.manuscripts(s, d), "conv_id", "ln", F.col("kind") == "item").drop("island")


def level_jump(s: SparkSession, d: str) -> DataFrame:
    m = a.manuscripts(s, d).filter("kind = 'item'")
    return outline.level_jumps(m, "conv_id", "ln").select("conv_id", "ln", "level", "before")


def count_under(s: SparkSession, d: str) -> DataFrame:
    return outline.count_under(a.manuscripts(s, d), "conv_id").withColumn("n", F.col("n").cast("int"))


LIMITS = (("the", "max", 2), ("a n d", "min", 2), ("zzz", "max", 1), ("t", "max", 1), ("ing", "max", None))


def check_limits(s: SparkSession, d: str) -> DataFrame:
    m = a.manuscripts(s, d)
    limits = m.select("conv_id").distinct().withColumn("l", F.explode(F.lit([x[0] for x in LIMITS]))).withColumnRenamed("l", "scope")
    pick = lambda i, kind: F.element_at(F.create_map(*[F.lit(v) for x in LIMITS for v in (x[0], F.lit(x[i]).cast(kind))]), F.col("scope"))
    limits = limits.withColumns({"op": pick(1, "string"), "n": pick(2, "int")})
    return outline.check_limits(m, limits, "conv_id").withColumn("best", F.col("best").cast("int"))


def find_limits(s: SparkSession, d: str) -> DataFrame:
    """Sentences with limits made from orders: two limits, a number of nothing that is counted, and one limit twice."""
    k = F.col("o_orderkey")
    n = lambda m: (k % m).cast("string")
    said = (
        F.when(k % 3 == 0, F.concat(F.lit("추진전략  "), n(9), F.lit("개  이내, 전략 3건 이상"))).when(k % 3 == 1, F.concat(F.lit("아무 말 5명 이하. 세부사업은 "), n(7), F.lit("명\n이하")))
        .otherwise(F.lit("성과지표 4개 이상 성과지표 4개 이상, 그리고 아주 멀리 떨어져 있어서 그 무엇을 말하는지 더는 알 수가 없는 그런 수로 적은 2개 이내"))
    )
    return outline.find_limits(a.table(s, d, "orders").select("o_orderkey", said.alias("t")), "o_orderkey", "t")


def outline_numbers(s: SparkSession, d: str) -> DataFrame:
    return outline.numbered(a.manuscripts(s, d), "conv_id", "ln").select("conv_id", "ln", "level", "no")


def few_children(s: SparkSession, d: str) -> DataFrame:
    return outline.few_children(a.manuscripts(s, d), "conv_id", "ln", 2)


def after_tables(s: SparkSession, d: str) -> DataFrame:
    return forms.after_tables(a.manuscripts(s, d), "conv_id", "ln").select("conv_id", "ln", "kind")


def _carded(s: SparkSession, d: str) -> DataFrame:
    """Each order's lines as cards of a document, joined with each other within the order only."""
    n = a.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("size"))
    n = n.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("id"), F.col("l_linenumber").alias("ord"), F.format_string("%02d", (F.col("l_linenumber") / 3).cast("int") + 1).alias("chapter"), (F.col("l_linenumber") - 2).cast("long").alias("mirrors"), "size")
    return n.alias("t").join(n.alias("c"), (F.col("t.doc") == F.col("c.doc")) & (F.col("c.ord") <= F.col("t.ord"))).select(F.col("t.doc").alias("doc"), F.col("t.id").alias("target"), F.col("c.id").alias("id"), F.col("c.ord").alias("ord"), cards.score().alias("score"), F.col("c.size").alias("size"))


def card_score(s: SparkSession, d: str) -> DataFrame:
    return _carded(s, d).select("doc", "target", "id", "score")


def card_pick(s: SparkSession, d: str) -> DataFrame:
    scored = _carded(s, d).withColumn("key", F.format_string("%d-%d", "doc", "target"))
    return cards.pick(scored, "key", 90, 5)


def number_tokens(s: SparkSession, d: str) -> DataFrame:
    return a.table(s, d, "documents").select("doc_id", F.array_join(text.number_tokens(F.coalesce("text", F.lit(""))), " ").alias("numbers"))


def clip_text(s: SparkSession, d: str) -> DataFrame:
    return a.table(s, d, "documents").select("doc_id", text.clip(F.coalesce("text", F.lit("")), 60).alias("clipped"))


def html_text(s: SparkSession, d: str) -> DataFrame:
    """Text of pages by patterns alone: scripts, styles and comments out, tags to spaces, white space squashed."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>|<!--.*?-->", " ")
    return a.table(s, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\r\n]+", " ")).alias("text"))


def csv_sniff(s: SparkSession, d: str) -> DataFrame:
    sep = F.when(F.col("p_size") % 3 == 0, ";").when(F.col("p_size") % 3 == 1, "\t").otherwise(",")
    p = a.table(s, d, "part").select("p_partkey", F.concat("p_name", sep, "p_brand", sep, "p_type", F.lit("\n"), "p_brand", sep, F.col("p_size").cast("string"), sep, "p_name").alias("t"))
    return p.select("p_partkey", tables.sniff(F.col("t")).alias("delimiter"))


def cap_cells(s: SparkSession, d: str) -> DataFrame:
    """Order lines as tables of an order: quantity rows of linenumber columns, with room for 100 cells."""
    t = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("rows"), F.col("l_linenumber").alias("width"))
    t = t.groupBy("l_orderkey", "l_linenumber").agg(F.max("rows").alias("rows"), F.max("width").alias("width"))
    return tables.cap_cells(t, "l_orderkey", "l_linenumber", 100).select("l_orderkey", "l_linenumber", F.col("kept").cast("int").alias("kept"))


def zone_day(s: SparkSession, d: str) -> DataFrame:
    e = a.moved_events(s, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", ledger.zone_day(F.col("ts")).alias("day"), F.unix_timestamp(ledger.next_reset(F.col("ts"))).alias("reset"))


def usage_ledger(s: SparkSession, d: str) -> DataFrame:
    return ledger.usage(a.table(s, d, "events"), "user_id", "ts", F.col("event_type") == "error")


def usable_models(s: SparkSession, d: str) -> DataFrame:
    """Users by day without an error on that day."""
    used = usage_ledger(s, d)
    return ledger.usable(used.select("day", "model", "n"), used)


def usage_limits(s: SparkSession, d: str) -> DataFrame:
    """A day's limit by model: the last one that an error named, else that of the model's family."""
    e = a.table(s, d, "events")
    family = F.element_at(F.array(*[F.lit(x) for x in ("x", "Flash-Lite", "flash", "pro")]), (F.col("user_id") % 4 + 1).cast("int"))
    e = e.withColumn("model", F.concat(family, F.lit("-"), F.col("user_id").cast("string")))
    named = F.when(F.col("event_type") == "error", F.floor("value").cast("long"))
    return ledger.limits_of(ledger.usage(e, "model", "ts", F.col("event_type") == "error", limit=named)).select("day", "model", "rpd", "source", "label")


def usage_days(s: SparkSession, d: str) -> DataFrame:
    return ledger.daily(usage_ledger(s, d)).select("day", "total", "models", F.array_join(F.transform("exhausted", lambda x: x.cast("string")), ",").alias("exhausted"))


def until_reset(s: SparkSession, d: str) -> DataFrame:
    e = a.moved_events(s, d).select("event_id", ledger.until_reset(F.col("ts")).alias("u"), ledger.reset_text(F.col("ts"), "Asia/Seoul").alias("at"))
    return e.select("event_id", "u.hours", "u.minutes", "at")


def _models(s: SparkSession, d: str) -> DataFrame:
    p = a.table(s, d, "part")
    kind = F.element_at(F.array(F.lit("flash"), F.lit("flash-lite"), F.lit("pro")), (F.col("p_partkey") % 3 + 1).cast("int"))
    odd = F.when(F.col("p_partkey") % 11 == 0, "-preview").when(F.col("p_partkey") % 13 == 0, "/x").when(F.col("p_partkey") % 17 == 0, "..1").otherwise("")
    name = F.concat(F.when(F.col("p_partkey") % 7 == 0, "models/").otherwise(""), F.lit("m-"), (F.col("p_size") % 5).cast("string"), F.lit("."), (F.col("p_partkey") % 4).cast("string"), F.lit("-"), kind, odd)
    return p.select("p_partkey", name.alias("name"), "p_brand")


def model_order(s: SparkSession, d: str) -> DataFrame:
    """Each brand's models in the order in which they are tried."""
    return ledger.ordered_models(_models(s, d), ["p_brand"], "name", "p_partkey")


def default_model(s: SparkSession, d: str) -> DataFrame:
    return ledger.default_model(_models(s, d), ["p_brand"], "name", "p_partkey")


def analyze_request(s: SparkSession, d: str) -> DataFrame:
    """One place's requested codes in the year 1998, one of them unknown, with names from the items where the values have none."""
    v = a.indicators(s, d).withColumns({"name": F.when(F.col("code") == "A1", "orders").otherwise(""), "unit": F.lit(None).cast("string")})
    items = s.createDataFrame([("B2", "returned", "%", "b", "lines"), ("A2", "", "won", None, None)], "code string, name string, unit string, area string, area_name string")
    places = a.places(s, d).withColumn("level", F.lit("시군구"))
    return _rounded(indicators.analyze_place(v, places, items, 7, "province", ["B2", "zz", "A1", "A2"], "1998"))


def report_facts(s: SparkSession, d: str) -> DataFrame:
    rows = indicators.analyze(*_both(s, d), "province")
    return indicators.report_facts(rows.withColumn("mine", F.when((F.col("place") + F.length("code")) % 5 != 0, F.col("mine"))))


def report_lists(s: SparkSession, d: str) -> DataFrame:
    return indicators.listed(indicators.analyze(*_both(s, d), "nation"), 1).select("place", "code", "list", "nth", F.round("position", 4).alias("position"))


def report_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of a report; their numbers' formats are tested by themselves."""
    rows = indicators.analyze(*_both(s, d), "province").withColumns({"name": F.col("code"), "unit": F.lit("건")})
    return indicators.report_lines(rows, 2, "province")


def _reported(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a report, some without a value, and the places with names and types."""
    rows = indicators.analyze(*_both(s, d), "province").withColumns({"name": F.col("code"), "unit": F.lit("건")})
    rows = rows.withColumn("mine", F.when((F.col("place") + F.length("code")) % 5 != 0, F.col("mine")))
    title = F.concat("province", F.lit(" "), F.when(F.col("place") % 2 == 0, "가").otherwise("각"))
    return rows, a.places(s, d).select("place", title.alias("title"), F.col("type").isNotNull().alias("typed"), F.when(F.col("type") != 2, F.concat(F.lit("유형 "), F.col("type").cast("string"))).alias("type_label"))


def report_heads(s: SparkSession, d: str) -> DataFrame:
    return indicators.report_head(*_reported(s, d), "province").select("place", F.posexplode("head").alias("nth", "line"))


def report_texts(s: SparkSession, d: str) -> DataFrame:
    """Whole reports; their numbers' formats are tested by themselves."""
    return indicators.report_text(*_reported(s, d), 1, "province")


def place_names(s: SparkSession, d: str) -> DataFrame:
    nations = a.table(s, d, "nation").join(a.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counties = nations.select(F.col("n_nationkey").alias("place"), F.lit("시군구").alias("level"), F.col("r_name").alias("province"), F.col("n_name").alias("county"), (F.col("n_nationkey") % 7).alias("type"))
    regions = a.table(s, d, "region").select((F.col("r_regionkey") + 100).alias("place"), F.lit("시도").alias("level"), F.col("r_name").alias("province"), F.lit(None).cast("string").alias("county"), F.lit(None).cast("int").alias("type"))
    types = s.createDataFrame([(i, f"type {i}") for i in range(5)], "type int, label string")
    return indicators.place_names(counties.union(regions), types)


def provinces(s: SparkSession, d: str) -> DataFrame:
    return indicators.provinces(a.places(s, d), "place")


def commonest_priority(s: SparkSession, d: str) -> DataFrame:
    o = a.table(s, d, "orders")
    return forms.commonest(o, ["o_custkey"], "o_orderpriority", "o_orderkey")


def majority_status(s: SparkSession, d: str) -> DataFrame:
    return forms.majority(a.table(s, d, "orders"), ["o_custkey"], "o_orderstatus")


def style_groups(s: SparkSession, d: str) -> DataFrame:
    l = a.table(s, d, "lineitem").select(F.col("l_returnflag").alias("style"), F.col("l_linestatus").alias("para"), F.col("l_linenumber").alias("char"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("text"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return forms.style_groups(l, "at").select("style", "para", "char", "n", F.array_join("samples", ",").alias("samples"))


def match_ratio(s: SparkSession, d: str) -> DataFrame:
    return _rounded(forms.match_ratio(a.manuscripts(s, d), "conv_id", F.col("kind") == "item"))


def dangling_parts(s: SparkSession, d: str) -> DataFrame:
    """Parts ordered that aren't among those of size 3 and more, by return flag."""
    used = a.table(s, d, "lineitem").select("l_returnflag", F.lit("part").alias("attr"), F.col("l_partkey").alias("ref"))
    pool = a.table(s, d, "part").filter("p_size >= 3").select(F.explode(F.lit(["A", "N", "R"])).alias("l_returnflag"), F.lit("part").alias("attr"), F.col("p_partkey").alias("ref"))
    return forms.dangling(used, pool, "l_returnflag", "attr", "ref").select("l_returnflag", F.size("missing").alias("n"), F.element_at("missing", 1).alias("first"), F.element_at("missing", -1).alias("last"))


def fmt_ref(s: SparkSession, d: str) -> DataFrame:
    v = a.indicators(s, d).select("code", "year", "place", "value")
    return v.select("code", "year", "place", numbers.reference(F.col("value")).alias("reference"), numbers.amount(F.col("value"), "u").alias("amount"))


QUERIES = {
    "indicator_long": lambda s, d: _rounded(a.indicators(s, d)),
    "latest_year": lambda s, d: indicators.latest_years(*_both(s, d), "province"),
    "peer_groups": peer_groups,
    "box_stats": box_stats,
    "analyze_one": _analyze("province", 7),
    "analyze_all_provinces": _analyze("province"),
    "analyze_all_types": _analyze("type"),
    "analyze_all_nation": _analyze("nation"),
    "band_split": lambda s, d: indicators.bands(indicators.analyze(*_both(s, d), "province")).select("place", "code", "band"),
    "top_bottom": lambda s, d: indicators.top_bottom(indicators.analyze(*_both(s, d), "nation"), 2),
    "trend_series": lambda s, d: _rounded(_trend(s, d)),
    "trend_noteworthy": lambda s, d: _rounded(indicators.noteworthy(_trend(s, d))),
    "trend_pick": lambda s, d: _rounded(indicators.pick(indicators.noteworthy(_trend(s, d)), 2)),
    "trend_request": lambda s, d: _rounded(indicators.pick(indicators.noteworthy(_trend(s, d)), 2, ["B2", "A3", "A1", "B1"])),
    "trend_direction": lambda s, d: _rounded(indicators.direction(_trend(s, d))),
    "chunk_rows": chunk_rows,
    "tree_trail": lambda s, d: tree.trails(a.nodes(s, d)).select("id", "depth", "trail"),
    "tree_preorder": lambda s, d: tree.preorder(a.nodes(s, d)),
    "nearest_example_all": nearest_example_all,
    "title_dedupe": title_dedupe,
    **{f.__name__: f for f in (
        id_dedupe, tree_stats, col_percent_parts, outline_numbers, few_children, after_tables, usage_limits, usage_days, until_reset, default_model, analyze_request, report_facts, report_lists, report_lines, report_heads, report_texts, place_names,
        provinces, commonest_priority, majority_status, style_groups, match_ratio, dangling_parts,
    )},
    "trend_facts": lambda s, d: _rounded(indicators.trend_facts(_trend(s, d))),
    "col_percent": col_percent,
    "outline_lines": outline_lines,
    "table_islands": table_islands,
    "level_jump": level_jump,
    "count_under": count_under,
    "check_limits": check_limits,
    "find_limits": find_limits,
    "card_score": card_score,
    "card_pick": card_pick,
    "number_tokens": number_tokens,
    "clip_text": clip_text,
    "html_text": html_text,
    "csv_sniff": csv_sniff,
    "cap_cells": cap_cells,
    "zone_day": zone_day,
    "usage_ledger": usage_ledger,
    "usable_models": usable_models,
    "model_order": model_order,
    "fmt_ref": fmt_ref,
    **structures.QUERIES,
    **texts.QUERIES,
    **manuscripts.QUERIES,
}

_VALUES = """
    sold AS (SELECT o_orderkey, o_custkey, c_nationkey AS place, year(o_orderdate)::INT AS year, o_totalprice::DECIMAL(18,2) AS price
             FROM orders JOIN customer ON o_custkey = c_custkey),
    byorder AS (SELECT place, year, count(*) AS n, sum(price)::DOUBLE AS revenue, count(DISTINCT o_custkey) AS buyers FROM sold GROUP BY ALL),
    share AS (SELECT place, year, count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS share FROM sold JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    wide AS (SELECT * FROM byorder LEFT JOIN share USING (place, year)),
    vals AS (SELECT 'A1' AS code, year, place, n::DOUBLE AS value FROM wide UNION ALL SELECT 'A2', year, place, revenue FROM wide
             UNION ALL SELECT 'A3', year, place, revenue / n FROM wide UNION ALL SELECT 'B1', year, place, buyers::DOUBLE FROM wide
             UNION ALL SELECT 'B2', year, place, share FROM wide),
    places AS (SELECT n_nationkey AS place, r_name AS province, CASE WHEN n_nationkey <> 3 THEN n_nationkey % 7 END AS type
               FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def _known(basis: str) -> str:
    g = {"province": "province", "type": "type::VARCHAR", "nation": "'all'"}[basis]
    return f"""{_VALUES},
    known AS (SELECT v.*, p.type, {g} AS g FROM vals v JOIN places p USING (place) WHERE {g} IS NOT NULL),
    latest AS (SELECT code, g, coalesce(max(year) FILTER (WHERE value IS NOT NULL), max(year)) AS year FROM known GROUP BY ALL)"""


_STATS = "count(value) AS n, avg(value) AS avg, min(value) AS min, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(value) AS max"


def _analysis(basis: str) -> str:
    return f"""{_known(basis)},
    cur AS (SELECT * FROM known JOIN latest USING (code, g, year)),
    grp AS (SELECT code, g, year, {_STATS} FROM cur GROUP BY ALL),
    al AS (SELECT v.*, p.type FROM vals v JOIN places p USING (place) WHERE (code, year) IN (SELECT (code, year) FROM latest)),
    nat AS (SELECT code, year, avg(value) AS nation_avg, count(value) AS nation_n FROM al GROUP BY ALL),
    typ AS (SELECT code, year, type, avg(value) AS peer_avg, count(value) AS peer_n FROM al WHERE type IS NOT NULL GROUP BY ALL),
    ana AS (SELECT cur.place, cur.code, cur.year, cur.value AS mine,
              CASE WHEN cur.value IS NOT NULL THEN 1 + (SELECT count(*) FROM cur x WHERE x.code = cur.code AND x.g = cur.g AND x.value > cur.value) END AS rank,
              n, avg, min, q1, q3, max, peer_avg, peer_n, nation_avg, nation_n
            FROM cur JOIN grp USING (code, g, year) JOIN nat USING (code, year) LEFT JOIN typ ON typ.code = cur.code AND typ.year = cur.year AND typ.type = cur.type)"""


_ROUNDED = "place, code, year, round(mine, 4) AS mine, rank::INT AS rank, n, round(avg, 4) AS avg, round(min, 4) AS min, round(q1, 4) AS q1, round(q3, 4) AS q3, round(max, 4) AS max, round(peer_avg, 4) AS peer_avg, peer_n, round(nation_avg, 4) AS nation_avg, nation_n"

_TREND = f"""{_known("province")},
    grp AS (SELECT code, year, g, {_STATS} FROM known GROUP BY ALL),
    nat AS (SELECT code, year, avg(value) AS nation_avg FROM vals GROUP BY ALL),
    tr AS (SELECT place, code, year, value AS mine, avg, n, CASE WHEN n >= 4 THEN q1 END AS q1, CASE WHEN n >= 4 THEN q3 END AS q3, nation_avg
           FROM known JOIN grp USING (code, year, g) JOIN nat USING (code, year)),
    sc AS (SELECT place, code, year, CASE WHEN mine < q1 THEN (q1 - mine) / w WHEN mine > q3 THEN (mine - q3) / w ELSE 0 END AS s
           FROM (SELECT *, coalesce(nullif(abs(q3 - q1), 0), nullif(abs(q3), 0), 1) AS w FROM tr WHERE mine IS NOT NULL AND q1 IS NOT NULL AND q3 IS NOT NULL)),
    note AS (SELECT t.place, t.code, count(mine) AS years, coalesce((SELECT arg_max(s, year) FROM sc WHERE sc.place = t.place AND sc.code = t.code), -1) AS score
             FROM tr t GROUP BY ALL HAVING count(mine) >= 2)"""

_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS title, r_regionkey::BIGINT AS ord FROM region
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey FROM nation
      UNION ALL SELECT 's' || c_nationkey || '-' || c_mktsegment, 'n' || c_nationkey, c_mktsegment, min(c_custkey) FROM customer GROUP BY c_nationkey, c_mktsegment
      UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'gone' ELSE 's' || c_nationkey || '-' || c_mktsegment END, c_name, c_custkey FROM customer
      UNION ALL SELECT 'p' || p_partkey, CASE WHEN (p_partkey - 1) % 40 > 0 THEN 'p' || (p_partkey - 1) END, 't' || (p_partkey % 10), p_partkey + 100 FROM part),
    tops AS (SELECT *, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS late FROM nodes WHERE parent IS NULL OR parent NOT IN (SELECT id FROM nodes)),
    t AS (SELECT id, id AS root, 0 AS depth, title AS trail, late || '/' || lpad(ord::VARCHAR, 20, '0') || id AS path FROM tops
      UNION ALL SELECT n.id, t.root, t.depth + 1, t.trail || ' › ' || n.title, t.path || '/' || lpad(n.ord::VARCHAR, 20, '0') || n.id FROM nodes n JOIN t ON n.parent = t.id)"""

_LINES = """msx AS (SELECT conv_id, turn AS ln, coalesce(text, '') AS text, (coalesce(length(text), 0) + turn)::INT AS z FROM conversations),
    ms AS (SELECT conv_id, ln, text, CASE WHEN z % 7 = 0 THEN 'table' WHEN z % 11 = 0 THEN 'text' ELSE 'item' END AS kind, z % 4 + 1 AS lv FROM msx)"""

_UNDER = f"""{_LINES},
    items AS (SELECT * FROM ms WHERE kind = 'item'),
    stop AS (SELECT x.conv_id, x.ln, x.lv, (SELECT min(y.ln) FROM items y WHERE y.conv_id = x.conv_id AND y.ln > x.ln AND y.lv <= x.lv) AS stop FROM items x),
    kids AS (SELECT s.conv_id, s.ln, (SELECT count(*) FILTER (WHERE y.lv = f.lv) FROM items y,
               (SELECT arg_min(z.lv, z.ln) AS lv FROM items z WHERE z.conv_id = s.conv_id AND z.ln > s.ln AND (s.stop IS NULL OR z.ln < s.stop)) f
               WHERE y.conv_id = s.conv_id AND y.ln > s.ln AND (s.stop IS NULL OR y.ln < s.stop)) AS c, s.stop FROM stop s),
    tab AS (SELECT k.conv_id, k.ln, k.c, (SELECT min(m.ln) FROM ms m WHERE m.conv_id = k.conv_id AND m.kind = 'table' AND m.ln > k.ln AND (k.stop IS NULL OR m.ln < k.stop)) AS t FROM kids k),
    cu AS (SELECT conv_id, ln, CASE WHEN c > 0 THEN c WHEN t IS NOT NULL THEN nullif((SELECT count(*) - 1 FROM ms m WHERE m.conv_id = tab.conv_id AND m.kind = 'table' AND m.ln >= tab.t
             AND NOT EXISTS (SELECT 1 FROM ms q WHERE q.conv_id = tab.conv_id AND q.ln > tab.t AND q.ln < m.ln AND q.kind <> 'table')), 0) END AS n
           FROM tab)"""

_CARDS = """n AS (SELECT l_orderkey AS doc, l_linenumber::BIGINT AS id, l_linenumber AS ord, lpad((l_linenumber // 3 + 1)::VARCHAR, 2, '0') AS chapter, (l_linenumber - 2)::BIGINT AS mirrors, max(l_quantity)::INT AS size FROM lineitem GROUP BY ALL),
    sc AS (SELECT t.doc, t.id AS target, c.id, c.ord, c.size, CASE WHEN c.id = t.id THEN 0 ELSE 10 + CASE WHEN t.mirrors = c.id THEN 100 ELSE 0 END + CASE WHEN c.chapter = '01' THEN 60 ELSE 0 END
             + CASE WHEN c.chapter = t.chapter THEN 40 ELSE 0 END + CASE WHEN c.ord = t.ord - 1 THEN 30 ELSE 0 END + greatest(0, 20 - (t.ord - c.ord)) END::INT AS score
           FROM n t JOIN n c ON t.doc = c.doc AND c.ord <= t.ord)"""

_NAMES = """m AS (SELECT p_brand, p_partkey, regexp_replace(CASE WHEN p_partkey % 7 = 0 THEN 'models/' ELSE '' END || 'm-' || (p_size % 5) || '.' || (p_partkey % 4) || '-' || CASE p_partkey % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'flash-lite' ELSE 'pro' END
             || CASE WHEN p_partkey % 11 = 0 THEN '-preview' WHEN p_partkey % 13 = 0 THEN '/x' WHEN p_partkey % 17 = 0 THEN '..1' ELSE '' END, '^models/', '') AS name, p_size % 5 * 100 + p_partkey % 4 AS v FROM part),
    w AS (SELECT *, contains(name, 'flash') AS fl, contains(name, 'lite') AS li FROM m WHERE NOT contains(name, 'preview') AND NOT contains(name, '/') AND NOT contains(name, '..')),
    o AS (SELECT p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY fl DESC, CASE WHEN fl THEN NOT li END, CASE WHEN fl THEN -v END, CASE WHEN fl THEN name END, CASE WHEN NOT fl THEN p_partkey END)::INT AS nth FROM w)"""

def _grouped(v: str, digits: int) -> str:
    return rf"regexp_replace(regexp_replace(format('{{{{:,.{digits}f}}}}', round({v}, {digits})), '(\.\d*?)0+$', '\1'), '\.$', '')".replace("{{", "{").replace("}}", "}")


#: White space as Spark's patterns have it with (?U).
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"

ORACLES: dict[str, str] = {
    "indicator_long": f"WITH {_VALUES} SELECT code, year, place, round(value, 4) AS value FROM vals",
    "latest_year": f"WITH {_known('province')} SELECT code, g, year FROM latest",
    "peer_groups": f"WITH {_VALUES} SELECT x.place, y.place AS peer FROM places x JOIN places y ON x.type = y.type",
    "box_stats": f"WITH {_VALUES}, b AS (SELECT code, year, {_STATS} FROM vals GROUP BY ALL) SELECT code, year, n, round(avg, 4) AS avg, round(min, 4) AS min, round(q1, 4) AS q1, round(q3, 4) AS q3, round(max, 4) AS max FROM b",
    "analyze_one": f"WITH {_analysis('province')} SELECT {_ROUNDED} FROM ana WHERE place = 7",
    "analyze_all_provinces": f"WITH {_analysis('province')} SELECT {_ROUNDED} FROM ana",
    "analyze_all_types": f"WITH {_analysis('type')} SELECT {_ROUNDED} FROM ana",
    "analyze_all_nation": f"WITH {_analysis('nation')} SELECT {_ROUNDED} FROM ana",
    "band_split": f"WITH {_analysis('province')} SELECT place, code, CASE WHEN mine < q1 THEN 'below' WHEN mine > q3 THEN 'above' ELSE 'inside' END AS band FROM ana",
    "top_bottom": f"""WITH {_analysis('nation')}, r AS (SELECT place, code, rank::INT AS rank, n, (rank - 0.5) / n * 100 AS p FROM ana WHERE mine IS NOT NULL AND n >= 5),
        l AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY p, code) AS b, count(*) OVER (PARTITION BY place) AS m FROM r),
        x AS (SELECT *, CASE WHEN m < 4 THEN ceil(m / 2.0) ELSE 2 END AS hi, CASE WHEN m < 4 THEN m - ceil(m / 2.0) ELSE 2 END AS lo FROM l)
        SELECT place, code, CASE WHEN b <= hi THEN 'top' ELSE 'bottom' END AS list, rank, n FROM x WHERE b <= hi OR b > m - lo""",
    "trend_series": f"WITH {_TREND} SELECT place, code, year, round(mine, 4) AS mine, round(avg, 4) AS avg, n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(nation_avg, 4) AS nation_avg FROM tr",
    "trend_noteworthy": f"WITH {_TREND} SELECT place, code, years, round(score, 4) AS score FROM note",
    "trend_pick": f"""WITH {_TREND}, k AS (SELECT place, code, score FROM note QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, code) <= 2)
        SELECT place, code, round(score, 4) AS score, row_number() OVER (PARTITION BY place ORDER BY code)::INT AS ord FROM k""",
    "trend_request": f"""WITH {_TREND}, q AS (SELECT *, list_position(['B2', 'A3', 'A1', 'B1'], code) AS p FROM note WHERE code <> 'A2'), k AS (SELECT place, code, score, p FROM q QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, p) <= 2)
        SELECT place, code, round(score, 4) AS score, row_number() OVER (PARTITION BY place ORDER BY p)::INT AS ord FROM k""",
    "trend_direction": f"""WITH {_TREND}, e AS (SELECT place, code, arg_min(mine, year) AS first, arg_max(mine, year) AS last FROM tr WHERE mine IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
        SELECT place, code, round(first, 4) AS first, round(last, 4) AS last,
               CASE WHEN abs(last - first) < abs(coalesce(nullif(first, 0), 1)) * 0.02 THEN 'flat' WHEN last > first THEN 'up' ELSE 'down' END AS direction FROM e""",
    "chunk_rows": """WITH x AS (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part),
        y AS (SELECT *, ceil(n / ceil(n / 12.0))::BIGINT AS s FROM x)
        SELECT p_brand, p_partkey, (i // s)::INT AS chunk FROM y""",
    "tree_trail": f"WITH RECURSIVE {_NODES} SELECT id, depth, trail FROM t",
    "tree_preorder": f"WITH RECURSIVE {_NODES} SELECT id, row_number() OVER (ORDER BY path)::INT AS pos FROM t",
    "nearest_example_all": """WITH b AS (SELECT * FROM part WHERE coalesce(p_size <= 25, false)), e AS (SELECT * FROM part WHERE NOT coalesce(p_size <= 25, false))
        SELECT b.p_partkey AS id, (SELECT e.p_partkey FROM e WHERE e.p_brand = b.p_brand AND e.p_type = b.p_type ORDER BY abs(e.p_partkey - b.p_partkey), e.p_partkey LIMIT 1) AS example FROM b""",
    "title_dedupe": """SELECT c_custkey, CASE WHEN n > 1 THEN c_mktsegment || ' #' || n ELSE c_mktsegment END AS title
        FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)""",
    "col_percent": """WITH c AS (SELECT n_regionkey, n_nationkey, count(*) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
        e AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY n_regionkey)::DOUBLE AS e FROM c), f AS (SELECT *, floor(e) AS f FROM e),
        r AS (SELECT *, 100 - sum(f) OVER (PARTITION BY n_regionkey) AS l, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(e - f, 9) DESC, w DESC, n_nationkey) AS r FROM f)
        SELECT n_regionkey, n_nationkey, (f + CASE WHEN r <= l THEN 1 ELSE 0 END)::INT AS pct FROM r""",
    "outline_lines": r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r')) AS t, unnest(range(0, len(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'))))::INT AS ln FROM documents),
        s AS (SELECT doc_id, ln, regexp_replace(t, '^@+|@+$', '', 'g') AS t FROM l),
        k AS (SELECT doc_id, ln, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^\|[\s:|─-]+\|?$') THEN 'sep' WHEN starts_with(t, '|') THEN 'table'
              WHEN starts_with(t, '※') OR starts_with(t, '주)') OR starts_with(t, '자료:') OR starts_with(t, '자료：') THEN 'note' WHEN regexp_matches(t, '^(#{1,4}@|[○▪·-](@|$))') THEN 'item' ELSE 'text' END AS kind FROM s)
        SELECT doc_id, kind, count(*) AS n, min(ln) AS first FROM k GROUP BY ALL""".replace("@", _SPACE),
    "table_islands": f"""WITH {_LINES}, g AS (SELECT conv_id, ln, row_number() OVER (PARTITION BY conv_id ORDER BY ln) - row_number() OVER (PARTITION BY conv_id, kind = 'item' ORDER BY ln) AS g, kind FROM ms)
        SELECT conv_id, min(ln) AS first, max(ln) AS last, count(*) AS n FROM g WHERE kind = 'item' GROUP BY conv_id, g""",
    "level_jump": f"""WITH {_LINES}, j AS (SELECT conv_id, ln, lv AS level, lag(lv) OVER (PARTITION BY conv_id ORDER BY ln) AS before FROM ms WHERE kind = 'item')
        SELECT conv_id, ln, level, before FROM j WHERE level > before + 1""",
    "count_under": f"WITH {_UNDER} SELECT conv_id, ln, n::INT AS n FROM cu",
    "check_limits": f"""WITH {_UNDER}, lim(scope, key, op, n) AS (VALUES ('the', 'the', 'max', 2), ('a n d', 'and', 'min', 2), ('zzz', 'zzz', 'max', 1), ('t', 't', 'max', 1), ('ing', 'ing', 'max', NULL)),
        c AS (SELECT ms.conv_id, regexp_replace(ms.text, '\\s+', '', 'g') AS t, cu.n FROM ms JOIN cu USING (conv_id, ln)),
        b AS (SELECT conv_id, scope, max(c.n) AS best FROM c JOIN lim ON contains(t, key) WHERE lim.n IS NOT NULL AND length(key) > 1 GROUP BY ALL)
        SELECT k.conv_id, lim.scope, lim.op, lim.n::INT AS n, b.best::INT AS best, CASE WHEN lim.n IS NULL OR length(key) < 2 THEN 'unclear' WHEN b.conv_id IS NULL THEN 'missing' WHEN best IS NULL THEN 'empty' WHEN op = 'max' AND best > n THEN 'over' WHEN op = 'min' AND best < n THEN 'under' ELSE 'ok' END AS verdict
        FROM (SELECT DISTINCT conv_id FROM ms) k CROSS JOIN lim LEFT JOIN b ON b.conv_id = k.conv_id AND b.scope = lim.scope""",
    "find_limits": """SELECT o_orderkey, 0 AS i, '추진전략 ' || (o_orderkey % 9) || '개 이내' AS text, '추진전략' AS scope, 'max' AS op, (o_orderkey % 9)::INT AS n, '개' AS unit FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 1, '전략 3건 이상', '전략', 'min', 3, '건' FROM orders WHERE o_orderkey % 3 = 0
        UNION ALL SELECT o_orderkey, 0, '세부사업은 ' || (o_orderkey % 7) || '명 이하', '세부사업', 'max', (o_orderkey % 7)::INT, '명' FROM orders WHERE o_orderkey % 3 = 1
        UNION ALL SELECT o_orderkey, 0, '성과지표 4개 이상', '성과지표', 'min', 4, '개' FROM orders WHERE o_orderkey % 3 = 2""",
    "card_score": f"WITH {_CARDS} SELECT doc, target, id, score FROM sc",
    "card_pick": f"""WITH RECURSIVE {_CARDS}, o AS (SELECT doc || '-' || target AS key, id, ord, size, row_number() OVER (PARTITION BY doc, target ORDER BY score DESC, ord) AS i FROM sc WHERE score > 0),
        p AS (SELECT key, i, id, ord, CASE WHEN 5 + size + 1 > 90 THEN 5 ELSE 5 + size + 1 END AS used, 5 + size + 1 <= 90 AS got FROM o WHERE i = 1
          UNION ALL SELECT o.key, o.i, o.id, o.ord, CASE WHEN p.used + o.size + 1 > 90 THEN p.used ELSE p.used + o.size + 1 END, p.used + o.size + 1 <= 90 FROM p JOIN o ON o.key = p.key AND o.i = p.i + 1)
        SELECT key, ord, id FROM p WHERE got""",
    "number_tokens": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:\d[\d,]*(?:\.\d+)?)\s*(?:%|퍼센트|명|가구|개소|개|건|곳|억원|백만원|천원|원|년|세|회)') AS a FROM documents),
        u AS (SELECT doc_id, unnest(a) AS y, unnest(range(0, len(a))) AS i FROM t), f AS (SELECT doc_id, regexp_replace(y, '\s+', '', 'g') AS x, min(i) AS i FROM u GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM f)
        SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE r <= 12), '') AS numbers FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id""",
    "clip_text": r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)
        SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS clipped FROM s""",
    "html_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
    "csv_sniff": """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN ';' WHEN p_size % 3 = 1 THEN chr(9) ELSE ',' END AS delimiter FROM part""",
    "cap_cells": """WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, max(l_quantity::INT) AS rows, l_linenumber AS width FROM lineitem GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM t WHERE rows > 0),
        p AS (SELECT l_orderkey, l_linenumber, i, least(rows, greatest(1, 100 // width)) AS kept, least(rows, greatest(1, 100 // width)) * width AS used FROM o WHERE i = 1
          UNION ALL SELECT o.l_orderkey, o.l_linenumber, o.i, CASE WHEN used >= 100 THEN 0 ELSE least(o.rows, greatest(1, (100 - used) // o.width)) END,
            used + CASE WHEN used >= 100 THEN 0 ELSE least(o.rows, greatest(1, (100 - used) // o.width)) * o.width END FROM p JOIN o ON o.l_orderkey = p.l_orderkey AND o.i = p.i + 1)
        SELECT l_orderkey, l_linenumber, kept::INT AS kept FROM p""",
    "model_order": f"WITH {_NAMES} SELECT p_brand, name, nth FROM o",
}

ORACLES |= {
    "default_model": f"WITH {_NAMES} SELECT p_brand, arg_min(name, nth) AS name FROM o WHERE contains(name, 'flash-lite') GROUP BY ALL",
    "id_dedupe": """SELECT c_custkey, CASE WHEN n > 1 THEN c_mktsegment || '_' || n ELSE c_mktsegment END AS id
        FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)""",
    "tree_stats": f"WITH RECURSIVE {_NODES} SELECT root, count(*) AS nodes, count(*) FILTER (WHERE id NOT IN (SELECT parent FROM nodes WHERE parent IS NOT NULL)) AS leaves, max(depth) + 1 AS depth FROM t GROUP BY root",
    "col_percent_parts": """WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 1 THEN p_size END AS w0 FROM part), w AS (SELECT *, coalesce(w0, floor(avg(w0) OVER (PARTITION BY p_brand)), 1) AS w FROM p),
        e AS (SELECT *, 100 * w / sum(w) OVER (PARTITION BY p_brand)::DOUBLE AS e FROM w), f AS (SELECT *, floor(e) AS f FROM e),
        r AS (SELECT *, 100 - sum(f) OVER (PARTITION BY p_brand) AS l, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY round(e - f, 9) DESC, w DESC, p_partkey) AS r, row_number() OVER (PARTITION BY p_brand ORDER BY w DESC, p_partkey) AS s FROM f)
        SELECT p_brand, p_partkey, (f + CASE WHEN r <= l THEN 1 ELSE 0 END + CASE WHEN s = 1 THEN greatest(l - n, 0) ELSE 0 END)::INT AS pct FROM r""",
    "outline_numbers": f"""WITH {_LINES}, i AS (SELECT conv_id, ln, lv FROM ms WHERE kind = 'item'),
        a AS (SELECT *, coalesce((SELECT max(y.ln) FROM i y WHERE y.conv_id = x.conv_id AND y.ln < x.ln AND y.lv < x.lv), -1) AS above FROM i x)
        SELECT conv_id, ln, lv AS level, row_number() OVER (PARTITION BY conv_id, lv, above ORDER BY ln)::INT AS no FROM a""",
    "few_children": f"""WITH {_LINES}, i AS (SELECT conv_id, ln, lv FROM ms WHERE kind = 'item'),
        s AS (SELECT *, (SELECT min(y.ln) FROM i y WHERE y.conv_id = x.conv_id AND y.ln > x.ln AND y.lv <= x.lv) AS stop FROM i x),
        c AS (SELECT conv_id, ln, lv AS level, (SELECT count(*) FROM i y WHERE y.conv_id = s.conv_id AND y.ln > s.ln AND (stop IS NULL OR y.ln < stop) AND y.lv = s.lv + 1)::INT AS n FROM s)
        SELECT * FROM c WHERE n < 2""",
    "after_tables": f"""WITH {_LINES}, k AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY ln) AS b FROM ms WHERE kind = 'table' OR trim(text) <> '')
        SELECT conv_id, ln, kind FROM k WHERE b = 'table' AND kind <> 'table'""",
    "analyze_request": f"""WITH {_VALUES}, cur AS (SELECT v.*, p.province, p.type FROM vals v JOIN places p USING (place) WHERE year = 1998),
        me AS (SELECT * FROM cur WHERE place = 7), asked(ord, code, name, unit, area, area_name) AS (VALUES (0, 'B2', 'returned', '%', 'b', 'lines'), (2, 'A1', 'orders', '', NULL, NULL), (3, 'A2', 'A2', 'won', NULL, NULL)),
        g AS (SELECT code, {_STATS} FROM cur WHERE province = (SELECT DISTINCT province FROM me) GROUP BY code)
        SELECT asked.ord, 7 AS place, code, 1998 AS year, round(me.value, 4) AS mine, (1 + (SELECT count(*) FROM cur x WHERE x.code = me.code AND x.province = me.province AND x.value > me.value))::INT AS rank, n, round(avg, 4) AS avg, round(min, 4) AS min, round(q1, 4) AS q1,
          round(q3, 4) AS q3, round(max, 4) AS max, round((SELECT avg(value) FROM cur x WHERE x.code = me.code AND x.type = me.type), 4) AS peer_avg, (SELECT count(value) FROM cur x WHERE x.code = me.code AND x.type = me.type) AS peer_n,
          round((SELECT avg(value) FROM cur x WHERE x.code = me.code), 4) AS nation_avg, (SELECT count(value) FROM cur x WHERE x.code = me.code) AS nation_n, name, unit, area, area_name
        FROM asked JOIN me USING (code) JOIN g USING (code)""",
    "report_facts": f"""WITH {_analysis('province')}, x AS (SELECT place, code, n, year, CASE WHEN (place + length(code)) % 5 <> 0 THEN mine END AS mine FROM ana)
        SELECT place, count(*) AS codes, coalesce(min(n) FILTER (WHERE n > 0), 0) AS n_min, coalesce(max(n) FILTER (WHERE n > 0), 0) AS n_max, min(year) AS year_min, max(year) AS year_max, count(*) FILTER (WHERE mine IS NULL) AS missing,
               coalesce(array_to_string(list_sort(list(code) FILTER (WHERE mine IS NULL))[1:3], ', '), '') AS missing_names FROM x GROUP BY place""",
    "report_heads": f"""WITH {_analysis('province')}, x AS (SELECT place, code, n, year, CASE WHEN (place + length(code)) % 5 <> 0 THEN mine END AS mine FROM ana),
        f AS (SELECT place, count(*) AS codes, min(n) FILTER (n > 0) AS a, max(n) FILTER (n > 0) AS b, min(year) AS y, max(year) AS z, count(*) FILTER (mine IS NULL) AS m, array_to_string(list_sort(list(code) FILTER (WHERE mine IS NULL))[1:3], ', ') AS names FROM x GROUP BY place),
        t AS (SELECT f.*, p.province || CASE WHEN place % 2 = 0 THEN ' 가' ELSE ' 각' END AS title, type, CASE WHEN place % 2 = 0 THEN '는' ELSE '은' END AS eun FROM f JOIN places p USING (place)),
        l AS (SELECT place, list_filter(['#### 지표로 본 지역 여건', '', '○ 비교 기준 — ' || title || ', 광역(시·도) 내 비교, 대상 지표 ' || codes || '개',
            '- 비교집단 규모는 지표별로 ' || CASE WHEN a = b THEN b::VARCHAR ELSE a || '~' || b END || '개 시·군·구이며, 결측 지역은 평균 계산에서 뺐다', '- 각 지표는 자료가 나와 있는 최신연도 값을 썼다' || CASE WHEN y = z THEN ' (' || y || '년)' ELSE ' (' || y || '~' || z || '년 혼재)' END,
            CASE WHEN type IS NULL THEN '- ' || title || eun || ' 시·군·구 7유형 구분에 들어가 있지 않아 유형별 비교는 넣지 않았다' WHEN type <> 2 THEN '- ' || title || '의 시·군·구 유형은 유형 ' || type || '이고, 같은 유형 평균을 함께 적었다' END,
            CASE WHEN m > 0 THEN '- 값이 비어 있는 지표 ' || m || '개(' || names || CASE WHEN m > 3 THEN ' 등' ELSE '' END || ')는 해석에서 뺐다' END, ''], lambda v: v IS NOT NULL) AS ls FROM t)
        SELECT place, unnest(range(len(ls)))::INTEGER AS nth, unnest(ls) AS line FROM l""",
    "report_lists": f"""WITH {_analysis('nation')}, r AS (SELECT place, code, mine, q1, q3, (rank - 0.5) / n * 100 AS p FROM ana WHERE mine IS NOT NULL AND n >= 5),
        l AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY p, code) AS b, count(*) OVER (PARTITION BY place) AS m FROM r),
        x AS (SELECT *, CASE WHEN b <= CASE WHEN m < 2 THEN ceil(m / 2.0) ELSE 1 END THEN 'high' WHEN b > m - CASE WHEN m < 2 THEN m - ceil(m / 2.0) ELSE 1 END THEN 'low' WHEN mine < q1 OR mine > q3 THEN 'outside' ELSE 'inside' END AS list FROM l)
        SELECT place, code, list, (CASE list WHEN 'high' THEN b WHEN 'low' THEN m - b + 1 ELSE row_number() OVER (PARTITION BY place, list ORDER BY code) END)::INT AS nth, round(p, 4) AS position FROM x""",
    "trend_facts": f"""WITH {_TREND}, e AS (SELECT place, code, arg_min(mine, year) AS first, arg_max(mine, year) AS last, max(year) AS year, arg_max(mine - avg, year) AS gap FROM tr WHERE mine IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
        SELECT e.place, e.code, round(first, 4) AS first, round(last, 4) AS last, CASE WHEN abs(last - first) < abs(coalesce(nullif(first, 0), 1)) * 0.02 THEN 'flat' WHEN last > first THEN 'up' ELSE 'down' END AS direction,
               e.year, round(gap, 4) AS gap, last >= q1 AND last <= q3 AS within FROM e JOIN tr ON tr.place = e.place AND tr.code = e.code AND tr.year = e.year""",
    "place_names": """SELECT n_nationkey AS place, r_name || ' ' || n_name AS name, CASE WHEN n_nationkey % 7 < 5 THEN 'type ' || (n_nationkey % 7) END AS type_label FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region""",
    "provinces": "SELECT r_name AS province, row_number() OVER (ORDER BY min(n_nationkey))::INT AS ord FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "commonest_priority": """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY ALL)
        SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, k) = 1""",
    "majority_status": """WITH b AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS m FROM b)
        SELECT o_custkey, o_orderstatus, n FROM c WHERE o_orderstatus IS NOT NULL AND n >= greatest(1, floor(m / 2))""",
    "style_groups": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
        SELECT l_returnflag AS style, l_linestatus AS para, l_linenumber AS char, count(*) AS n, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY i) FILTER (WHERE i <= 3) AS samples FROM r GROUP BY ALL""",
    "match_ratio": f"WITH {_LINES} SELECT conv_id, round(avg((kind = 'item')::INT), 4) AS ratio, avg((kind = 'item')::INT) < 0.35 AS guess FROM ms GROUP BY ALL",
    "dangling_parts": "SELECT l_returnflag, count(DISTINCT l_partkey)::INT AS n, min(l_partkey) AS first, max(l_partkey) AS last FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 3) GROUP BY l_returnflag",
    **structures.ORACLES,
    **texts.oracles(_NODES),
    **manuscripts.ORACLES,
}

# Events 55 days later: the zone's clocks go from UTC-8 to UTC-7 at 10 in the morning UTC of the second Sunday of March, and a midnight after it is at 7.
_MOVED = """e AS (SELECT event_id, ts + INTERVAL 55 DAY AS t FROM events),
    dd AS (SELECT *, (t - CASE WHEN t >= TIMESTAMP '2024-03-10 10:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END)::DATE AS day FROM e),
    mv AS (SELECT *, day + INTERVAL 1 DAY + CASE WHEN day >= DATE '2024-03-10' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END AS z FROM dd)"""
# The zones of DuckDB come with an extension that may be missing; January, when events happen, is UTC-8 throughout.
ORACLES |= {
    "zone_day": f"WITH {_MOVED} SELECT event_id, day, epoch(z)::BIGINT AS reset FROM mv",
    "usage_ledger": "SELECT (ts - INTERVAL 8 HOUR)::DATE AS day, user_id AS model, count(*) AS n, bool_or(event_type = 'error') AS exhausted FROM events GROUP BY ALL",
    "usable_models": "SELECT (ts - INTERVAL 8 HOUR)::DATE AS day, user_id AS model, count(*) AS n FROM events GROUP BY ALL HAVING NOT bool_or(event_type = 'error')",
    "usage_limits": """WITH e AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'Flash-Lite' WHEN 2 THEN 'flash' ELSE 'pro' END || '-' || user_id AS model, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT END AS lim FROM events),
        l AS (SELECT (ts - INTERVAL 8 HOUR)::DATE AS day, model, user_id % 4 AS f, arg_max(lim, ts) FILTER (WHERE lim > 0) AS lim FROM e GROUP BY ALL)
        SELECT day, model, CASE WHEN lim > 0 THEN lim ELSE CASE f WHEN 1 THEN 1000 WHEN 2 THEN 250 WHEN 3 THEN 100 ELSE 0 END END AS rpd, CASE WHEN lim > 0 THEN 'observed' WHEN f > 0 THEN 'reference' ELSE 'unknown' END AS source,
               CASE f WHEN 1 THEN 'Flash-Lite' WHEN 2 THEN 'Flash' WHEN 3 THEN 'Pro' ELSE '' END AS label FROM l""",
    "usage_days": """WITH l AS (SELECT (ts - INTERVAL 8 HOUR)::DATE AS day, user_id AS model, count(*) AS n, bool_or(event_type = 'error') AS x FROM events GROUP BY ALL)
        SELECT day, sum(n)::BIGINT AS total, count(*) AS models, coalesce(string_agg(model::VARCHAR, ',' ORDER BY model) FILTER (WHERE x), '') AS exhausted FROM l GROUP BY day""",
    "until_reset": f"""WITH {_MOVED}, v AS (SELECT *, epoch(z)::BIGINT - floor(epoch(t))::BIGINT AS s FROM mv)
        SELECT event_id, (s // 3600)::INT AS hours, (s % 3600 // 60)::INT AS minutes, strftime(z + INTERVAL 9 HOUR, '%-m.%-d. %H:%M') AS "at" FROM v""",
    "stream_usage": "SELECT (ts - INTERVAL 8 HOUR)::DATE AS day, user_id AS model, count(*) AS n FROM events GROUP BY ALL",
    # %.1f and %.2f round the exact binary value; only values that are exactly half way differ, and there are none here
    "fmt_ref": rf"""WITH {_VALUES}, g AS (SELECT code, year, place, value AS v, abs(value) AS s FROM vals),
        a AS (SELECT *, CASE WHEN v IS NULL THEN '—' ELSE CASE WHEN s >= 1e12 THEN {_grouped('v / 1e12', 2)} || '조' WHEN s >= 1e8 THEN {_grouped('v / 1e8', 1)} || '억' WHEN s >= 1000 OR v = floor(v) THEN {_grouped('v', 3)} ELSE {_grouped('v', 2)} END END AS bare FROM g)
        SELECT code, year, place, CASE WHEN v IS NULL THEN '–' WHEN s >= 1e8 THEN bare WHEN s >= 1000 THEN format('{{:,.0f}}', round(v)) WHEN s >= 100 THEN printf('%.1f', v) ELSE printf('%.2f', v) END AS reference,
               CASE WHEN v IS NULL THEN bare ELSE bare || ' u' END AS amount FROM a""",
}
