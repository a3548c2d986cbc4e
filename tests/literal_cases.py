"""Cases over literal manuscripts, sections, cards, forms, messages and files; what they must give is in literal_expected.py."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import numbers, text
from tidewater.operators import cards, forms, indicators, ledger, markers, outline, tree
from tidewater.operators import sections as guide
from tidewater.session import shared_dir
from tidewater.sources import attachments, hwpx, series

import literal_rows as x
from literal_expected import EXPECTED


def manuscripts(s: SparkSession) -> DataFrame:
    return s.createDataFrame(x.MANUSCRIPTS, "id string, no string, title string, text string")


def sections(s: SparkSession) -> DataFrame:
    return s.createDataFrame(x.NODES, "id string, parent string, title string, ord int, has boolean, children int, forms int")


def _flat(rows) -> F.Column:
    """Rows of cells as one text: cells by |, rows by /."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), "/")


def marker_blocks(s: SparkSession, d: str) -> DataFrame:
    b = markers.blocks(manuscripts(s), "id", "text")
    return b.select("id", "line", "kind", "level", "text", _flat("rows").alias("rows"), "caption", F.array_join(F.transform("cols", lambda c: c.cast("int").cast("string")), ",").alias("cols"), "name")


def marker_footnotes(s: SparkSession, d: str) -> DataFrame:
    m = manuscripts(s)
    n = markers.footnotes(markers.blocks(m, "id", "text"), markers.definitions(m, "id", "text"), "id")
    return n.select("id", "line", "label", "note", "offset", "before", "after", "number", "use")


def marker_issues(s: SparkSession, d: str) -> DataFrame:
    return markers.issues(manuscripts(s), "id", "text")


def issue_tally(s: SparkSession, d: str) -> DataFrame:
    return markers.tally(markers.issues(manuscripts(s), "id", "text"), "id")


def marker_chapters(s: SparkSession, d: str) -> DataFrame:
    return markers.chapters(manuscripts(s), "id", "text")


def bar_tables(s: SparkSession, d: str) -> DataFrame:
    return outline.bar_tables(manuscripts(s), "id", "text").select("id", "ln", F.array_join("cells", "|").alias("cells"))


def table_shapes(s: SparkSession, d: str) -> DataFrame:
    return outline.table_shapes(manuscripts(s), "id", "text").select("id", "nth", F.array_join("header", "|").alias("header"), "cols", "n")


def form_issues(s: SparkSession, d: str) -> DataFrame:
    need = s.createDataFrame([("01-가", 1, ["전략 명", "과제"], 2), ("01-가", 2, ["x"], 1), ("02-가", 1, ["연도", "예산", None], 3)], "id string, nth int, header array<string>, cols int")
    return outline.form_issues(need, outline.table_shapes(manuscripts(s), "id", "text"), "id")


def _cards(s: SparkSession) -> DataFrame:
    c = cards.cards(manuscripts(s), "id", "no", "title", "text")
    parts = [F.col(n) for n in ("id", "no", "title", "names", "points", "tables", "numbers")]
    return c.withColumn("card", cards.card_text(*parts))


def card_texts(s: SparkSession, d: str) -> DataFrame:
    return _cards(s).select("id", F.array_join("heads", "/").alias("heads"), "card")


def card_context(s: SparkSession, d: str) -> DataFrame:
    """What each section is told of those before it."""
    n = sections(s).join(tree.mirrors(sections(s)), "id").select("id", "ord", "mirrors", cards.chapter(F.col("id")).alias("chapter"))
    have = _cards(s).select(F.col("id").alias("card_id"), "card").join(n.select(F.col("id").alias("card_id"), "ord", "chapter"), "card_id")
    t, c = n.alias("t"), have.withColumnRenamed("card_id", "id").alias("c")
    scored = t.join(c, F.col("c.ord") <= F.col("t.ord")).select(F.col("t.id").alias("target"), F.col("c.id"), F.col("c.ord"), cards.score().alias("score"), (text.units16(F.col("c.card")) + 0).alias("size"), F.col("c.card"))
    taken = cards.pick(scored.drop("card"), "target", 700, cards.HEADER_SIZE)
    return cards.context(taken.join(have.select(F.col("card_id").alias("id"), "card"), "id"), "target", "ord", "card")


def section_instructions(s: SparkSession, d: str) -> DataFrame:
    return tree.instructions(sections(s))


def section_mirrors(s: SparkSession, d: str) -> DataFrame:
    return tree.mirrors(sections(s))


def section_problems(s: SparkSession, d: str) -> DataFrame:
    twice = sections(s).union(sections(s).filter("id = '03'"))
    return tree.catalog_problems(twice)


def section_order(s: SparkSession, d: str) -> DataFrame:
    return tree.preorder(sections(s)).join(tree.trails(sections(s)), "id")


def section_stats(s: SparkSession, d: str) -> DataFrame:
    return forms.catalog_stats(sections(s))


def table_kinds(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame(x.TABLES, "id string, seq int, rows int, cols int, grid array<array<string>>, opened boolean")
    k = tree.table_kinds(t, "id", "seq", "◆ 작성 취지 및 방법 ◆", "작성양식 및 예시")
    h = F.when(F.col("kind") == "howto", tree.howto(F.array_join(F.flatten("grid"), "\n"), "◆ 작성 취지 및 방법 ◆"))
    return k.select("id", "seq", "kind", F.round(tree.fill_ratio(F.col("grid")), 4).alias("filled"), h["purpose"].alias("purpose"), h["method"].alias("method"))


def blank_forms(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame([("a", [(2, "blank"), (0, "howto"), (1, "blank")]), ("b", []), ("c", [(None, "blank"), (3, "blank")])], "id string, forms array<struct<idx:int,kind:string>>")
    return forms.blank_forms(f, "id")


def headings(s: SparkSession, d: str) -> DataFrame:
    h = s.createDataFrame([(1, "가. 목표"), (1, "[첨부 2] 자료"), (1, "1) 아님"), (2, " 3) 세부 "), (3, "(4) 더"), (3, "4) 아님")], "depth int, line string")
    one = F.coalesce(*[F.when(F.col("depth") == k, text.heading(F.col("line"), k)) for k in (1, 2, 3)])
    return h.select("depth", "line", one["no"].alias("no"), one["title"].alias("title"))


def contents(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("01제6기 방향  _ 76",), ("02재정_80",), ("머리말 _ 3",)], "line string").withColumn("t", text.toc_entry(F.col("line")))
    return t.select("line", "t.chapter", "t.page")


def message_faults(s: SparkSession, d: str) -> DataFrame:
    m = s.createDataFrame(x.MESSAGES, "id int, message string")
    return m.select("id", ledger.fault(F.col("message")).alias("fault"), ledger.limit_in(F.col("message")).alias("limit"), ledger.replacement_in(F.col("message")).alias("instead"))


def number_formats(s: SparkSession, d: str) -> DataFrame:
    v = s.createDataFrame([(i, v) for i, v in enumerate([0.123456, 12.5, 250.44, 1.005, 1234.56, 3.4e8, 5.1e12, -0.005, -1234.5, 999.95, float("nan"), None])], "i int, v double")
    return v.select("i", numbers.amount(F.when(~F.isnan("v"), F.col("v")), "%").alias("amount"), numbers.reference(F.col("v")).alias("reference"), numbers.plain(F.col("v")).alias("plain"))


def axis_ticks(s: SparkSession, d: str) -> DataFrame:
    v = s.createDataFrame([(1, -3.2, 1.8), (2, 0.0, 0.0), (3, 0.0, 100.0), (4, 0.013, 0.019)], "i int, low double, high double")
    return v.select("i", F.posexplode(numbers.ticks(F.col("low"), F.col("high"))).alias("nth", "tick"))


def text_tools(s: SparkSession, d: str) -> DataFrame:
    """Small text functions, one result a row."""
    one = lambda name, c: F.struct(F.lit(name).alias("what"), c.cast("string").alias("result"))
    t, v = F.lit, text
    attrs = v.split_attrs(t('기획부 {fill=#dce, Link="점선"}'))
    rows = [
        one("bullet", v.marker_of(t("•"))), one("square", v.marker_of(t("■"))), one("no bullet", v.marker_of(t("x"))), one("fence", v.strip_fence(t("```md\nhi\n``` "))), one("cell", v.table_cell(t(" a|b\nc "))),
        one("empty cell", v.table_cell(t("  "))), one("file name", v.safe_name(t("a/b: c"))), one("column", v.column_index(t("BC12"))), one("no column", v.column_index(t("12"))), one("after a final", v.particle(t("집"))),
        one("after a vowel", v.particle(t("나"))), one("archive path", v.zip_path(t("xl"), t("../a/./b"))), one("root path", v.zip_path(t("xl"), t("/xl/c"))), one("extension", v.extension(t("a.B.Txt"))), one("no extension", v.extension(t("abc"))),
        one("short", v.ellipsize(t("가나다라마"), 10.0, 35.0)), one("fits", v.ellipsize(t("가나"), 10.0, 35.0)), one("width", F.round(v.text_width(t("a i가–"), 10.0), 4)), one("lines", F.size(v.split_lines(t("a b\r\nc\n")))), one("no lines", F.size(v.split_lines(t("")))),
        one("header", v.header_line(F.array(t("a\nb"), t(None)))), one("no header", v.header_line(F.array(t(" "), t(None)))), one("limit", v.limit_sentence(t("전략"), t("max"), t(5), t("개"), t("전략 5개 이내"))), one("least", v.limit_sentence(t(None), t("min"), t(None).cast("int"), t(""), t(None))),
        one("attrs text", attrs["text"]), one("fill", v.color(attrs["attrs"]["fill"])), one("link", v.line_type(attrs["attrs"]["link"])), one("no color", v.color(t("red"))), one("round half even", F.bround(t(2.5), 0).cast("int")), one("crc32", F.crc32(t("123456789").cast("binary"))),
        one("units", v.units16(t("a😀"))), one("clip", v.clip(t(" a　 bcdef"), 4)), one("chapter", cards.chapter(t("03-나-1"))),
        one("basis", indicators.basis_label(t("province"))), one("unknown basis", indicators.basis_label(t("planet"))), one("shown", v.shown(t("가나다"), 2)), one("bar table", v.bar_table(F.array(F.array(t("a|b"), t("c")), F.array(t("d")), F.array(t("e"))), t(2), 2)),
        one("diagram", v.diagram_header(t('type=flow title="a b" line_style=dash'))["title"]), one("diagram type", v.diagram_header(t("type=pie"))["type"]), one("diagram option", v.diagram_header(t("x=1 x='2'"))["options"]["x"]),
    ]
    return s.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.what", "r.result")


def indent_tree(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("a", "본부 {fill=#123456}\n  - 기획과\n\t\t팀\n  재무과\n\n지부\n    먼 팀\n  가까운 팀"), ("b", "")], "id string, text string")
    return markers.indent_tree(t, "id", "text").select("id", "ln", "parent", "depth", "text", F.array_join(F.map_values("attrs"), ",").alias("attrs"))


def diagram_relations(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([("d", "a", 0), ("d", "b", 1), ("d", "c", 2)], "id string, name string, at int")
    l = s.createDataFrame([("d", "a", "b"), ("d", "c", "b"), ("d", "a", "c"), ("d", "a", "q")], "id string, a string, b string")
    return forms.relations(l, t, "id")


def package_entries(s: SparkSession, d: str) -> DataFrame:
    p = s.createDataFrame([(1, ["mimetype", "x"], ["k2", "k1"], ["k1", "k3"]), (2, ["META-INF/container.xml", "mimetype"], [], ["k"])], "id int, have array<string>, tokens array<string>, blocks array<string>")
    b = forms.placed_blocks(F.col("tokens"), F.col("blocks"))
    return p.select("id", F.array_join(forms.missing_entries(F.col("have"), ("mimetype", "META-INF/container.xml")), ",").alias("missing"), F.array_join(b["placed"], ",").alias("placed"), F.array_join(b["missing"], ",").alias("lost"))


def attachment_files(s: SparkSession, d: str) -> DataFrame:
    f = s.createDataFrame(x.files(), "name string, content binary")
    return attachments.extract_files(f).select("name", "ext", "mode", "text", F.array_join(F.transform("tables", _flat), " # ").alias("tables"), "inline", F.col("error").isNotNull().alias("failed"))


def series_files(s: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(s)}/series-{uuid.uuid4().hex}"
    s.createDataFrame([(t,) for t in x.SERIES], "value string").repartition(2).write.text(path)
    return series.read_series(s, path)


def _packages(s: SparkSession) -> DataFrame:
    return s.createDataFrame(x.packages(), "name string, content binary")


def package_paragraphs(s: SparkSession, d: str) -> DataFrame:
    p = hwpx.paragraphs(_packages(s))
    return p.select("name", "part", "ln", "style", "para", "char", "kind", "text", F.array_join("notes", "/").alias("notes"), _flat("grid").alias("cells"), F.array_join(F.transform("widths", lambda w: w.cast("string")), ",").alias("widths"), F.col("error").isNotNull().alias("failed"))


def package_styles(s: SparkSession, d: str) -> DataFrame:
    return hwpx.styles(_packages(s)).filter("error is null").drop("error")


def package_verdict(s: SparkSession, d: str) -> DataFrame:
    v = hwpx.verdict(hwpx.entries(_packages(s)))
    return v.select("name", F.regexp_replace("problem", "^(can't be opened).*", "$1").alias("problem"))


def package_text(s: SparkSession, d: str) -> DataFrame:
    """Marked text of the body part, by the styles of a form."""
    levels = s.createDataFrame([(1, "#"), (2, "○"), (17, "※")], "style int, marker string")
    body = hwpx.body_part(hwpx.paragraphs(_packages(s)), "Contents/section1.xml", hwpx.entries(_packages(s)))
    return hwpx.marker_text(hwpx.marker_lines(body, levels, 17)).withColumn("ratio", F.round("ratio", 4))


def package_references(s: SparkSession, d: str) -> DataFrame:
    r = hwpx.references(_packages(s)).filter("error is null")
    gone = forms.dangling(r.filter("not defined"), r.filter("defined"), "name", "attr", "ref")
    return gone.select("name", "attr", F.array_join(F.transform("missing", lambda m: m.cast("string")), ",").alias("missing"))


def package_bullets(s: SparkSession, d: str) -> DataFrame:
    return hwpx.double_bullets(hwpx.paragraphs(_packages(s)), s.createDataFrame([(3, "○")], "para int, bullet string"))


def package_style_names(s: SparkSession, d: str) -> DataFrame:
    """Styles that a form counts on and that have another name or are gone, and the style of table notes by its name."""
    shapes = hwpx.styles(_packages(s)).filter("error is null")
    changed = hwpx.changed_styles(shapes, s.createDataFrame([(1, "제목"), (2, "요약"), (3, "점")], "style int, name string"))
    note = hwpx.style_named(shapes, ["표 주", "주, 자료"]).select("name", "style", F.lit("주, 자료").alias("want"), F.lit("주, 자료").alias("have"))
    return changed.select("name", "style", "want", "have").union(note)


def _written(s: SparkSession, *texts: str) -> list[str]:
    folder = f"{shared_dir(s)}/json-{uuid.uuid4().hex}"
    for i, t in enumerate(texts):
        s.createDataFrame([(t,)], "value string").coalesce(1).write.text(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(len(texts))]


def catalog_file(s: SparkSession, d: str) -> DataFrame:
    n = series.read_catalog(s, _written(s, x.CATALOG)[0])
    return n.select("ord", "id", "depth", "no", "title", "parent", F.array_join("children", ",").alias("children"), F.coalesce(F.size("forms"), F.lit(0)).alias("forms"), F.try_element_at("limits", F.lit(1))["scope"].alias("scope"))


def index_files(s: SparkSession, d: str) -> DataFrame:
    """Places with their names and types' labels, beside the items."""
    items, types, places = series.read_index(s, *_written(s, *x.INDEX))
    named = indicators.place_names(places, types)
    return items.select("code", F.col("name").alias("item")).join(named)  # one item


def style_issues(s: SparkSession, d: str) -> DataFrame:
    more = s.createDataFrame([("x", "", "", "# 제목.\n○ 한 문장.\n- 두 문장. 또 하나\n- 둘. 셋.\n○ 글 ○ 속\n▪ 끝")], "id string, no string, title string, text string")
    b = markers.blocks(manuscripts(s).union(more), "id", "text")
    return markers.style_issues(b, "id", least={"h1": 1, "b1": 1, "b2": 2})


def guide_catalog(s: SparkSession, d: str) -> DataFrame:
    g = s.createDataFrame([("g", *r) for r in x.GUIDE], "doc string, ln int, style int, text string, grid array<array<string>>, banner struct<no:string,title:string>")
    c = guide.catalog(g, "doc")
    limits = F.array_join(F.transform("limits", lambda v: F.concat_ws(" ", v["scope"], v["op"], v["n"].cast("string"), v["unit"])), ";")
    return c.select("ord", "id", "depth", "no", "title", "parent", "forms", "required", "has", "purpose", "method", "fixed", F.array_join("markers", "").alias("markers"), limits.alias("limits"))


def guide_forms(s: SparkSession, d: str) -> DataFrame:
    g = s.createDataFrame([("g", *r) for r in x.GUIDE], "doc string, ln int, style int, text string, grid array<array<string>>, banner struct<no:string,title:string>")
    return guide.forms(guide.headed(g, "doc"), "doc").select("sec", "idx", "seq", "kind", "rows", "cols", F.array_join("header", "|").alias("header"), F.round("filled", 4).alias("filled"))


def preferred_models(s: SparkSession, d: str) -> DataFrame:
    m = s.createDataFrame([(k, n, i) for k in (1, 2, 3) for i, n in enumerate(["a-pro", "m-2.0-flash-lite", "m-2.5-flash"])], "k int, name string, at int")
    worked = s.createDataFrame([(1, "m-2.5-flash", 1), (1, "a-pro", 2), (2, "gone", 1)], "k int, name string, ts int")
    return ledger.preferred_model(m, worked, ["k"], "name", "at", "ts")


CASES = {
    f.__name__: f
    for f in (
        marker_blocks, marker_footnotes, marker_issues, issue_tally, marker_chapters, bar_tables, table_shapes, form_issues, card_texts, card_context, section_instructions, section_mirrors,
        section_problems, section_order, section_stats, table_kinds, blank_forms, headings, contents, message_faults, number_formats, axis_ticks, text_tools, indent_tree, diagram_relations, package_entries, attachment_files,
        series_files, package_paragraphs, package_styles, package_verdict, package_text, package_references, package_bullets, package_style_names, catalog_file, index_files,
        style_issues, guide_catalog, guide_forms, preferred_models,
    )
}
