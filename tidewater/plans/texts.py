"""Text functions, sections and bar tables over the given tables, each with SQL that restates its rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import numbers, text
from tidewater.operators import cards, forms, indicators, ledger, markers, outline, profiles, tree

from . import adapters as a

L = F.lit


def _lines(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, ln, line): lines of all documents."""
    return a.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "line"))


def file_names(s: SparkSession, d: str) -> DataFrame:
    """Addresses of pages as file names, what follows their last dot, and paths of archives made of their last part."""
    p = a.table(s, d, "pages").withColumn("end", F.substring_index("url", "/", -1))
    kind = F.col("page_id") % 3
    target = F.when(kind == 0, F.concat(L("../"), "end", L("/./x"))).when(kind == 1, F.concat(L("/"), "end", L("/x"))).otherwise(F.concat("end", L("/../t")))
    return p.select("page_id", text.safe_name(F.col("url"), 40).alias("name"), text.extension(F.col("end")).alias("ext"), text.zip_path(L("a/b"), target).alias("path"))


def line_cells(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as cells of bar tables, without fences, as headers, and what bullets their first characters are."""
    x = _lines(s, d)
    sign = F.substring(L("⧠❑■▢－–—∙•･‧◦〇◯□○-·※A"), (F.col("ln") % 20 + 1).cast("int"), L(1))
    fenced = F.concat(L("```md\n"), "line", L("``` "))
    return x.select("doc_id", "ln", text.table_cell(F.concat(L("a |\t"), "line")).alias("cell"), text.strip_fence(F.when(F.col("ln") % 2 == 0, fenced).otherwise(F.col("line"))).alias("bare"), text.header_line(F.array(F.substring("line", 1, 9), L(None), F.substring("line", 10, 9))).alias("header"), text.marker_of(sign).alias("marker"))


def line_counts(s: SparkSession, d: str) -> DataFrame:
    return a.table(s, d, "documents").select("doc_id", F.size(text.split_lines(F.coalesce("text", L("")))).alias("n"))


def particles(s: SparkSession, d: str) -> DataFrame:
    """The particle after each syllable of Hangul that a part's number gives, and after a letter."""
    k = F.col("p_partkey")
    syllable = F.decode(F.unhex(F.hex(44032 + k % 11172)), "UTF-16BE")
    return a.table(s, d, "part").select("p_partkey", text.particle(F.when(k % 10 == 0, L("x")).otherwise(syllable)).alias("particle"))


def sheet_columns(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    letter = lambda n: F.substring(L("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n % 26 + 1).cast("int"), L(1))
    cell = F.concat(F.when(k % 5 > 0, F.concat(letter(k), letter(F.floor(k / 26)))).otherwise(""), k.cast("string"))
    return a.table(s, d, "part").select("p_partkey", text.column_index(cell).alias("at"))


def limit_sentences(s: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    said = text.limit_sentence(F.when(size % 7 > 0, F.col("p_brand")), F.when(size % 2 == 0, "min").otherwise("max"), F.when(size % 11 > 0, size), F.when(size % 3 > 0, "건").otherwise(""), F.when(size % 5 > 0, F.col("p_name")))
    return a.table(s, d, "part").select("p_partkey", said.alias("said"))


def text_widths(s: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", L(" 표–i"))
    return a.table(s, d, "part").select("p_partkey", F.round(text.text_width(name, 10.0), 4).alias("width"), text.ellipsize(name, 10.0, 75.0).alias("shown"))


def inline_styles(s: SparkSession, d: str) -> DataFrame:
    """Names of parts with styles behind them."""
    k = F.col("p_size")
    line = F.when(k % 3 == 0, "점선").when(k % 3 == 1, "Long-Dash").otherwise("wavy")
    said = F.concat("p_name", L(" {fill="), F.when(k % 2 == 0, "#d").otherwise("q"), F.lpad(k.cast("string"), 2, "0"), L(', Link="'), line, L("\" note='a b'}"))
    x = a.table(s, d, "part").select("p_partkey", text.split_attrs(said).alias("x"))
    at = lambda n: F.element_at("x.attrs", n)
    return x.select("p_partkey", "x.text", text.color(at("fill")).alias("fill"), text.line_type(at("link")).alias("line"), at("note").alias("note"))


def basis_labels(s: SparkSession, d: str) -> DataFrame:
    seg = F.element_at(F.array(*map(L, (*indicators.BASES, "planet"))), (F.col("c_custkey") % (len(indicators.BASES) + 1) + 1).cast("int"))
    return a.table(s, d, "customer").select("c_custkey", indicators.basis_label(seg).alias("label"), cards.chapter(F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment")).alias("chapter"))


def message_faults(s: SparkSession, d: str) -> DataFrame:
    """Messages made of events: the fault, the limit and the model to use instead."""
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 8
    said = (
        F.when(k == 0, "API key not valid").when(k == 1, F.concat(u, L(" credits are depleted"))).when(k == 2, F.concat(L("Quota: requests_per_day, Limit: "), u))
        .when(k == 3, F.concat(L("This model is no longer available. Use models/x-"), u, L("-flash"))).when(k == 4, "use models/y-preview or models/z").when(k == 5, F.concat(L("slow down "), "event_type"))
        .when(k == 6, F.concat(L("PERMISSION per  day limit:"), u))
    )
    return a.table(s, d, "events").withColumn("m", said).select("event_id", ledger.fault(F.col("m")).alias("fault"), ledger.limit_in(F.col("m")).alias("limit"), ledger.replacement_in(F.col("m")).alias("instead"))


def headings(s: SparkSession, d: str) -> DataFrame:
    n, k = F.col("ln"), F.col("ln") % 6
    said = F.concat(F.when(k == 0, "가. ").when(k == 1, F.concat(L(" [첨부 "), n.cast("string"), L("] "))).when(k == 2, F.concat(n.cast("string"), L(") "))).when(k == 3, F.concat(L("  ("), n.cast("string"), L(")"))).when(k == 4, "").otherwise("나."), "line")
    x = _lines(s, d).withColumns({"said": said, "depth": ((F.col("doc_id") + n) % 3 + 1).cast("int")})
    one = F.coalesce(*[F.when(F.col("depth") == i, text.heading(F.col("said"), i)) for i in (1, 2, 3)])
    return x.select("doc_id", "ln", "depth", one["no"].alias("no"), one["title"].alias("title"))


def contents(s: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.when(F.col("ln") % 5 < 4, F.lpad((F.col("ln") % 90).cast("string"), 2, "0")).otherwise(""), F.substring("line", 1, 12), L("  _ "), F.length("line").cast("string"))
    x = _lines(s, d).withColumn("t", text.toc_entry(said))
    return x.select("doc_id", "ln", "t.chapter", "t.page")


def axis_ticks(s: SparkSession, d: str) -> DataFrame:
    """Ticks between the lowest and the highest price of each brand and size."""
    x = a.table(s, d, "part").groupBy("p_brand", "p_size").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return x.select("p_brand", "p_size", F.posexplode(numbers.ticks(F.col("low"), F.col("high"))).alias("nth", "tick"))


def _sections(s: SparkSession, d: str) -> DataFrame:
    """The forest of nodes as sections: titles of strategies, which have instructions, how many children and forms."""
    n = a.nodes(s, d)
    count = n.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").cast("int").alias("children"))
    title = F.when(F.col("ord") % 4 == 0, F.concat(L("[주민 전략 "), (F.col("ord") % 3 + 1).cast("string"), L("_"), "title", L("]"))).otherwise(F.col("title"))
    return n.join(count, "id", "left").select("id", "parent", title.alias("title"), "ord", ((F.length("id") + F.col("ord")) % 5 == 0).alias("has"), F.coalesce("children", L(0)).alias("children"), (F.col("ord") % 3).cast("int").alias("forms"))


def section_mirrors(s: SparkSession, d: str) -> DataFrame:
    return tree.mirrors(_sections(s, d))


def section_instructions(s: SparkSession, d: str) -> DataFrame:
    """Whose instructions each section goes by."""
    return tree.instructions(_sections(s, d))


def section_stats(s: SparkSession, d: str) -> DataFrame:
    return forms.catalog_stats(_sections(s, d))


def section_problems(s: SparkSession, d: str) -> DataFrame:
    """The forest with every 50th section twice, and parts whose chain is a circle."""
    n = a.nodes(s, d)
    last = F.concat(L("p"), (F.col("ord") - 61).cast("string"))
    ring = F.when(F.col("id").startswith("p") & ((F.col("ord") - 101) % 80 == 0), last).otherwise(F.col("parent"))
    x = n.withColumn("parent", ring)
    return tree.catalog_problems(x.union(x.filter("ord % 50 = 0")))


def blank_forms(s: SparkSession, d: str) -> DataFrame:
    """Lines of orders as forms of sections: those returned have instructions, every seventh has no number."""
    form = F.struct(F.when(F.col("l_partkey") % 7 > 0, F.col("l_linenumber")).alias("idx"), F.when(F.col("l_returnflag") == "R", "howto").otherwise("blank").alias("kind"))
    x = a.table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(form).alias("forms"))
    return forms.blank_forms(x, "l_orderkey")


def diagram_relations(s: SparkSession, d: str) -> DataFrame:
    """Suppliers of a nation as the tables of a diagram, each related to those one, two and eight numbers on."""
    t = a.table(s, d, "supplier").withColumn("at", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    links = t.select("s_nationkey", F.col("s_name").alias("a"), "at", F.explode(F.array(L(1), L(-1), L(2), L(80))).alias("step"))
    named = t.select("s_nationkey", F.col("at").alias("to"), F.col("s_name").alias("b"))
    links = links.withColumn("to", F.col("at") + F.col("step")).join(named, ["s_nationkey", "to"], "left").select("s_nationkey", "a", F.coalesce("b", F.concat(L("none "), F.col("to").cast("string"))).alias("b"))
    return forms.relations(links, t.select("s_nationkey", F.col("s_name").alias("name"), "at"), "s_nationkey")


def package_entries(s: SparkSession, d: str) -> DataFrame:
    """Words of a part's name as entries of a package and as tokens in its text, those of its type as blocks."""
    p = a.table(s, d, "part").select("p_partkey", F.array_distinct(F.split("p_name", " ")).alias("have"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1))), " ")).alias("blocks"))
    b = forms.placed_blocks(F.col("have"), F.col("blocks"))
    return p.select("p_partkey", F.array_join(forms.missing_entries(F.col("have"), ("part", "red", "blue")), ",").alias("missing"), F.array_join(b["placed"], ",").alias("placed"), F.array_join(b["missing"], ",").alias("lost"))


def indent_tree(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as an indented list; the indent follows from a line's length."""
    said = F.concat(F.repeat(L(" "), (F.length("line") % 4 * 2).cast("int")), F.when(F.col("ln") % 3 == 0, "- ").otherwise(""), "line")
    x = _lines(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", said.alias("t")))), lambda v: v["t"]), "\n").alias("text"))
    t = markers.indent_tree(x, "doc_id", "text")
    return t.select("doc_id", "ln", "parent", "depth", F.sha2("text", 256).alias("text"))


def _tables(s: SparkSession, d: str) -> DataFrame:
    """Documents whose lines are rows of bar tables but for every seventh; every fifth row is a separator."""
    words = F.slice(F.split(F.trim("line"), " "), 1, (F.length("line") % 3 + 1).cast("int"))
    said = F.when(F.col("ln") % 7 == 6, F.col("line")).when(F.col("ln") % 5 == 1, L("|---|:--|")).when(F.col("ln") % 11 == 4, L("")).otherwise(F.concat(L("| "), F.array_join(words, " | "), L(" |")))
    x = _lines(s, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", said.alias("t")))), lambda v: v["t"]), "\n").alias("text"))
    return x


def bar_tables(s: SparkSession, d: str) -> DataFrame:
    t = outline.bar_tables(_tables(s, d), "doc_id", "text")
    return t.select("doc_id", "tab", "ln", F.array_join("cells", "|").alias("cells")).withColumn("tab", F.dense_rank().over(W.partitionBy("doc_id").orderBy("tab")))


def table_shapes(s: SparkSession, d: str) -> DataFrame:
    t = outline.table_shapes(_tables(s, d), "doc_id", "text")
    return t.select("doc_id", "nth", F.array_join("header", "|").alias("header"), "cols", "n")


def form_issues(s: SparkSession, d: str) -> DataFrame:
    """Where the tables of a document differ from those that the document before it has."""
    found = outline.table_shapes(_tables(s, d), "doc_id", "text")
    need = found.withColumn("doc_id", F.col("doc_id") + 1).join(a.table(s, d, "documents").select("doc_id").distinct(), "doc_id", "left_semi")
    return outline.form_issues(need.select("doc_id", "nth", "header", "cols"), found, "doc_id")


def sections_found(s: SparkSession, d: str) -> DataFrame:
    """The sections of suppliers' and orders' customers by their number; some aren't there."""
    wanted = a.table(s, d, "orders").select("o_orderkey", F.concat(F.when(F.col("o_orderkey") % 5 > 0, "c").otherwise("x"), F.col("o_custkey").cast("string")).alias("wanted"))
    return tree.sections(a.nodes(s, d), wanted, "wanted").select("o_orderkey", "parent", "title")


def _layers(s: SparkSession, d: str) -> DataFrame:
    """(p_partkey, layer, text): three layers of settings of each part; some are missing or no objects."""
    n, k = F.col("p_size"), F.col("p_partkey")
    json = lambda **c: F.to_json(F.struct(*[v.alias(x) for x, v in c.items()]))
    base = F.to_json(F.struct(F.struct(n.alias("b"), F.col("p_type").alias("c")).alias("a"), F.col("p_brand").alias("d"), F.struct(F.struct(L(1).alias("g"), F.array(n, k).alias("l")).alias("f")).alias("e")))
    user = F.when(n % 4 == 0, "not JSON").when(n % 4 == 1, F.to_json(F.struct(F.struct(F.col("p_name").alias("b")).alias("a"), F.struct(L(2).alias("f")).alias("e")))).when(n % 4 == 2, json(a=L(5), z=n)).otherwise('{"d": null, "a": {}, "y": {}}')
    last = F.when(n % 3 == 0, F.to_json(F.struct(F.struct(F.struct(n.alias("h")).alias("f")).alias("e"), F.struct(L(True).alias("q")).alias("a")))).when(n % 3 == 1, '{"e": {}, "y": {"x": "{}"}}')
    p = a.table(s, d, "part")
    return p.select("p_partkey", F.explode(F.array(*[F.struct(L(i).alias("layer"), t.alias("text")) for i, t in enumerate((base, user, last))])).alias("x")).select("p_partkey", "x.layer", "x.text")


def merged_profiles(s: SparkSession, d: str) -> DataFrame:
    x = profiles.merged(_layers(s, d), "p_partkey", "layer", "text")
    return x.select("p_partkey", F.array_join("path", ".").alias("path"), "value")


MARK, OPENS = "◆ 작성 취지 및 방법 ◆", "작성양식 및 예시"


def table_kinds(s: SparkSession, d: str) -> DataFrame:
    """Lines with a part as tables of a section, in order: boxes of instructions, notes, and grids that are filled more or less."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    n, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    cell = lambda i, j: F.when((n * (i + 1) + j * 3 + k) % 5 < 2, F.when(j == 0, " ")).otherwise("v")
    grid = F.transform(F.sequence(L(0), 1 + n % 2), lambda i: F.transform(F.sequence(L(0), n % 3), lambda j: cell(i, j)))
    said = F.concat(L(MARK + "\n작성 취지: "), "l_returnflag", F.when(n % 2 == 0, F.concat(L("\n작성  방법: "), "l_linestatus", L(" "))).otherwise(""))
    box = F.array(F.array(F.when(k % 3 > 0, said).otherwise(F.concat(L(MARK + "작성방법 먼저 작성 취지 "), "l_linestatus"))), F.array(L("")))
    lines = a.table(s, d, "lineitem")
    # the parts of a task are sorted in its memory, so tasks grow in number and not in size; up to 200 tasks are dealt to without sorting
    lines = a.dealt(lines, "l_partkey", lines.count(), 1_200_000)
    t = lines.select("l_partkey", *order, F.when(n % 9 == 0, box).when(n % 9 == 1, F.array(F.array(L(" ※ note")))).otherwise(grid).alias("grid"), (F.col("l_linenumber") == 2).alias("opened"))
    # what is shown of a grid is taken here, so that no grid is sorted
    t = t.withColumns({"rows": F.size("grid"), "cols": F.size(F.col("grid")[0]), "filled": F.round(tree.fill_ratio(F.col("grid")), 4), "raw": F.array_join(F.flatten("grid"), "\n")})
    h = F.when(F.col("raw").contains(MARK), tree.howto(F.col("raw"), MARK))
    t = t.withColumns({"purpose": h["purpose"], "method": h["method"]})
    x = tree.table_kinds(t, "l_partkey", order, MARK, OPENS)
    seq = F.row_number().over(W.partitionBy("l_partkey").orderBy(*order))
    return x.select("l_partkey", seq.alias("seq"), "kind", "filled", "purpose", "method")


QUERIES = {f.__name__: f for f in (
    file_names, line_cells, line_counts, particles, sheet_columns, limit_sentences, text_widths, inline_styles, basis_labels, message_faults, headings, contents, axis_ticks, section_mirrors, section_instructions, section_stats,
    section_problems, blank_forms, diagram_relations, package_entries, indent_tree, bar_tables, table_shapes, form_issues, sections_found, merged_profiles, table_kinds,
)}

_S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_DOC_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS ln FROM documents WHERE text IS NOT NULL)"
_WIDTH = "list_sum(list_transform(string_split({}, ''), lambda c: CASE WHEN c = ' ' OR contains('iIl.,:;''`|!', c) THEN 0.30 WHEN unicode(c) < 128 THEN 0.56 WHEN unicode(c) >= 8192 AND unicode(c) < 8448 THEN 0.62 ELSE 1.0 END::DOUBLE)) * 10"
_SECTIONS = """sec AS (SELECT id, n.parent, CASE WHEN ord % 4 = 0 THEN '[주민 전략 ' || (ord % 3 + 1) || '_' || title || ']' ELSE title END AS title, ord, (length(id) + ord) % 5 = 0 AS has, coalesce(k, 0) AS children, (ord % 3)::INTEGER AS forms
        FROM nodes n LEFT JOIN (SELECT parent, count(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY parent) c ON c.parent = n.id)"""
_BARS = rf"""{_DOC_LINES},
    w AS (SELECT doc_id, ln, CASE WHEN ln % 7 = 6 THEN line WHEN ln % 5 = 1 THEN '|---|:--|' WHEN ln % 11 = 4 THEN '' ELSE '| ' || array_to_string(string_split(trim(line), ' ')[1:length(line) % 3 + 1], ' | ') || ' |' END AS t FROM l),
    y AS (SELECT doc_id, ln, regexp_replace(t, '^{_S}+|{_S}+$', '', 'g') AS t FROM w),
    x AS (SELECT *, starts_with(t, '|') AND ends_with(t, '|') AND length(t) > 2 AS bar FROM y),
    z AS (SELECT *, bar AND regexp_matches(substring(t, 2, length(t) - 2), '^[\s:|-]+$') AS sep, sum((NOT bar AND t <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY ln) AS tab FROM x),
    r AS (SELECT doc_id, tab, ln, list_transform(string_split(substring(t, 2, length(t) - 2), '|'), lambda c: trim(c)) AS cells FROM z WHERE bar AND NOT sep)"""
_SHAPES = f"""{_BARS}, g AS (SELECT doc_id, tab, arg_min(cells, ln) AS header, max(len(cells))::INTEGER AS cols, count(*)::INTEGER AS n FROM r GROUP BY doc_id, tab),
    sh AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tab)::INTEGER AS nth, header, cols, n FROM g)"""


def oracles(nodes: str) -> dict[str, str]:
    """SQL of the queries; nodes are the common table expressions of a.nodes()."""
    return {
        "file_names": r"""WITH p AS (SELECT page_id, url, string_split(url, '/')[-1] AS e FROM pages) SELECT page_id, substring(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g'), '\s+', '_', 'g'), 1, 40) AS name,
            CASE WHEN contains(e, '.') THEN lower(string_split(e, '.')[-1]) ELSE '' END AS ext, CASE page_id % 3 WHEN 0 THEN 'a/' || CASE WHEN e = '' THEN '' ELSE e || '/' END || 'x' WHEN 1 THEN e || '/x' ELSE CASE WHEN e = '' THEN '../t' ELSE 'a/b/t' END END AS path FROM p""",
        "line_cells": rf"""WITH {_DOC_LINES}, c AS (SELECT *, regexp_replace(translate(regexp_replace('a |' || chr(9) || line, '{_S}+', ' ', 'g'), '|', '∣'), '^ +| +$', '', 'g') AS cell, CASE WHEN ln % 2 = 0 THEN line ELSE regexp_replace(regexp_replace(line, '(?i)^```[a-z]*\n?', ''), '```{_S}*$', '') END AS bare,
              [substring(line, 1, 9), '', substring(line, 10, 9)] AS h, '⧠❑■▢－–—∙•･‧◦〇◯□○-·※A'[ln % 20 + 1] AS sign FROM l),
            m AS (SELECT *, CASE WHEN contains('⧠❑■▢', sign) THEN '□' WHEN contains('－–—', sign) THEN '-' WHEN contains('∙•･‧', sign) THEN '·' WHEN contains('◦〇◯', sign) THEN '○' WHEN sign = 'A' THEN '' ELSE sign END AS marker, list_transform(h, lambda x: regexp_replace(regexp_replace(x, '{_S}+', ' ', 'g'), '^ | $', '', 'g')) AS flat FROM c)
            SELECT doc_id, ln, CASE WHEN cell = '' THEN ' ' ELSE cell END AS cell, regexp_replace(bare, '^{_S}+|{_S}+$', '', 'g') AS bare, CASE WHEN list_has_any(list_transform(flat, lambda x: x <> ''), [true]) THEN array_to_string(flat, ' | ') END AS header, marker FROM m""",
        "line_counts": r"""WITH p AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') AS a FROM documents) SELECT doc_id, (len(a) - CASE WHEN a[-1] = '' THEN 1 ELSE 0 END)::INTEGER AS n FROM p""",
        "particles": "SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 AND p_partkey % 11172 % 28 > 0 THEN '은' ELSE '는' END AS particle FROM part",
        "sheet_columns": "SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 26 + 1) * 26 + p_partkey // 26 % 26 ELSE -1 END::INTEGER AS at FROM part",
        "limit_sentences": """SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN p_brand ELSE '항목' END || ': ' || CASE WHEN p_size % 11 > 0 THEN p_size::VARCHAR ELSE '몇' END || CASE WHEN p_size % 3 > 0 THEN '건' ELSE '개' END || CASE WHEN p_size % 2 = 0 THEN ' 이상 쓴다' ELSE ' 이내로 쓴다' END
            || CASE WHEN p_size % 5 > 0 THEN '. 안내서 원문 — “' || p_name || '”' ELSE '' END AS said FROM part""",
        "text_widths": f"""WITH n AS (SELECT p_partkey, p_name || ' 표–i' AS t FROM part), w AS (SELECT *, {_WIDTH.format("t")} AS width FROM n),
            f AS (SELECT p_partkey, max(k) AS k FROM (SELECT p_partkey, t, unnest(range(1, length(t) + 1)) AS k FROM n) WHERE {_WIDTH.format("t[1:k] || '…'")} <= 75 GROUP BY p_partkey)
            SELECT p_partkey, round(width, 4) AS width, CASE WHEN width <= 75 THEN t ELSE t[1:coalesce(k, 1)] || '…' END AS shown FROM w LEFT JOIN f USING (p_partkey)""",
        "inline_styles": """SELECT p_partkey, p_name AS text, CASE WHEN p_size % 2 = 0 THEN upper('#dd' || repeat(lpad(p_size::VARCHAR, 2, '0')[1], 2) || repeat(lpad(p_size::VARCHAR, 2, '0')[2], 2)) END AS fill,
            CASE p_size % 3 WHEN 0 THEN 'DASH' WHEN 1 THEN 'LONG_DASH' END AS line, 'a b' AS note FROM part""",
        "basis_labels": "SELECT c_custkey, {labels}[c_custkey % {n} + 1] AS label, c_nationkey::VARCHAR AS chapter FROM customer".format(labels="[" + ", ".join(f"'{indicators.LABELS.get(b, b)}'" for b in (*indicators.BASES, "planet")) + "]", n=len(indicators.BASES) + 1),
        "message_faults": r"""WITH m AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'API key not valid' WHEN 1 THEN user_id || ' credits are depleted' WHEN 2 THEN 'Quota: requests_per_day, Limit: ' || user_id WHEN 3 THEN 'This model is no longer available. Use models/x-' || user_id || '-flash'
              WHEN 4 THEN 'use models/y-preview or models/z' WHEN 5 THEN 'slow down ' || event_type WHEN 6 THEN 'PERMISSION per  day limit:' || user_id ELSE '' END AS m FROM events)
            SELECT event_id, CASE WHEN regexp_matches(m, '(?i)api key|permission|expired') THEN 'key' WHEN regexp_matches(m, '(?i)prepay|credits?\s+(are|is)\s+depleted|out of credits') THEN 'billing' WHEN regexp_matches(m, '(?i)per\s*day|PerDay|requests_per_day|free_tier_requests') THEN 'daily'
              WHEN regexp_matches(m, '(?i)no longer available|not available to new users|deprecated|discontinued') THEN 'retired' ELSE 'other' END AS fault, coalesce(try_cast(regexp_extract(m, '(?i)limit:\s*(\d+)', 1) AS BIGINT), 0) AS "limit",
              CASE WHEN regexp_matches(m, '(?i)use\s+models/') AND NOT contains(m, 'preview') THEN regexp_extract(m, '(?i)use\s+models/([A-Za-z0-9._-]+)', 1) ELSE '' END AS instead FROM m""",
        "headings": rf"""WITH {_DOC_LINES}, p AS (SELECT doc_id, ln, line, ((doc_id + ln) % 3 + 1)::INTEGER AS depth, CASE ln % 6 WHEN 0 THEN '가. ' WHEN 1 THEN ' [첨부 ' || ln || '] ' WHEN 2 THEN ln || ') ' WHEN 3 THEN '  (' || ln || ')' WHEN 4 THEN '' ELSE '나.' END || line AS t FROM l),
            k AS (SELECT *, CASE depth WHEN 1 THEN CASE WHEN regexp_matches(t, '^\s*[가-힣]\.\s*\S') THEN [regexp_extract(t, '^\s*([가-힣])\.', 1), regexp_extract(t, '^\s*[가-힣]\.\s*(\S.*)$', 1)]
                   WHEN regexp_matches(t, '^\s*\[(첨부|별첨)\s*\d+\]\s*\S') THEN [regexp_extract(t, '\[(첨부|별첨)', 1) || regexp_extract(t, '\[(첨부|별첨)\s*(\d+)', 2), regexp_extract(t, '\]\s*(\S.*)$', 1)] END
                 WHEN 2 THEN CASE WHEN regexp_matches(t, '^\s*\d+\)\s*\S') THEN [regexp_extract(t, '^\s*(\d+)\)', 1), regexp_extract(t, '^\s*\d+\)\s*(\S.*)$', 1)] END
                 ELSE CASE WHEN regexp_matches(t, '^\s*\(\d+\)\s*\S') THEN [regexp_extract(t, '^\s*(\(\d+\))', 1), regexp_extract(t, '^\s*\(\d+\)\s*(\S.*)$', 1)] END END AS h FROM p)
            SELECT doc_id, ln, depth, h[1] AS no, regexp_replace(h[2], '{_S}+$', '') AS title FROM k""",
        "contents": rf"""WITH {_DOC_LINES}, p AS (SELECT doc_id, ln, regexp_replace(CASE WHEN ln % 5 < 4 THEN lpad((ln % 90)::VARCHAR, 2, '0') ELSE '' END || substring(line, 1, 12) || '  _ ' || length(line), '^{_S}+|{_S}+$', '', 'g') AS t FROM l),
            k AS (SELECT *, regexp_matches(t, '^\d{{2}}\S.*?\s*_\s*\d+$') AS ok FROM p)
            SELECT doc_id, ln, CASE WHEN ok THEN left(t, 2)::INTEGER END AS chapter, CASE WHEN ok THEN regexp_extract(t, '_\s*(\d+)$', 1)::INTEGER END AS page FROM k""",
        "axis_ticks": """WITH p AS (SELECT p_brand, p_size, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part GROUP BY p_brand, p_size), r AS (SELECT *, (high - low) / 5 AS raw, pow(10.0, floor(log10(CASE WHEN high > low THEN (high - low) / 5 ELSE 1 END))) AS size FROM p),
            s AS (SELECT *, CASE WHEN size >= raw THEN size WHEN size * 2 >= raw THEN size * 2 WHEN size * 2.5 >= raw THEN size * 2.5 WHEN size * 5 >= raw THEN size * 5 ELSE size * 10 END AS step FROM r),
            k AS (SELECT *, ceil(low / step)::BIGINT AS first, floor((high + step * 1e-9) / step)::BIGINT AS last FROM s), t AS (SELECT *, CASE WHEN NOT high > low THEN [low] WHEN last >= first THEN list_transform(range(first, last + 1), lambda i: round(i * step, 10)) ELSE [low, high] END AS ts FROM k)
            SELECT p_brand, p_size, unnest(range(len(ts)))::INTEGER AS nth, unnest(ts) AS tick FROM t""",
        "section_mirrors": rf"""WITH RECURSIVE {nodes}, {_SECTIONS}, k AS (SELECT *, trim(regexp_extract(title, '^\[([^\]]*?전략)\s*(\d+)[_\s]', 1)) AS kind, regexp_extract(title, '^\[([^\]]*?전략)\s*(\d+)[_\s]', 2) AS n FROM sec WHERE regexp_matches(title, '^\[([^\]]*?전략)\s*(\d+)[_\s]')),
            f AS (SELECT *, first(id) OVER (PARTITION BY parent, kind ORDER BY ord) AS one FROM k)
            SELECT sec.id, f.one AS mirrors FROM sec LEFT JOIN f ON f.id = sec.id AND f.one <> f.id AND n <> '1' AND f.children = 0 AND f.forms = 0""",
        "section_instructions": f"""WITH RECURSIVE {nodes}, {_SECTIONS}, o AS (SELECT id, root, path, depth, row_number() OVER (ORDER BY path) AS pos FROM t), s AS (SELECT o.*, sec.has, sec.parent FROM o JOIN sec USING (id)),
            up AS (SELECT id, parent AS over, 1 AS far FROM s WHERE parent IN (SELECT id FROM s) UNION ALL SELECT up.id, s.parent, far + 1 FROM up JOIN s ON s.id = up.over WHERE s.parent IN (SELECT id FROM s)),
            above AS (SELECT up.id, arg_min(up.over, far) AS ref FROM up JOIN s ON s.id = up.over WHERE s.has GROUP BY up.id),
            below AS (SELECT up.over AS id, arg_min(up.id, s.pos) AS ref FROM up JOIN s ON s.id = up.id WHERE s.has GROUP BY up.over),
            -- nearest of the chapter: the last before and the first after
            g AS (SELECT *, last_value(CASE WHEN has THEN pos END IGNORE NULLS) OVER (PARTITION BY root ORDER BY pos) AS b, first_value(CASE WHEN has THEN pos END IGNORE NULLS) OVER (PARTITION BY root ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM s),
            near AS (SELECT g.id, x.id AS ref FROM g JOIN s x ON x.pos = CASE WHEN b IS NULL OR f - g.pos < g.pos - b THEN f ELSE b END)
            SELECT s.id, CASE WHEN NOT s.has THEN coalesce(above.ref, below.ref, near.ref) END AS ref FROM s LEFT JOIN above ON above.id = s.id LEFT JOIN below ON below.id = s.id LEFT JOIN near ON near.id = s.id""",
        "section_stats": f"WITH RECURSIVE {nodes}, {_SECTIONS} SELECT count(*) FILTER (parent IS NULL) AS chapters, count(*) AS nodes, sum(forms)::BIGINT AS forms, count(*) FILTER (has) AS howtos FROM sec",
        "section_problems": f"""WITH RECURSIVE {nodes}, x AS (SELECT id, ord, CASE WHEN starts_with(id, 'p') AND (ord - 101) % 80 = 0 THEN 'p' || (ord - 61) ELSE parent END AS parent FROM nodes),
            ok AS (SELECT id FROM x WHERE parent IS NULL OR parent NOT IN (SELECT id FROM x) UNION SELECT x.id FROM x JOIN ok ON x.parent = ok.id)
            SELECT id, 'repeated id' AS problem FROM x WHERE ord % 50 = 0 UNION ALL SELECT id, 'unknown parent' FROM (SELECT * FROM x UNION ALL SELECT * FROM x WHERE ord % 50 = 0) WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM x)
            UNION ALL SELECT id, 'cycle' FROM x WHERE id NOT IN (SELECT id FROM ok)""",
        "blank_forms": "SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY i) - 1)::INTEGER AS nth, i AS idx FROM (SELECT l_orderkey, CASE WHEN l_partkey % 7 > 0 THEN l_linenumber ELSE 0 END AS i FROM lineitem WHERE l_returnflag <> 'R')",
        "diagram_relations": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS place FROM supplier), l AS (SELECT s_nationkey, s_name, place, unnest([1, -1, 2, 80]) AS step FROM t)
            SELECT l.s_nationkey, l.s_name AS a, coalesce(o.s_name, 'none ' || (l.place + step)) AS b, CASE WHEN o.s_name IS NULL THEN 'unknown' WHEN step = 1 THEN 'right' WHEN step = -1 THEN 'left' ELSE 'apart' END AS state
            FROM l LEFT JOIN t o ON o.s_nationkey = l.s_nationkey AND o.place = l.place + step""",
        "package_entries": """WITH RECURSIVE p AS (SELECT p_partkey, string_split(p_name, ' ') AS h0, string_split(lower(p_type || ' ' || string_split(p_name, ' ')[1]), ' ') AS b0 FROM part),
            d AS (SELECT p_partkey, list_filter(h0, lambda x, i: list_position(h0, x) = i) AS h, list_filter(b0, lambda x, i: list_position(b0, x) = i) AS b FROM p)
            SELECT p_partkey, array_to_string(list_filter(['part', 'red', 'blue'], lambda x: NOT list_contains(h, x)), ',') AS missing, array_to_string(list_filter(h, lambda x: list_contains(b, x)), ',') AS placed,
                   array_to_string(list_filter(h, lambda x: NOT list_contains(b, x)) || list_filter(b, lambda x: NOT list_contains(h, x)), ',') AS lost FROM d""",
        "indent_tree": rf"""WITH RECURSIVE {_DOC_LINES}, c AS (SELECT doc_id, ln, length(line) % 4 * 2 + length(line) - length(ltrim(line, ' ')) * 1 AS i0, line, regexp_replace(regexp_replace(CASE WHEN ln % 3 = 0 THEN '- ' ELSE '' END || line, '^{_S}+|{_S}+$', '', 'g'), '^[-*•]\s+', '') AS t, ln % 3 = 0 AS dash FROM l),
            e AS (SELECT doc_id, ln, length(line) % 4 * 2 + CASE WHEN dash THEN 0 ELSE length(line) - length(ltrim(line, ' ')) END AS ind, regexp_replace(t, '\s*\{{[^{{}}]*\}}\s*$', '') AS t FROM c), k AS (SELECT * FROM e WHERE regexp_replace(t, '^{_S}+|{_S}+$', '', 'g') NOT IN ('', '-')),
            u AS (SELECT *, (SELECT max(y.ln) FROM k y WHERE y.doc_id = k.doc_id AND y.ln < k.ln AND y.ind < k.ind) AS parent FROM k),
            w AS (SELECT doc_id, ln, 0 AS depth FROM u WHERE parent IS NULL UNION ALL SELECT u.doc_id, u.ln, depth + 1 FROM u JOIN w ON w.doc_id = u.doc_id AND w.ln = u.parent)
            SELECT u.doc_id, u.ln, parent, depth, sha256(regexp_replace(t, '^{_S}+|{_S}+$', '', 'g')) AS text FROM u JOIN w USING (doc_id, ln)""",
        "bar_tables": f"""WITH {_BARS}, f AS (SELECT * FROM r WHERE len(list_filter(cells, lambda c: c <> '')) > 0), v AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id, tab) AS wide FROM f)
            SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY tab)::INTEGER AS tab, ln, array_to_string(cells || list_transform(range(wide - len(cells)), lambda x: ''), '|') AS cells FROM v""",
        "table_shapes": f"WITH {_SHAPES} SELECT doc_id, nth, array_to_string(header, '|') AS header, cols, n FROM sh",
        "form_issues": f"""WITH {_SHAPES}, q AS (SELECT doc_id + 1 AS doc_id, nth, header AS want, cols AS wc FROM sh WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), j AS (SELECT q.*, sh.header AS have, sh.cols AS hc FROM q LEFT JOIN sh USING (doc_id, nth)),
            m AS (SELECT *, list_filter(list_filter(list_transform(want, lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: x <> ''), lambda x: len(list_filter(have, lambda y: contains(regexp_replace(y, '\\s+', '', 'g'), x) OR contains(x, regexp_replace(y, '\\s+', '', 'g')))) = 0) AS gone FROM j WHERE hc IS NOT NULL)
            SELECT doc_id, 0 AS nth, 'err' AS level, count(hc) || ' of ' || count(*) || ' tables' AS issue FROM j GROUP BY doc_id HAVING count(hc) < count(*) UNION ALL SELECT doc_id, nth, 'err', hc || ' columns instead of ' || wc FROM j WHERE hc <> wc
            UNION ALL SELECT doc_id, nth, 'warn', 'missing: ' || array_to_string(gone, ', ') FROM m WHERE len(gone) > 0""",
        "sections_found": f"""WITH RECURSIVE {nodes}, w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'c' ELSE 'x' END || o_custkey AS wanted FROM orders)
            SELECT o_orderkey, parent, title FROM w LEFT JOIN nodes ON id = wanted""",
        # what each mixture of layers leaves
        "merged_profiles": """WITH p AS (SELECT *, p_size % 4 AS u, p_size % 3 AS l FROM part), scalar AS (SELECT *, u = 2 AS five, u = 1 AS two FROM p)
            SELECT p_partkey, 'a.b' AS path, CASE WHEN u = 1 THEN '"' || p_name || '"' ELSE p_size::VARCHAR END AS value FROM scalar WHERE NOT five UNION ALL SELECT p_partkey, 'a.c', '"' || p_type || '"' FROM scalar WHERE NOT five
            UNION ALL SELECT p_partkey, 'a', '5' FROM scalar WHERE five AND l <> 0 UNION ALL SELECT p_partkey, 'a.q', 'true' FROM p WHERE l = 0 UNION ALL SELECT p_partkey, 'd', CASE WHEN u = 3 THEN 'null' ELSE '"' || p_brand || '"' END FROM p
            UNION ALL SELECT p_partkey, 'z', p_size::VARCHAR FROM p WHERE u = 2 UNION ALL SELECT p_partkey, 'y', '{}' FROM p WHERE u = 3 AND l <> 1 UNION ALL SELECT p_partkey, 'y.x', '"{}"' FROM p WHERE l = 1
            UNION ALL SELECT p_partkey, 'e.f', '2' FROM scalar WHERE two AND l <> 0 UNION ALL SELECT p_partkey, 'e.f.h', p_size::VARCHAR FROM p WHERE l = 0
            UNION ALL SELECT p_partkey, 'e.f.g', '1' FROM scalar WHERE NOT two UNION ALL SELECT p_partkey, 'e.f.l', '[' || p_size || ',' || p_partkey || ']' FROM scalar WHERE NOT two""",
        "table_kinds": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS seq, l_quantity::INTEGER AS n FROM lineitem),
            g AS (SELECT l_partkey, seq, n, l_orderkey AS k, l_returnflag AS rf, l_linestatus AS ls, l_linenumber = 2 AS opened, CASE WHEN n % 9 = 0 THEN 'howto' WHEN n % 9 = 1 THEN 'note' END AS base, CASE WHEN n % 9 > 1 THEN 2 + n % 2 END AS rows, CASE WHEN n % 9 > 1 THEN 1 + n % 3 END AS cols FROM t),
            c AS (SELECT *, list_transform(range(rows * cols), lambda x: ((n * (x // cols + 1) + x % cols * 3 + k) % 5 >= 2)::INTEGER) AS said FROM g),
            f AS (SELECT *, list_sum(said) / (rows * cols)::DOUBLE AS fill, coalesce(list_sum(said[1:cols]), 0) = 0 AS bare, list_sum(said[cols + 1:]) / ((rows - 1) * cols)::DOUBLE AS data,
                         last_value(CASE WHEN base = 'howto' THEN 0 WHEN opened THEN 1 END IGNORE NULLS) OVER (PARTITION BY l_partkey ORDER BY seq) AS open,
                         last_value(CASE WHEN base IS NULL THEN rows * 10 + cols END IGNORE NULLS) OVER (PARTITION BY l_partkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shape FROM c)
            SELECT l_partkey, seq::INTEGER AS seq, CASE WHEN base IS NOT NULL THEN base WHEN open = 1 OR fill >= 0.6 AND shape = rows * 10 + cols THEN 'example' WHEN bare THEN 'layout' WHEN data >= 0.55 THEN 'example' ELSE 'blank' END AS kind,
                   round(CASE base WHEN 'howto' THEN 0.5 WHEN 'note' THEN 1.0 ELSE fill END, 4) AS filled,
                   CASE WHEN base = 'howto' THEN CASE WHEN k % 3 > 0 THEN ': ' || rf ELSE ls END END AS purpose, CASE WHEN base = 'howto' THEN CASE WHEN k % 3 = 0 THEN '먼저' WHEN n % 2 = 0 THEN ': ' || ls END END AS method FROM f""",
    }
