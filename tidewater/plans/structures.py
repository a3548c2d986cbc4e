"""Queries over the structure of given texts: tags of pages, levels and depths of documents' lines; with the SQL that restates their rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions import numbers, text
from tidewater.operators import cards, diagrams, levels, outline, readback, tables, tags
from tidewater.session import shared_dir
from tidewater.streaming import cards as card_stream
from tidewater.streaming import ledger
from tidewater.streaming.usage import usage_stream

from . import adapters as a

VOID = ("br", "meta")
MARKERS = ["#", "##", "○", "-"]


#: Bytes of html of the pages of a task: what is sorted of them is held in its memory, so tasks grow in number and not in size.
HTML = 16 << 20


def _html_size(pages: DataFrame) -> int:
    return pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0


def page_spans(s: SparkSession, d: str) -> DataFrame:
    """The outermost spans of every tag of every page."""
    p = a.table(s, d, "pages")
    p = a.dealt(p, "page_id", _html_size(p), HTML)
    found = tags.inner(tags.spans(tags.tokens(p, "page_id", "html", VOID), "page_id"), p, "page_id", "html")
    return found.select("page_id", "raw", "span", "attrs", "start", "inner_start", "inner_end", "end", F.sha2("inner", 256).alias("inside"))


def page_verdicts(s: SparkSession, d: str) -> DataFrame:
    """What is wrong with the tags of every page and of the inside of each of its outermost spans."""
    p = a.table(s, d, "pages")
    edges = a.dealt(tags.edged(tags.tokens(p, "page_id", "html", VOID), p, "page_id"), "page_id", _html_size(p), HTML)
    part = F.when(F.col("raw") == "", F.col("page_id").cast("string")).otherwise(F.concat_ws("/", F.col("page_id").cast("string"), "raw", F.col("span").cast("string")))
    return tags.part_verdicts(edges, "page_id").select(part.alias("part"), "problem", "tag", "opened", "roots")


def page_links(s: SparkSession, d: str) -> DataFrame:
    """The links of every page: their address and class."""
    t = tags.tokens(a.table(s, d, "pages"), "page_id", "html", VOID).filter("kind = 'open' and name = 'a'")
    return t.select("page_id", "nth", tags.unescape(tags.attr(F.col("attrs"), "href")).alias("href"), tags.attr(F.col("attrs"), "class").alias("class"))


def _levels(s: SparkSession, d: str) -> DataFrame:
    p = a.paragraphs(s, d)
    return levels.assigned(levels.groups(p, a.shapes(p), "doc_id"), "doc_id")


def form_levels(s: SparkSession, d: str) -> DataFrame:
    """Levels of each document's lines by their shape."""
    x = _levels(s, d)
    return x.select("doc_id", "place", "style", "char", "seen", "prefix", "symbol", "marker", "clash", "invented", "level", F.sha2(F.array_join("samples", "/"), 256).alias("samples"))


def form_table_note(s: SparkSession, d: str) -> DataFrame:
    """The level of each document that writes below tables."""
    return levels.table_note(_levels(s, d), "doc_id")


def _depths(s: SparkSession, d: str) -> DataFrame:
    return readback.depths(readback.cut(a.read_blocks(s, d)), "doc_id")


def guessed_depths(s: SparkSession, d: str) -> DataFrame:
    """Depth of every line of a document whose form isn't known, what it began with, and where its notes are."""
    return _depths(s, d).filter("kind = 'para'").select("doc_id", "ln", "number", "symbol", "depth", "text", F.array_join(F.transform("notes", lambda n: n["at"].cast("string")), ",").alias("at"))


def guessed_text(s: SparkSession, d: str) -> DataFrame:
    """Every document read back as marked text."""
    return readback.marked(_depths(s, d), "doc_id", MARKERS)


def guessed_evidence(s: SparkSession, d: str) -> DataFrame:
    """Why each depth of a document is one."""
    return readback.evidence(_depths(s, d), "doc_id", MARKERS)


def _saved(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as saved cards of sections (conversation and role), in three rounds of saving by turn."""
    c = a.table(s, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "role").alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", (F.col("turn") % 3).cast("int").alias("round"))


def merge_cards(s: SparkSession, d: str) -> DataFrame:
    """The cards of the first round of saving with those of the others in their place or behind."""
    saved = _saved(s, d)
    old = saved.filter("round = 0").groupBy("id").agg(F.min("ord").alias("ord"), F.max_by("text", "ord").alias("text"))
    return cards.merged(old, saved.filter("round > 0").drop("round")).select("id", "ord", F.sha2("text", 256).alias("card"))


def stream_cards(s: SparkSession, d: str) -> DataFrame:
    """The latest card of each section after three rounds of saving, a batch each."""
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    saved = _saved(s, d)
    for i in range(3):
        saved.filter(F.col("round") == i).drop("round").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = s.readStream.schema(saved.drop("round").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    card_stream.keep_latest(stream, folder, buckets=8).awaitTermination()
    return card_stream.read(s, folder).select("id", "ord", F.sha2("text", 256).alias("card"))


def _documents_of_cards(s: SparkSession, d: str) -> DataFrame:
    """The lines with a part as the cards of a document, chapters in turn."""
    w = W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    n = a.table(s, d, "lineitem").withColumn("ord", F.row_number().over(w))
    return n.select(F.col("l_partkey").alias("doc"), F.col("ord").alias("id"), "ord", F.format_string("%02d", (F.col("l_linenumber") % 3 + 1).cast("int")).alias("chapter"), F.when(F.col("ord") % 4 == 1, F.col("ord") - 25).alias("mirrors"), F.col("l_quantity").cast("int").alias("size"))


def card_window(s: SparkSession, d: str) -> DataFrame:
    """The cards that each line's card takes of its document, of the few that it may reach."""
    n = _documents_of_cards(s, d)
    return cards.chosen(n, 150, 5).select(F.concat_ws("-", "doc", "target").alias("key"), "ord", "id")


def card_of_documents(s: SparkSession, d: str) -> DataFrame:
    """Cards of all documents: their sizes stay within the bound but for one very wide table."""
    docs = a.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("no"), "source", "text")
    c = cards.cards(docs, "id", "no", "source", "text")
    card = cards.card_text(*[F.col(n) for n in ("id", "no", "source", "names", "points", "tables", "numbers")])
    return c.select("id", F.size("numbers").alias("numbers"), F.size("tables").alias("tables"), (text.units16(card) <= cards.MOST).alias("fits"))


def stream_usage(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream, in one run to its end: uses of a day by model, from the last state of each hour."""
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    schema = a.table(s, d, "events").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")

    q = usage_stream(events, "user_id", "ts", late="400 days").writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    last = s.read.parquet(f"{folder}/rows").groupBy("day", "hour", "model").agg(F.max_by("n", "batch").alias("n"))
    return last.groupBy("day", "model").agg(F.sum("n").alias("n"))


def stream_ledger(s: SparkSession, d: str) -> DataFrame:
    """The ledger of all events, moved to the days around a change of the zone's clocks, as keyed state over a stream of four
    files in order of time; each page as it was told last."""
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    events = a.moved_events(s, d)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    for i in range(4 if first else 0):
        low, high = first + (last - first) * i / 4, first + (last - first) * (i + 1) / 4
        part = events.filter((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) if i < 3 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    error = F.col("event_type") == "error"
    told = ledger.ledger_stream(stream, "user_id", "ts", error, F.when(error, F.floor("value")))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")

    writer = told.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep)
    ledger.start_with_rocks(writer, s).awaitTermination()
    page = F.max_by(F.struct("n", "exhausted", "limit", "final"), F.struct("batch", "n", F.col("final").cast("int"))).alias("p")
    return s.read.parquet(f"{folder}/rows").groupBy("model", "day").agg(page).select("model", F.to_date("day").cast("string").alias("day"), "p.n", "p.exhausted", F.col("p.limit").alias("limit"))


def diagram_blocks(s: SparkSession, d: str) -> DataFrame:
    """The fenced blocks of documents with their heads."""
    x = diagrams.blocks(a.diagram_texts(s, d), "doc_id", "text")
    return x.select("doc_id", "block", "line", "type", "title", F.element_at("options", "layout").alias("layout"), F.sha2(F.array_join("body", "/"), 256).alias("body"))


def diagram_trees(s: SparkSession, d: str) -> DataFrame:
    """The nodes of trees in blocks, with the leaves that each spans."""
    x = diagrams.blocks(a.diagram_texts(s, d), "doc_id", "text").filter("type = 'org'")
    return diagrams.trees(x, "doc_id").select("doc_id", "block", "ln", "parent", "depth", F.sha2("text", 256).alias("text"), "first", "last")


def diagram_bands(s: SparkSession, d: str) -> DataFrame:
    """The cells of bands in blocks."""
    x = diagrams.blocks(a.diagram_texts(s, d), "doc_id", "text").filter("type <> 'org'")
    return diagrams.bands(x, "doc_id").select("doc_id", "block", "band", "label", "row", "cell", F.sha2("text", 256).alias("text"))


KINDS = (("AUTO_ROMAN", "AUTO_NUM", "AUTO_PAREN", "AUTO_CIRCLED"), ("AUTO_HANGUL", "AUTO_ALPHA", "", "AUTO_NUM"))


def numbered_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of conversations with their number as it is written, and the counters of all levels above."""
    x = outline.numbered(a.manuscripts(s, d), "conv_id", "ln")
    kind = F.element_at(F.when(F.col("conv_id") % 2 == 0, F.lit(list(KINDS[0]))).otherwise(F.lit(list(KINDS[1]))), F.col("level"))
    x = outline.counters(x, "conv_id", "ln", 4)
    return x.select("conv_id", "ln", numbers.counter(F.col("no"), kind).alias("number"), F.array_join(F.transform("path", lambda v: v.cast("string")), ".").alias("path"))


def fitted_turns(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations joined up to 1500 characters."""
    x = outline.fitted(a.table(s, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 1500)
    return x.select("conv_id", "turn", "start", F.length("shown").alias("n"), "state", F.sha2("shown", 256).alias("shown"))


def csv_fields(s: SparkSession, d: str) -> DataFrame:
    """Documents as tables of comma-separated fields, with a quote wherever a text has `re`."""
    x = a.table(s, d, "documents").select("doc_id", tables.csv_rows(F.replace("text", F.lit("re"), F.lit('"')), F.lit(",")).alias("rows"))
    x = x.select("doc_id", F.posexplode("rows").alias("row", "fields"))
    return x.select("doc_id", "row", F.posexplode("fields").alias("field", "v")).select("doc_id", "row", "field", F.sha2("v", 256).alias("value"))


QUERIES = {f.__name__: f for f in (
    page_spans, page_verdicts, page_links, form_levels, form_table_note, guessed_depths, guessed_text, guessed_evidence, merge_cards, stream_cards, card_window, stream_ledger, card_of_documents,
    stream_usage, diagram_blocks, diagram_trees, diagram_bands, numbered_lines, fitted_turns, csv_fields,
)}

_TAG = r"""'<(/?)([\w:]+)((?:[^>"'']+|"[^"]*"|''[^'']*'')*)>'"""
_EMPTY = "tag LIKE '%/>' OR raw IN ('br', 'meta')"
# one step a tag: the depth, the number of spans begun, and where the open one began
_SPANS = rf"""
    p AS (SELECT page_id, regexp_extract_all(html, {_TAG}) AS tags, string_split_regex(html, {_TAG}) AS gaps FROM pages WHERE html IS NOT NULL),
    x AS (SELECT page_id, unnest(tags) AS tag, unnest(gaps[1:len(tags)]) AS gap, unnest(range(len(tags))) AS nth FROM p),
    t AS (SELECT page_id, nth, tag, regexp_extract(tag, '^</?([\w:]+)', 1) AS raw, sum(length(gap) + length(tag)) OVER (PARTITION BY page_id ORDER BY nth) AS e FROM x),
    k AS (SELECT *, e - length(tag) AS s, CASE WHEN {_EMPTY} THEN 0 WHEN tag LIKE '</%' THEN -1 ELSE 1 END AS step, row_number() OVER (PARTITION BY page_id, raw ORDER BY nth) AS i FROM t),
    r AS (SELECT page_id, raw, 0::BIGINT AS i, 0 AS depth, 0 AS span, NULL::HUGEINT AS s, NULL::HUGEINT AS a, '' AS tag, NULL::HUGEINT AS b, NULL::HUGEINT AS e FROM (SELECT DISTINCT page_id, raw FROM k)
      UNION ALL
      SELECT r.page_id, r.raw, k.i, greatest(0, depth + step), span + CASE WHEN depth = 0 AND step >= 0 THEN 1 ELSE 0 END,
             CASE WHEN depth = 0 AND step >= 0 THEN k.s ELSE r.s END, CASE WHEN depth = 0 AND step >= 0 THEN k.e ELSE r.a END, CASE WHEN depth = 0 AND step >= 0 THEN k.tag ELSE r.tag END,
             CASE WHEN depth = 0 AND step = 0 THEN k.e WHEN depth = 1 AND step = -1 THEN k.s END, CASE WHEN depth = 0 AND step = 0 OR depth = 1 AND step = -1 THEN k.e END
      FROM r JOIN k ON k.page_id = r.page_id AND k.raw = r.raw AND k.i = r.i + 1)"""

_BLANKS = levels.BLANKS
_PARAS = r"""
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, ln, (length(line) % 5)::INTEGER AS style, (ln % 2)::INTEGER AS char, ln % 13 = 12 AS in_table, (length(line) % 5 = 4 AND ln % 2 = 0) OR ln % 7 = 1 AS after_table,
                 CASE WHEN ln % 5 = 4 THEN '' ELSE CASE length(line) % 5 WHEN 0 THEN '□ ' WHEN 1 THEN '- ' WHEN 2 THEN (ln % 20 + 1) || '. ' WHEN 3 THEN '가) ' ELSE '' END END || trim(line) AS text FROM l)"""
_PREFIX = "CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in levels.PREFIXES) + f" WHEN regexp_matches(text, '{levels.SIGN}') THEN regexp_extract(text, '{levels.SIGN}', 1) END"
_GROUPS = rf"""{_PARAS},
    f AS (SELECT *, {_PREFIX} AS prefix, CASE WHEN contains('{levels.MARKERS}', text[1]) AND text[2] IN (' ', '　') THEN text[1] END AS lead FROM p WHERE NOT in_table AND text <> ''),
    g AS (SELECT doc_id, style, char, count(*) AS seen, min(ln) AS first, count(*) FILTER (after_table) AS after, count(prefix) AS np, count(lead) AS nl, string_agg(text, '/' ORDER BY ln) FILTER (nth <= 3) AS samples
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, style, char ORDER BY ln) AS nth FROM f) GROUP BY ALL),
    mp AS (SELECT doc_id, style, char, prefix FROM f WHERE prefix IS NOT NULL GROUP BY doc_id, style, char, prefix QUALIFY row_number() OVER (PARTITION BY doc_id, style, char ORDER BY count(*) DESC, min(ln)) = 1),
    ml AS (SELECT doc_id, style, char, lead FROM f WHERE lead IS NOT NULL GROUP BY doc_id, style, char, lead QUALIFY row_number() OVER (PARTITION BY doc_id, style, char ORDER BY count(*) DESC, min(ln)) = 1),
    h AS (SELECT g.*, CASE WHEN np >= greatest(1, seen // 2) THEN mp.prefix END AS prefix, CASE WHEN nl >= greatest(1, seen // 2) THEN ml.lead END AS symbol,
                 row_number() OVER (PARTITION BY doc_id ORDER BY (style // 2) * 5.0, 16 - 2 * (style % 3) + char DESC, first) - 1 AS place
          FROM g LEFT JOIN mp USING (doc_id, style, char) LEFT JOIN ml USING (doc_id, style, char)),
    w AS (SELECT *, CASE WHEN style = 1 AND char = 1 THEN '○' WHEN (style = 3 AND char = 1) OR coalesce(starts_with(prefix, 'AUTO_'), false) THEN '#' ELSE coalesce(symbol, '') END AS wish FROM h),
    -- group by group: headings so far, markers taken
    a AS (SELECT DISTINCT doc_id, -1::BIGINT AS place, 0 AS seq, []::VARCHAR[] AS used, '' AS got, false AS clash FROM w
      UNION ALL
      SELECT doc_id, place, seq, CASE WHEN m = '' OR list_contains(used, m) THEN used ELSE used || [m] END, CASE WHEN list_contains(used, m) THEN '' ELSE m END, m <> '' AND list_contains(used, m)
      FROM (SELECT w.doc_id, w.place, a.used, a.seq + (wish = '#')::INTEGER AS seq, CASE wish WHEN '#' THEN ['#', '##', '###', '####'][least(a.seq, 3) + 1] ELSE wish END AS m FROM a JOIN w ON w.doc_id = a.doc_id AND w.place = a.place + 1)),
    u AS (SELECT doc_id, last(used ORDER BY place) AS used FROM a GROUP BY doc_id),
    e AS (SELECT a.*, u.used AS every, sum((got = '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM a JOIN u USING (doc_id) WHERE place >= 0),
    m AS (SELECT doc_id, place, clash, CASE WHEN got <> '' THEN got ELSE coalesce(list_filter(string_split('{levels.FALLBACK}', ''), lambda c: NOT list_contains(every, c))[nth::INTEGER], '') END AS marker, got = '' AS none FROM e),
    b AS (SELECT m.*, CASE WHEN marker = '□' THEN 'box' WHEN marker = '○' THEN 'circle' WHEN marker = '-' THEN 'hyphen' WHEN marker IN ('·', '･', '•', '▪', '◦', '∙') THEN 'dot' WHEN marker = '※' THEN 'note'
                              WHEN marker IN ('◇', '◆') THEN 'diamond' WHEN marker = '▶' THEN 'arrow' WHEN marker LIKE '#%' THEN 'h' || length(marker) ELSE 'level' || place END AS base FROM m),
    v AS (SELECT b.*, base || CASE WHEN row_number() OVER (PARTITION BY doc_id, base ORDER BY place) > 1 THEN (row_number() OVER (PARTITION BY doc_id, base ORDER BY place))::VARCHAR ELSE '' END AS level FROM b)"""

_NUMBER = "CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in readback.NUMBERS) + " END"
_NUMBER_SIZE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN length(regexp_extract(text, '{pattern}'))" for _, pattern in readback.NUMBERS) + " END"
_DEPTHS = rf"""
    l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, ln, line, length(line) AS n, CASE WHEN ln % 9 = 5 THEN 'table' WHEN ln % 17 = 7 THEN 'picture' ELSE 'para' END AS kind,
                 CASE (length(line) + ln) % 8 WHEN 0 THEN 'Ⅱ. ' WHEN 1 THEN (ln % 30 + 1) || '.  ' WHEN 2 THEN '나. ' WHEN 3 THEN '③' WHEN 4 THEN '○ ' WHEN 5 THEN '-　' ELSE '' END || line AS text FROM l WHERE line <> ''),
    o AS (SELECT *, CASE WHEN kind = 'para' AND text[1] IN ('{"', '".join(readback.LADDER)}') AND text[2] IN (' ', '　') THEN text[1] END AS symbol,
                 CASE WHEN kind <> 'para' THEN []::BIGINT[] WHEN ln % 4 = 1 THEN [n // 3] WHEN ln % 6 = 2 THEN [n // 3, CASE WHEN n % 2 = 0 THEN n // 3 ELSE n + 9 END] ELSE []::BIGINT[] END AS at0 FROM b),
    q AS (SELECT *, CASE WHEN kind = 'para' AND symbol IS NULL THEN {_NUMBER} END AS number, CASE WHEN symbol IS NOT NULL THEN 2 WHEN kind = 'para' THEN {_NUMBER_SIZE} END AS size FROM o),
    c AS (SELECT doc_id, ln, line, n, kind, number, symbol, CASE WHEN kind = 'para' THEN 10 + n % 3 END AS pt,
                 CASE WHEN size IS NULL THEN text ELSE regexp_replace(substring(text, size + 1), '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g') END AS text,
                 CASE WHEN size IS NULL THEN at0 ELSE list_transform(at0, lambda x: greatest(0, x - (length(text) - length(regexp_replace(substring(text, size + 1), '^[{_BLANKS}]+', ''))))) END AS ats FROM q),
    s AS (SELECT doc_id, list_filter(['ROMAN', 'DIGIT_DOT', 'HANGUL', 'DIGIT_PAREN', 'CIRCLED'], lambda x: list_contains(list(number), x)) AS ns, list_filter(['{"', '".join(readback.LADDER)}'], lambda x: list_contains(list(symbol), x)) AS ss,
                 list_reverse_sort(list(DISTINCT pt)) AS zs FROM c WHERE kind = 'para' GROUP BY doc_id),
    d AS (SELECT c.*, CASE WHEN kind = 'para' THEN CASE WHEN number IS NOT NULL THEN list_position(ns, number) - 1 WHEN symbol IS NOT NULL THEN len(ns) + list_position(ss, symbol) - 1 ELSE len(ns) + len(ss) + list_position(zs, pt) - 1 END END::INTEGER AS depth
          FROM c LEFT JOIN s USING (doc_id))"""
_S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FENCED = """
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, ln, line, ln // 12 * 12 AS head, (ln // 12)::INTEGER AS block, (ln // 12 * 12 + 1)::INTEGER AS line_no, CASE ln // 12 % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'matrix' ELSE 'strategy' END AS type,
                 first(length(line) || ' x') OVER (PARTITION BY doc_id, ln // 12 ORDER BY ln) AS title,
                 CASE WHEN ln // 12 % 3 = 0 THEN repeat(' ', length(line) % 3 * 2) || '- ' || line WHEN ln % 4 = 0 THEN string_split(line, ' ')[1] || ' {fill=#abc} | ' || substring(line, 1, 10) || ' |  | ' || string_split(line, ' ')[1] || ' | |'
                      WHEN ln % 4 = 1 THEN ' | ' || line WHEN ln % 4 = 2 THEN '|---|:--|' ELSE line END AS t FROM l WHERE ln % 12 < 11)"""
_SAVED = "c AS (SELECT conv_id || '-' || role AS id, conv_id * 1000 + turn AS ord, text, turn % 3 AS round FROM conversations)"
_MARK = "['#', '##', '○', '-'][least(4, {})]"

ORACLES = {
    "page_spans": rf"""WITH RECURSIVE {_SPANS}
        SELECT r.page_id, raw, (span - 1)::INTEGER AS span, regexp_extract(tag, '(?s)^</?[\w:]+(.*?)/?>$', 1) AS attrs, s::BIGINT AS "start", a::BIGINT AS inner_start, b::BIGINT AS inner_end, e::BIGINT AS "end",
               sha256(substring(html, a::BIGINT + 1, (b - a)::BIGINT)) AS inside FROM r JOIN pages USING (page_id) WHERE e IS NOT NULL""",
    "page_verdicts": rf"""WITH RECURSIVE {_SPANS},
        f AS (SELECT page_id::VARCHAR AS part, html FROM pages UNION ALL SELECT r.page_id || '/' || raw || '/' || (span - 1), substring(html, a::BIGINT + 1, (b - a)::BIGINT) FROM r JOIN pages USING (page_id) WHERE e IS NOT NULL),
        fp AS (SELECT part, regexp_extract_all(html, {_TAG}) AS tags FROM f), fx AS (SELECT part, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM fp), ft AS (SELECT *, regexp_extract(tag, '^</?([\w:]+)', 1) AS raw FROM fx),
        -- a stack, tag by tag; it stops at the first fault
        s AS (SELECT part, 0 AS i, []::VARCHAR[] AS stack, 0 AS roots, NULL::VARCHAR AS problem, NULL::VARCHAR AS tag, NULL::VARCHAR AS opened FROM f
          UNION ALL
          SELECT s.part, s.i + 1, CASE WHEN {_EMPTY.replace("tag", "t.tag")} THEN stack WHEN t.tag LIKE '</%' THEN stack[:-2] ELSE stack || [raw] END,
                 roots + CASE WHEN {_EMPTY.replace("tag", "t.tag")} THEN (len(stack) = 0)::INTEGER WHEN t.tag LIKE '</%' THEN (len(stack) = 1)::INTEGER ELSE 0 END,
                 CASE WHEN {_EMPTY.replace("tag", "t.tag")} OR t.tag NOT LIKE '</%' THEN NULL WHEN len(stack) = 0 THEN 'left over' WHEN stack[-1] <> raw THEN 'crossed' END, raw, stack[-1]
          FROM s JOIN ft t ON t.part = s.part AND t.i = s.i WHERE problem IS NULL),
        z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY part ORDER BY i DESC) = 1)
        SELECT part, CASE WHEN problem IS NOT NULL THEN problem WHEN len(stack) > 0 THEN 'not closed' WHEN roots <> 1 THEN 'roots' END AS problem,
               CASE WHEN problem IS NOT NULL THEN tag WHEN len(stack) > 0 THEN stack[-1] END AS tag, CASE WHEN problem = 'crossed' THEN opened END AS opened,
               CASE WHEN problem IS NULL AND len(stack) = 0 AND roots <> 1 THEN roots END::BIGINT AS roots FROM z""",
    "page_links": rf"""WITH p AS (SELECT page_id, regexp_extract_all(html, {_TAG}) AS tags FROM pages), x AS (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags)))::INTEGER AS nth FROM p)
        SELECT page_id, nth, CASE WHEN contains(tag, 'href="') THEN replace(replace(replace(replace(replace(regexp_extract(tag, 'href="([^"]*)"', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') END AS href,
               CASE WHEN regexp_matches(tag, '\sclass="') THEN regexp_extract(tag, '\sclass="([^"]*)"', 1) END AS class FROM x WHERE regexp_matches(tag, '^<([\w]+:)?a[\s>]') AND tag NOT LIKE '%/>'""",
    "form_levels": rf"""WITH RECURSIVE {_GROUPS} SELECT doc_id, place::INTEGER AS place, style, char, seen, prefix, symbol, marker, clash, none AND marker <> '' AS invented, level, sha256(samples) AS samples FROM w JOIN v USING (doc_id, place)""",
    "form_table_note": rf"""WITH RECURSIVE {_GROUPS}, n AS (SELECT doc_id, place, after, style = 2 AS by_name FROM w JOIN v USING (doc_id, place)
          WHERE marker NOT LIKE '#%' AND NOT (style = 3 AND char = 1) AND NOT coalesce(starts_with(prefix, 'AUTO_'), false) AND (style = 2 OR seen >= 2 AND after = seen))
        SELECT doc_id, place::INTEGER AS place, by_name FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY after DESC, place) = 1""",
    "guessed_depths": rf"""WITH {_DEPTHS} SELECT doc_id, ln::INTEGER AS ln, number, symbol, depth, text, array_to_string(ats, ',') AS "at" FROM d WHERE kind = 'para'""",
    "guessed_text": rf"""WITH {_DEPTHS},
        r AS (SELECT *, {_MARK.format("CASE WHEN kind = 'para' THEN dense_rank() OVER (PARTITION BY doc_id, kind = 'para' ORDER BY depth) END")} AS marker, coalesce(sum(len(ats)) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM d),
        -- notes go in from the last place to the first
        z AS (SELECT *, least(length(text), ats[1]) AS a1, least(length(text), ats[2]) AS a2 FROM r),
        y AS (SELECT *, ats[1] = ats[2] AS same, CASE WHEN len(ats) = 2 THEN substring(text, 1, a2) || '[^' || CASE WHEN ats[1] = ats[2] THEN k + 1 ELSE k + 2 END || ']' || substring(text, a2 + 1) ELSE text END AS t2 FROM z),
        t AS (SELECT *, CASE WHEN len(ats) > 0 THEN substring(t2, 1, a1) || '[^' || CASE WHEN same THEN k + 2 ELSE k + 1 END || ']' || substring(t2, a1 + 1) ELSE t2 END AS said,
                     list_transform(regexp_split_to_array(line, '[.,]'), lambda x: string_split(trim(x), ' ')[1:4]) AS rows FROM y),
        w AS (SELECT *, list_max(list_transform(rows, lambda x: len(x))) AS wide FROM t),
        oo AS (SELECT doc_id, ln, kind, k, ats, CASE kind WHEN 'para' THEN regexp_replace(marker || ' ' || said, '^[{_BLANKS}]+|[{_BLANKS}]+$', '', 'g') WHEN 'picture' THEN '{readback.PICTURE}'
                     ELSE array_to_string(list_transform(rows, lambda x, i: '| ' || array_to_string(x || list_transform(range(wide - len(x)), lambda q: ''), ' | ') || ' |' || CASE i WHEN 1 THEN chr(10) || '|' || repeat('---|', wide) ELSE '' END), chr(10)) || chr(10) END AS line FROM w),
        pp AS (SELECT *, CASE WHEN kind <> 'para' AND lag(kind) OVER x IS NOT NULL AND lag(kind) OVER x <> 'table' AND lag(line) OVER x <> '' THEN chr(10) ELSE '' END || line AS lines FROM oo WINDOW x AS (PARTITION BY doc_id ORDER BY ln)),
        n AS (SELECT doc_id, k + unnest(range(len(ats))) + 1 AS number, unnest(range(len(ats))) AS j, ln FROM pp),
        e AS (SELECT doc_id, string_agg('[^' || number || ']: ' || CASE j WHEN 0 THEN 'n' || ln ELSE 'second' END, chr(10) ORDER BY number) AS notes FROM n GROUP BY doc_id),
        body AS (SELECT doc_id, string_agg(lines, chr(10) ORDER BY ln) AS b FROM pp GROUP BY doc_id)
        SELECT doc_id, regexp_replace(b || coalesce(chr(10) || chr(10) || notes, ''), '[{_BLANKS}]+$', '') || chr(10) AS text FROM body LEFT JOIN e USING (doc_id)""",
    "guessed_evidence": rf"""WITH {_DEPTHS}, g AS (SELECT doc_id, depth, arg_min(struct_pack(a := number, b := symbol, c := pt), ln) AS x, count(*) AS n FROM d WHERE kind = 'para' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth)::INTEGER AS step FROM g)
        SELECT doc_id, step, CASE WHEN x.a IS NOT NULL THEN 'number' WHEN x.b IS NOT NULL THEN 'symbol' ELSE 'size' END AS reason, coalesce(x.a, x.b, x.c || '.0') AS value, n, {_MARK.format("step")} AS marker FROM r""",
    "merge_cards": f"""WITH {_SAVED}, o AS (SELECT id, min(ord) AS place, arg_max(text, ord) AS text FROM c WHERE round = 0 GROUP BY id), n AS (SELECT id, min(ord) AS place, arg_max(text, ord) AS text FROM c WHERE round > 0 GROUP BY id),
        b AS (SELECT id, row_number() OVER (ORDER BY n.place, id) AS k FROM n ANTI JOIN o USING (id))
        SELECT id, coalesce(o.place, (SELECT max(place) FROM o) + k)::BIGINT AS ord, sha256(coalesce(n.text, o.text)) AS card FROM o FULL JOIN n USING (id) LEFT JOIN b USING (id)""",
    "stream_cards": f"""WITH {_SAVED}, f AS (SELECT id, min((round, ord)) AS first, arg_max(text, (round, ord)) AS text FROM c GROUP BY id)
        SELECT id, row_number() OVER (ORDER BY first) - 1 AS ord, sha256(text) AS card FROM f""",
    # every earlier card of the document is scored, and the greedy choice goes through all of them
    "card_window": """WITH RECURSIVE n AS (SELECT l_partkey AS doc, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS ord,
                             printf('%02d', l_linenumber % 3 + 1) AS chapter, l_quantity::INT AS size FROM lineitem),
        sc AS (SELECT t.doc, t.ord AS target, c.ord, c.size, 10 + CASE WHEN t.ord % 4 = 1 AND c.ord = t.ord - 25 THEN 100 ELSE 0 END + CASE WHEN c.chapter = '01' THEN 60 ELSE 0 END + CASE WHEN c.chapter = t.chapter THEN 40 ELSE 0 END
                      + CASE WHEN c.ord = t.ord - 1 THEN 30 ELSE 0 END + greatest(0, 20 - (t.ord - c.ord)) AS score FROM n t JOIN n c ON c.doc = t.doc AND c.ord < t.ord),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc, target ORDER BY score DESC, ord) AS i FROM sc),
        p AS (SELECT doc, target, 0::BIGINT AS i, 5 AS used, NULL::BIGINT AS ord, false AS got FROM (SELECT DISTINCT doc, target FROM o)
          UNION ALL SELECT o.doc, o.target, o.i, CASE WHEN p.used + o.size + 1 > 150 THEN p.used ELSE p.used + o.size + 1 END, o.ord, p.used + o.size + 1 <= 150 FROM p JOIN o ON o.doc = p.doc AND o.target = p.target AND o.i = p.i + 1)
        SELECT doc || '-' || target AS key, ord::INTEGER AS ord, ord::INTEGER AS id FROM p WHERE got""",
    # the zone's clocks go from UTC-8 to UTC-7 at 10 in the morning UTC of the second Sunday of March
    "stream_ledger": """WITH e AS (SELECT user_id::VARCHAR AS model, ts + INTERVAL 55 DAY AS t, event_type = 'error' AS bad, CASE WHEN event_type = 'error' THEN floor(value)::BIGINT END AS lim FROM events),
        z AS (SELECT *, (t - CASE WHEN t >= TIMESTAMP '2024-03-10 10:00:00' THEN INTERVAL 7 HOUR ELSE INTERVAL 8 HOUR END)::DATE AS day FROM e)
        SELECT model, day::VARCHAR AS day, count(*) AS n, bool_or(bad) AS exhausted, coalesce(arg_max(lim, t) FILTER (WHERE lim > 0), 0) AS "limit" FROM z GROUP BY model, day""",
    "diagram_blocks": rf"""WITH {_FENCED} SELECT doc_id, block, line_no AS line, type, title, 'side' AS layout, sha256(coalesce(string_agg(rtrim(t, ' '), '/' ORDER BY ln) FILTER (ln BETWEEN lo AND hi), '')) AS body
        FROM (SELECT *, min(CASE WHEN trim(t) <> '' AND ln > head THEN ln END) OVER (PARTITION BY doc_id, block) AS lo, max(CASE WHEN trim(t) <> '' AND ln > head THEN ln END) OVER (PARTITION BY doc_id, block) AS hi FROM b) GROUP BY doc_id, block, line_no, type, title""",
    "diagram_trees": rf"""WITH RECURSIVE {_FENCED}, k AS (SELECT doc_id, block, (ln - head - 1)::INTEGER AS ln, length(line) % 3 * 2 AS ind, regexp_replace(regexp_replace('- ' || line, '[ \t]+$', ''), '^[-*•]\s+', '') AS t FROM b WHERE type = 'org' AND ln > head),
        u AS (SELECT *, (SELECT max(y.ln) FROM k y WHERE y.doc_id = k.doc_id AND y.block = k.block AND y.ln < k.ln AND y.ind < k.ind) AS parent FROM k),
        w AS (SELECT *, 0 AS depth FROM u WHERE parent IS NULL UNION ALL SELECT u.*, depth + 1 FROM u JOIN w ON w.doc_id = u.doc_id AND w.block = u.block AND w.ln = u.parent),
        f AS (SELECT *, NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = w.doc_id AND u.block = w.block AND u.parent = w.ln) AS leaf FROM w),
        g AS (SELECT *, coalesce((SELECT min(y.ln) FROM f y WHERE y.doc_id = f.doc_id AND y.block = f.block AND y.ln > f.ln AND y.depth <= f.depth), 999) AS stop FROM f)
        SELECT doc_id, block, ln, parent, depth, sha256(regexp_replace(regexp_replace(t, '\s*\{{[^{{}}]*\}}\s*$', ''), '^{_S}+|{_S}+$', '', 'g')) AS text, (SELECT count(*) FROM f y WHERE y.doc_id = g.doc_id AND y.block = g.block AND y.leaf AND y.ln < g.ln)::INTEGER AS first,
               (SELECT count(*) - 1 FROM f y WHERE y.doc_id = g.doc_id AND y.block = g.block AND y.leaf AND y.ln < g.stop)::INTEGER AS last FROM g""",
    "diagram_bands": rf"""WITH {_FENCED}, k AS (SELECT doc_id, block, ln, trim(t) AS t FROM b WHERE type <> 'org' AND ln > head AND trim(t) <> '' AND ln % 4 <> 2 AND NOT regexp_matches(trim(t), '^\|[\s:|-]+\|?$')),
        p AS (SELECT *, list_transform(string_split(t, '|'), lambda x: trim(x)) AS a FROM k), q AS (SELECT *, list_max(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN a[i] <> '' THEN i ELSE 1 END)) AS n FROM p),
        h AS (SELECT doc_id, block, ln, CASE WHEN n = 1 THEN '' ELSE a[1] END AS head, list_filter(list_transform(CASE WHEN n = 1 THEN a[1:1] ELSE a[2:n] END, lambda x: trim(regexp_replace(x, '\s*\{{[^{{}}]*\}}\s*$', ''))), lambda x: x <> '') AS cells FROM q),
        g AS (SELECT *, sum(CASE WHEN head <> '' OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY ln)::INTEGER - 1 AS band FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY ln) AS i FROM h WHERE len(cells) > 0)),
        r AS (SELECT *, trim(regexp_replace(first(head) OVER (PARTITION BY doc_id, block, band ORDER BY ln), '\s*\{{[^{{}}]*\}}\s*$', '')) AS label, (row_number() OVER (PARTITION BY doc_id, block, band ORDER BY ln) - 1)::INTEGER AS row FROM g)
        SELECT doc_id, block, band, label, row, unnest(range(len(cells)))::INTEGER AS cell, sha256(unnest(cells)) AS text FROM r""",
    "numbered_lines": """WITH m AS (SELECT conv_id, turn AS ln, (coalesce(length(text), 0) + turn)::INT AS z FROM conversations), i AS (SELECT conv_id, ln, z % 4 + 1 AS lv FROM m WHERE z % 7 > 0 AND z % 11 > 0),
        -- for each line and each level down to its own: how many of that level since the last line of a higher one
        c AS (SELECT x.conv_id, x.ln, x.lv, k, (SELECT count(*) FROM i y WHERE y.conv_id = x.conv_id AND y.ln <= x.ln AND y.lv = k AND y.ln > coalesce((SELECT max(h.ln) FROM i h WHERE h.conv_id = x.conv_id AND h.ln <= x.ln AND h.lv < k), -1)) AS n FROM i x, range(1, 5) t(k) WHERE k <= x.lv),
        p AS (SELECT conv_id, ln, lv, string_agg(n::VARCHAR, '.' ORDER BY k) AS path, arg_max(n, k) AS n FROM c GROUP BY ALL),
        q AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN ['R', 'N', 'P', 'C'] ELSE ['H', 'A', '', 'N'] END[lv] AS kind FROM p)
        SELECT conv_id, ln, CASE kind WHEN 'R' THEN 'ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ'[(n - 1) % 12 + 1] || '. ' WHEN 'N' THEN n || '. ' WHEN 'P' THEN n || ') ' WHEN 'C' THEN '①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮'[(n - 1) % 15 + 1] || ' ' WHEN 'H' THEN '가나다라마바사아자차카타파하'[(n - 1) % 14 + 1] || '. '
               WHEN 'A' THEN chr((65 + (n - 1) % 26)::INTEGER) || '. ' ELSE '' END AS number, path FROM q""",
    "fitted_turns": """WITH w AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM conversations)
        SELECT conv_id, turn, s AS "start", least(length(text), greatest(0, 1500 - s))::INTEGER AS n, CASE WHEN s + length(text) <= 1500 THEN 'whole' WHEN s < 1500 THEN 'cut' ELSE 'dropped' END AS state, sha256(substring(text, 1, greatest(0, 1500 - s)::BIGINT)) AS shown FROM w""",
    # character by character: inside after an odd number of quotes; a quote right behind one that closed is text
    "csv_fields": """WITH t AS (SELECT doc_id, replace(text, 're', '"') AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM t),
        q AS (SELECT *, sum((c = '"')::INTEGER) OVER x AS n, lag(c) OVER x AS b FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
        k AS (SELECT *, CASE WHEN c = '"' THEN b = '"' AND n % 2 = 1 WHEN n % 2 = 1 THEN true ELSE c NOT IN (',', chr(10), chr(13)) END AS kept, n % 2 = 0 AND c = chr(10) OR n % 2 = 0 AND c = chr(13) AS nl, n % 2 = 0 AND c = ',' AS comma FROM q),
        f AS (SELECT *, coalesce(sum(nl::INTEGER) OVER y, 0) AS row, coalesce(sum((nl OR comma)::INTEGER) OVER y, 0) AS cell FROM k WINDOW y AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        e AS (SELECT doc_id, row, cell, c, i, kept FROM f UNION ALL SELECT doc_id, sum(nl::INTEGER), sum((nl OR comma)::INTEGER), '', max(i) + 1, false FROM k GROUP BY doc_id),
        g AS (SELECT doc_id, row, cell, coalesce(string_agg(c, '' ORDER BY i) FILTER (kept), '') AS v FROM e GROUP BY ALL),
        h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, row) AS m, row = max(row) OVER (PARTITION BY doc_id) AS final FROM g)
        SELECT doc_id, row::INTEGER AS row, (row_number() OVER (PARTITION BY doc_id, row ORDER BY cell) - 1)::INTEGER AS field, sha256(v) AS value FROM h WHERE NOT (final AND m = 1 AND v = '')""",
}
