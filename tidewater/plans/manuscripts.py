"""Documents as marked manuscripts: blocks, footnotes and chapters, with SQL that restates their rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import markers

from . import adapters as a


def marker_blocks(s: SparkSession, d: str) -> DataFrame:
    b = markers.blocks(a.marked_documents(s, d), "doc_id", "text")
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return b.select("doc_id", "line", "kind", "level", F.sha2("text", 256).alias("text"), rows.alias("rows"), "caption", F.array_join(F.transform("cols", lambda c: c.cast("int").cast("string")), ",").alias("cols"), "name")


def marker_footnotes(s: SparkSession, d: str) -> DataFrame:
    m = a.marked_documents(s, d)
    n = markers.footnotes(markers.blocks(m, "doc_id", "text"), markers.definitions(m, "doc_id", "text"), "doc_id")
    return n.select("doc_id", "line", "level", "nth", "label", "note", "offset", "before", "after", "number", "use")


def marker_chapters(s: SparkSession, d: str) -> DataFrame:
    return markers.chapters(a.marked_documents(s, d), "doc_id", "text")


def marker_issues(s: SparkSession, d: str) -> DataFrame:
    """Everything that reading and checking finds in the manuscripts."""
    return markers.issues(a.marked_documents(s, d), "doc_id", "text")


def issue_tally(s: SparkSession, d: str) -> DataFrame:
    return markers.tally(marker_issues(s, d), "doc_id")


QUERIES = {f.__name__: f for f in (marker_blocks, marker_footnotes, marker_chapters, marker_issues, issue_tally)}

_S = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_BLOCKS = rf"""
    l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents WHERE text IS NOT NULL),
    l1 AS (SELECT *, length(line) AS n, string_split(line, ' ') AS w, (ln + length(line) // 64) % 15 AS k FROM l0),
    l2 AS (SELECT doc_id, ln + 1 AS ln, CASE k WHEN 0 THEN '# ' || line WHEN 1 THEN '○ ' || line || '[^' || ln || '] tail' WHEN 2 THEN '[^' || (ln - 1) || ']: ' || coalesce(w[1], '') WHEN 3 THEN '[표: ' || coalesce(w[1], '') || ']' WHEN 4 THEN '| ' || coalesce(w[1], '') || ' | ' || coalesce(w[2], '') || ' |'
               WHEN 5 THEN '|---|:--|' WHEN 6 THEN '| ' || coalesce(w[3], '') || ' |' WHEN 7 THEN '※ ' || line WHEN 8 THEN '' WHEN 9 THEN '  - [^' || ln || ']' || line || '[^gone]' WHEN 10 THEN line WHEN 11 THEN '{{cols=1,' || (n % 3) || '}}' WHEN 12 THEN '[장: ' || coalesce(w[1], '') || ']'
               WHEN 13 THEN '#### ' || coalesce(w[2], '') || '[^' || (ln - n % 20) || ']' ELSE '![x](' || coalesce(w[1], '') || '.png)' END AS s0, ln + 1 = count(*) OVER (PARTITION BY doc_id) AS final FROM l1),
    l AS (SELECT doc_id, ln, regexp_replace(s0, '^{_S}+|{_S}+$', '', 'g') AS s FROM l2 WHERE NOT (final AND s0 = '')),
    x AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^\[\^([^\]\s]+)\]:\s*(.*)$') THEN 'definition' WHEN regexp_matches(s, '^\[장\s*[:：]\s*(.+?)\]\s*$') THEN 'chapter' WHEN regexp_matches(s, '^\[표\s*[:：]\s*(.+?)\]\s*$') THEN 'caption'
               WHEN regexp_matches(s, '^\{{cols\s*=\s*([\d.,\s]+)\}}\s*$') THEN 'columns' WHEN regexp_matches(s, '^!\[[^\]]*\]\(([^)]+)\)\s*$') THEN 'image' WHEN starts_with(s, '|') THEN 'table' WHEN starts_with(s, '※ ') THEN 'note'
               WHEN regexp_matches(s, '^(#{{1,4}}|[○▪·-]) ') THEN 'para' ELSE 'plain' END AS kind FROM l),
    y AS (SELECT *, kind = 'table' AND regexp_matches(s, '^\|[\s:|-]+\|$') AS sep, sum(CASE WHEN kind = 'table' AND coalesce(before, '') <> 'table' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS tab FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM x)),
    t AS (SELECT doc_id, tab, min(ln) AS first, list(list_transform(string_split(regexp_replace(s, '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)) ORDER BY ln) FILTER (NOT sep) AS raw FROM y WHERE kind = 'table' GROUP BY doc_id, tab),
    z AS (SELECT y.*, raw, kind IN ('image', 'note', 'para', 'plain') OR kind = 'table' AND ln = first AND raw IS NOT NULL AS makes FROM y LEFT JOIN t ON t.doc_id = y.doc_id AND t.tab = y.tab AND y.kind = 'table'),
    -- what lies before and behind each line
    e AS (SELECT *, count(CASE WHEN makes OR kind = 'definition' THEN 1 END) OVER p AS segment, count(CASE WHEN makes THEN 1 END) OVER p AS made, first_value(CASE WHEN makes THEN 'block' WHEN kind = 'definition' THEN kind END IGNORE NULLS) OVER n AS next,
                 max(CASE WHEN kind IN ('note', 'para', 'plain', 'table') THEN ln END) OVER p AS cleared, max(CASE WHEN kind = 'table' THEN ln END) OVER p AS tabled, max(CASE WHEN kind = 'caption' THEN ln END) OVER p AS cap, max(CASE WHEN kind = 'columns' THEN ln END) OVER p AS col
          FROM z WINDOW p AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, segment, kind = 'blank' ORDER BY ln) AS nth FROM e),
    k AS (SELECT *, CASE WHEN kind = 'plain' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY ln) IN ('para', 'plain') THEN 0 ELSE 1 END AS starts FROM r WHERE makes OR kind = 'blank' AND made > 0 AND coalesce(next, '') <> 'definition' AND nth = 1),
    b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ln) AS block, CASE kind WHEN 'note' THEN substring(s, 3) WHEN 'para' THEN regexp_replace(s, '^(#{{1,4}}|[○▪·-]) ', '') ELSE s END AS body0 FROM k),
    g AS (SELECT doc_id, block, min(ln) AS line, arg_min(kind, ln) AS k0, arg_min(s, ln) AS s, arg_min(cap, ln) AS cap, arg_min(col, ln) AS col, arg_min(cleared, ln) AS cleared, arg_min(tabled, ln) AS tabled, arg_min(raw, ln) AS raw,
                 string_agg(regexp_replace(body0, '^{_S}+|{_S}+$', '', 'g'), ' ' ORDER BY ln) AS said FROM b GROUP BY doc_id, block),
    blocks AS (SELECT g.doc_id, line, raw, CASE WHEN k0 = 'table' AND g.col > coalesce(g.tabled, 0) THEN 2 END AS widths, CASE k0 WHEN 'plain' THEN 'para' WHEN 'note' THEN 'table_note' ELSE k0 END AS kind,
                 CASE k0 WHEN 'plain' THEN 'b4' WHEN 'para' THEN CASE WHEN starts_with(g.s, '#') THEN 'h' || (length(g.s) - length(ltrim(g.s, '#'))) ELSE 'b' || strpos('○▪-·', g.s[1]) END END AS level,
                 CASE WHEN k0 IN ('plain', 'para', 'note') THEN said ELSE '' END AS text, CASE WHEN k0 = 'table' THEN list_transform(raw, lambda q: (q || list_transform(range(len(raw[1])), lambda i: ''))[1:len(raw[1])]) END AS rows,
                 CASE WHEN k0 = 'table' THEN CASE WHEN g.cap > coalesce(g.cleared, 0) THEN regexp_extract(c.s, '^\[표\s*[:：]\s*(.+?)\]\s*$', 1) ELSE '' END END AS caption,
                 CASE WHEN k0 = 'table' AND g.col > coalesce(g.tabled, 0) AND len(raw[1]) = 2 THEN regexp_extract(w.s, '=\s*([\d,]+)', 1) END AS cols, CASE WHEN k0 = 'image' THEN regexp_extract(g.s, '^!\[[^\]]*\]\(([^)]+)\)', 1) END AS name
          FROM g LEFT JOIN l c ON c.doc_id = g.doc_id AND c.ln = g.cap LEFT JOIN l w ON w.doc_id = g.doc_id AND w.ln = g.col)"""

_NOTES = rf"""{_BLOCKS}, defs AS (SELECT doc_id, regexp_extract(s, '^\[\^([^\]\s]+)\]:', 1) AS label, arg_max(regexp_replace(regexp_extract(s, '^\[\^[^\]\s]+\]:\s*(.*)$', 1), '^{_S}+|{_S}+$', '', 'g'), ln) AS note FROM x WHERE kind = 'definition' GROUP BY ALL),
        p AS (SELECT doc_id, line, level, regexp_extract_all(text, '\[\^([^\]\s]+)\]', 1) AS labels, string_split_regex(text, '\[\^([^\]\s]+)\]') AS gaps FROM blocks WHERE kind = 'para'),
        u AS (SELECT doc_id, line, level, unnest(range(len(labels))) AS nth, unnest(labels) AS label, gaps FROM p), j AS (SELECT u.*, note FROM u LEFT JOIN defs USING (doc_id, label)),
        -- the text as it is shown up to each reference
        h AS (SELECT *, string_agg(gaps[nth + 1] || CASE WHEN note IS NULL THEN '[^' || label || ']' ELSE '' END, '') OVER (PARTITION BY doc_id, line ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown FROM j),
        q AS (SELECT *, coalesce(shown, '') || gaps[nth + 1] AS upto FROM h),
    notes AS (SELECT doc_id, line::INTEGER AS line, level, nth::INTEGER AS nth, label, note, length(upto)::INTEGER AS "offset", right(upto, 1) AS before, left(gaps[nth + 2], 1) AS after,
               CASE WHEN note IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, note IS NOT NULL ORDER BY line, nth) END::INTEGER AS number, CASE WHEN note IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, label ORDER BY line, nth) END::INTEGER AS use FROM q)"""
_ISSUES = rf"""{_NOTES},
    m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ln) AS nth, row_number() OVER (PARTITION BY doc_id, kind, regexp_extract(s, '^\[\^([^\]\s]+)\]:', 1) ORDER BY ln) AS again FROM x),
    nb AS (SELECT *, coalesce(lag(kind) OVER o, 'blank') AS b, coalesce(lead(kind) OVER o, 'blank') AS a, last_value(CASE WHEN kind <> 'blank' THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM blocks WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
    dp AS (SELECT *, list_position(['h1', 'h2', 'h3', 'h4', 'b1', 'b2', 'b3', 'b4'], level) AS depth, lag(list_position(['h1', 'h2', 'h3', 'h4', 'b1', 'b2', 'b3', 'b4'], level)) OVER (PARTITION BY doc_id ORDER BY line) AS over FROM blocks WHERE kind = 'para'),
    issues AS (SELECT doc_id, ln AS line, 'footnote defined twice' AS issue FROM m WHERE kind = 'definition' AND again > 1
      UNION ALL SELECT doc_id, ln, 'empty footnote' FROM m WHERE kind = 'definition' AND regexp_matches(s, '^\[\^[^\]\s]+\]:\s*$')
      UNION ALL SELECT doc_id, ln, 'chapter named twice' FROM m WHERE kind = 'chapter' AND nth > 1
      UNION ALL SELECT doc_id, ln, 'caption without a table' FROM e WHERE kind IN ('note', 'para', 'plain') AND cap > coalesce(cleared, 0)
      UNION ALL SELECT doc_id, ln, 'line without a marker' FROM x WHERE kind = 'plain'
      UNION ALL SELECT doc_id, line, 'row of another width' FROM blocks WHERE len(list_filter(raw, lambda q: len(q) <> len(raw[1]))) > 0
      UNION ALL SELECT doc_id, line, 'widths for another number of columns' FROM blocks WHERE widths <> len(raw[1])
      UNION ALL SELECT doc_id, line, 'footnote in a table' FROM blocks WHERE len(list_filter(flatten(raw), lambda q: regexp_matches(q, '\[\^[^\]\s]+\]'))) > 0
      UNION ALL SELECT doc_id, line, 'footnote without a definition' FROM notes WHERE note IS NULL
      UNION ALL SELECT doc_id, line, 'footnote used again' FROM notes WHERE use > 1
      UNION ALL SELECT doc_id, max(ln), 'footnote never used' FROM (SELECT doc_id, ln, regexp_extract(s, '^\[\^([^\]\s]+)\]:', 1) AS label FROM x WHERE kind = 'definition') ANTI JOIN notes USING (doc_id, label) GROUP BY doc_id, label
      UNION ALL SELECT doc_id, line, 'table note without a table' FROM nb WHERE kind = 'table_note' AND p IS DISTINCT FROM 'table'
      UNION ALL SELECT doc_id, line, 'no blank line before a table' FROM nb WHERE kind = 'table' AND b <> 'blank'
      UNION ALL SELECT doc_id, line, 'no blank line after a table' FROM nb WHERE kind = 'table' AND a NOT IN ('blank', 'table_note')
      UNION ALL SELECT doc_id, line, 'empty paragraph' FROM blocks WHERE kind = 'para' AND trim(text) = ''
      UNION ALL SELECT doc_id, line, 'level passed over' FROM dp WHERE depth - over > 1
      UNION ALL SELECT doc_id, line, 'footnote in a heading' FROM notes WHERE note IS NOT NULL AND level LIKE 'h%'
      UNION ALL SELECT doc_id, line, 'footnote at the start' FROM notes WHERE note IS NOT NULL AND before = ''
      UNION ALL SELECT doc_id, line, 'space before a footnote' FROM notes WHERE note IS NOT NULL AND regexp_matches(before, '^{_S}+$')
      UNION ALL SELECT doc_id, line, 'footnote after a full stop' FROM notes WHERE note IS NOT NULL AND before IN ('.', '。', '!', '?')
      UNION ALL SELECT doc_id, line, 'footnote out of order' FROM notes WHERE note IS NOT NULL AND regexp_matches(label, '^[0-9]+$') AND label::INTEGER <> number)"""

ORACLES = {
    "marker_blocks": f"WITH {_BLOCKS} SELECT doc_id, line::INTEGER AS line, kind, level, sha256(text) AS text, array_to_string(list_transform(rows, lambda q: array_to_string(q, '|')), '/') AS rows, trim(caption) AS caption, cols, trim(name) AS name FROM blocks",
    "marker_chapters": rf"WITH {_BLOCKS} SELECT doc_id, regexp_replace(regexp_extract(arg_max(s, ln), '^\[장\s*[:：]\s*(.+?)\]\s*$', 1), '^{_S}+|{_S}+$', '', 'g') AS chapter FROM x WHERE kind = 'chapter' GROUP BY doc_id",
    "marker_footnotes": f"WITH {_NOTES} SELECT * FROM notes",
    "marker_issues": f"WITH {_ISSUES} SELECT doc_id, line::INTEGER AS line, issue FROM issues",
    "issue_tally": f"WITH {_ISSUES} SELECT doc_id, issue, count(*) AS n FROM issues GROUP BY doc_id, issue",
}
