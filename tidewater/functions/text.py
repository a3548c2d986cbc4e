"""Column functions for text: clean-up, clipping, outline lines, numbers with units, headings, inline styles, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of marked lines. Levels 1-4 are headings by number of #, 5-8 bullets.
BULLETS = {"○": 5, "▪": 6, "-": 7, "·": 8}
NOTE_MARKS = ("※", "주)", "자료:", "자료：")
# Units of numbers that later sections are held to.
UNITS = ("%", "퍼센트", "명", "가구", "개소", "개", "건", "곳", "억원", "백만원", "천원", "원", "년", "세", "회")
# Symbols that stand for a marker, and the markers themselves.
ALIASES = {
    "⧠": "□", "❑": "□", "■": "□", "▢": "□", "－": "-", "–": "-", "—": "-", "\uf02d": "-", "\uf09f": "·",
    "∙": "·", "•": "·", "･": "·", "‧": "·", "◦": "○", "〇": "○", "◯": "○", "\uf0a1": "○",
}
MARKERS = "□○-·･•▪◦∙※◇◆▶"
LINE_TYPES = {"solid": "SOLID", "dash": "DASH", "dot": "DOT", "dashdot": "DASH_DOT", "dashdotdot": "DASH_DOT_DOT", "longdash": "LONG_DASH"}
LINE_WORDS = {"점선": "dash", "파선": "dash", "실선": "solid"}


def trim(c: Column) -> Column:
    """Without white space at both ends, Unicode ones too."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Runs of white space, Unicode ones too, become one space; trimmed."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def bare(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def units16(c: Column) -> Column:
    """Length in UTF-16 units, by which limits of characters are counted."""
    return F.length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "xx"))


def clip(c: Column, n: int) -> Column:
    """Squashed text of at most n characters; longer ones end in an ellipsis."""
    s = squash(c)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n - 1), F.lit("…"))).otherwise(s)


def line_kind(c: Column) -> Column:
    """blank, sep, table, note, item or text. A table line starts with a bar; a bullet needs white space or nothing behind it."""
    t = trim(c)
    note = t.startswith(NOTE_MARKS[0])
    for mark in NOTE_MARKS[1:]:
        note = note | t.startswith(mark)
    return (
        F.when(t == "", "blank").when(t.rlike(r"(?U)^\|[\s:|\-─]+\|?$"), "sep").when(t.startswith("|"), "table")
        .when(note, "note").when(t.rlike(r"(?U)^(#{1,4}\s|[○▪·-](\s|$))"), "item").otherwise("text")
    )


def line_level(c: Column) -> Column:
    """1-4 for headings, 5-8 for bullets, else null."""
    t = trim(c)
    out = F.when(t.rlike(r"(?U)^#{1,4}\s"), F.length(F.regexp_extract(t, "^(#+)", 1)))
    for mark, level in BULLETS.items():
        out = out.when(t.rlike(rf"(?U)^{mark}(\s|$)"), level)
    return out.cast("int")


def item_text(c: Column) -> Column:
    """A line without its mark."""
    return trim(F.regexp_replace(trim(c), r"(?U)^(#{1,4}\s+|[○▪·-](\s|$))", ""))


def numbers_with_units(c: Column) -> Column:
    """All numbers that a unit follows, as number and unit without the space between."""
    unit = "|".join(UNITS)
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(\d[\d,]*(?:\.\d+)?)\s*({unit})"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))


def number_tokens(c: Column, most: int = 12) -> Column:
    """The first distinct numbers with their units, at most `most`."""
    return F.slice(F.array_distinct(numbers_with_units(c)), 1, most)


def particle(c: Column) -> Column:
    """은 after a final consonant, 는 otherwise."""
    cp = F.ascii(F.substring(c, -1, 1))
    return F.when((cp >= 44032) & (cp <= 55203), F.when((cp - 44032) % 28 > 0, "은").otherwise("는")).otherwise("는")


def column_index(c: Column) -> Column:
    """Spreadsheet letters to a number from 0; -1 where there are none: BC12 is 54."""
    letters = F.split(F.upper(F.regexp_extract(c, "^([A-Za-z]+)", 1)), "")
    return F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64) - 1


def split_lines(c: Column) -> Column:
    """Lines at every Unicode line break; a break at the very end opens no further line, and an empty text has none."""
    parts = F.split(c, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def pipe_cells(c: Column) -> Column:
    """Cells of a line between bars, trimmed."""
    return F.transform(F.split(F.regexp_replace(c, r"^\||\|$", ""), r"\|"), trim)


def strip_fence(c: Column) -> Column:
    """Without the fence of a code block."""
    return trim(F.regexp_replace(F.regexp_replace(c, r"(?i)^```[a-z]*\n?", ""), r"(?U)```\s*$", ""))


def table_cell(c: Column) -> Column:
    """Text for one cell of a bar table: in one line, bars replaced, a space where nothing is left."""
    s = trim(F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "), "|", "∣"))
    return F.when(s == "", " ").otherwise(s)


def safe_name(c: Column, n: int = 80) -> Column:
    """A file name without what file systems forbid."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]', "_"), r"(?U)\s+", "_"), 1, n)


def heading(c: Column, depth: int) -> Column:
    """(no, title) of a heading line of a depth: `가. x` or `[첨부 n] x`, `n) x`, `(n) x`; null where it is none."""
    def one(pattern: str, no: Column, at: int) -> Column:
        return F.when(c.rlike(pattern), F.struct(no.alias("no"), trim(F.regexp_extract(c, pattern, at)).alias("title")))

    got = lambda p, i: F.regexp_extract(c, p, i)
    if depth == 1:
        a, b = r"^\s*([가-힣])\.\s*(\S.*)$", r"^\s*\[(첨부|별첨)\s*(\d+)\]\s*(\S.*)$"
        return F.coalesce(one(a, got(a, 1), 2), one(b, F.concat(got(b, 1), got(b, 2)), 3))
    if depth == 2:
        p = r"^\s*(\d+)\)\s*(\S.*)$"
        return one(p, got(p, 1), 2)
    p = r"^\s*\((\d+)\)\s*(\S.*)$"
    return one(p, F.concat(F.lit("("), got(p, 1), F.lit(")")), 2)


def toc_entry(c: Column) -> Column:
    """(chapter, page) of a line of contents such as `01Title _ 76`; null where it is none."""
    p = r"^(\d{2})(\S.*?)\s*_\s*(\d+)$"
    t = trim(c)
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).cast("int").alias("chapter"), F.regexp_extract(t, p, 3).cast("int").alias("page")))


def header_line(cells: Column) -> Column:
    """Header cells in one line; null where all are blank."""
    flat = F.transform(cells, lambda x: squash(F.coalesce(x, F.lit(""))))
    return F.when(F.exists(flat, lambda x: x != ""), F.array_join(flat, " | "))


def marker_of(c: Column) -> Column:
    """A bullet's character as a marker that can be typed; empty where it isn't known."""
    out = F.translate(c, "".join(ALIASES), "".join(ALIASES.values()))
    return F.when((F.length(out) == 1) & F.lit(MARKERS).contains(out), out).otherwise("")


def color(c: Column) -> Column:
    """#RRGGBB of three or six hex digits; else null."""
    v = F.regexp_replace(trim(c), "^#", "")
    v = F.when(v.rlike("^[0-9a-fA-F]{3}$"), F.regexp_replace(v, "(.)", "$1$1")).otherwise(v)
    return F.when(v.rlike("^[0-9a-fA-F]{6}$"), F.concat(F.lit("#"), F.upper(v)))


def line_type(c: Column) -> Column:
    """Name of a line's type, from several spellings; else null."""
    v = F.regexp_replace(F.lower(trim(c)), "[-_]", "")
    pairs = [(k, v2) for k, v2 in LINE_TYPES.items()] + [(k, LINE_TYPES[w]) for k, w in LINE_WORDS.items()]
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), v)


def split_attrs(c: Column) -> Column:
    """(text, attrs) of `text {key=value, key="other value"}`."""
    inner = F.regexp_extract(c, r"\s*\{([^{}]*)\}\s*$", 1)
    tokens = F.filter(F.regexp_extract_all(F.translate(inner, ",", " "), F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0)), lambda x: x.rlike("^[^=]+="))
    entry = lambda x: F.struct(F.lower(trim(F.substring_index(x, "=", 1))).alias("key"), F.regexp_replace(trim(F.regexp_replace(x, "^[^=]+=", "")), "^[\"']|[\"']$", "").alias("value"))
    entries = F.transform(tokens, entry)
    # the last of several values of a key counts
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    return F.struct(trim(F.regexp_replace(c, r"\s*\{[^{}]*\}\s*$", "")).alias("text"), F.map_from_entries(last).alias("attrs"))


def zip_path(base: Column, target: Column) -> Column:
    """Path of an archive's entry that `target` means from the folder `base`."""
    def step(path: Column, part: Column) -> Column:
        up = F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), path).when(part == "..", up).otherwise(F.concat(path, F.array(part)))

    parts = F.split(F.concat(base, F.lit("/"), target), "/")
    walked = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(walked)


def extension(c: Column) -> Column:
    """What follows the last dot, in lower case; empty without a dot."""
    return F.when(c.contains("."), F.lower(F.substring_index(c, ".", -1))).otherwise("")


def text_width(c: Column, size: float) -> Column:
    """A generous estimate of the width of a text: spaces and thin letters 0.30, other ASCII 0.56, general punctuation 0.62, others 1."""
    def one(x: Column) -> Column:
        cp = F.ascii(x)
        thin = F.lit("iIl.,:;'`|!").contains(x)
        return F.when((x == " ") | (cp < 128) & thin, 0.30).when(cp < 128, 0.56).when((cp >= 0x2000) & (cp < 0x2100), 0.62).otherwise(1.0)

    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0.0), lambda acc, x: acc + one(x)) * size


def ellipsize(c: Column, size: float, width: float) -> Column:
    """The text, or as much of its start as fits before an ellipsis (one letter at least)."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.array_join(F.slice(letters, 1, n), ""))
    fits = F.filter(starts, lambda s: text_width(F.concat(s, F.lit("…")), size) <= width)
    kept = F.coalesce(F.try_element_at(fits, F.lit(-1)), F.substring(c, 1, 1))
    return F.when(text_width(c, size) <= width, c).otherwise(F.concat(kept, F.lit("…")))


def limit_sentence(scope: Column, op: Column, n: Column, unit: Column, source: Column) -> Column:
    """A limit as a sentence, with the sentence it was taken from."""
    what = F.coalesce(F.nullif(squash(F.coalesce(scope, F.lit(""))), F.lit("")), F.lit("항목"))
    # whole numbers are written without decimals
    count = F.when(n.isNull() | F.isnan(n.cast("double")), "몇").otherwise(F.regexp_replace(n.cast("string"), r"\.0$", ""))
    body = F.concat(what, F.lit(": "), count, F.coalesce(F.nullif(unit, F.lit("")), F.lit("개")), F.when(op == "min", " 이상 쓴다").otherwise(" 이내로 쓴다"))
    said = squash(F.coalesce(source, F.lit("")))
    return F.when(said != "", F.concat(body, F.lit(". 안내서 원문 — “"), said, F.lit("”"))).otherwise(body)


def diagram_header(c: Column) -> Column:
    """(type, title, options) of a diagram block's head such as `type=flow title="a b" line_style=dash`; an unknown type is org."""
    tokens = F.filter(F.regexp_extract_all(c, F.lit(r"""(?:[^\s"']+|"[^"]*"|'[^']*')+"""), F.lit(0)), lambda x: x.rlike("^[^=]+="))
    entries = F.transform(tokens, lambda x: F.struct(trim(F.substring_index(x, "=", 1)).alias("key"), F.regexp_replace(trim(F.regexp_replace(x, "^[^=]+=", "")), "^[\"']|[\"']$", "").alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y["key"] == x["key"]))
    known = F.map_from_entries(last)
    kind = F.element_at(known, "type")
    return F.struct(
        F.when(kind.isin("org", "flow", "matrix", "strategy", "db"), kind).otherwise("org").alias("type"), F.coalesce(F.element_at(known, "title"), F.lit("")).alias("title"),
        F.map_filter(known, lambda k, v: ~k.isin("type", "title")).alias("options"),
    )


def shown(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.left(c, F.lit(n))


def bar_table(grid: Column, cols: Column, most: int = 12) -> Column:
    """The first rows of a grid as lines of a bar table with `cols` cells each."""
    cells = lambda r: F.transform(F.sequence(F.lit(1), cols), lambda i: table_cell(F.try_element_at(r, i)))
    return F.array_join(F.transform(F.slice(F.coalesce(grid, F.array().cast("array<array<string>>")), 1, most), lambda r: F.concat(F.lit("| "), F.array_join(cells(r), " | "), F.lit(" |"))), "\n")
