"""Marked-up manuscripts as blocks: headings and bullets by level, tables, notes, figures; footnotes; and what is wrong with them.

A manuscript is read line by line, but nothing here walks over lines: what a line needs from those before it (an open caption,
the paragraph it goes on with, the block before a blank line) comes from windows over the lines of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import split_attrs, split_lines, trim
from tidewater.session import cut


@dataclass(frozen=True)
class Level:
    """A level of a form, from the highest: its key, the marker that is typed (none for plain text), and who writes its symbol."""

    key: str
    marker: str | None = None
    auto_bullet: bool = False
    auto_number: bool = False
    write_marker: bool = False


# The levels of the standard form, its table note, symbols of bullets and ends of sentences.
LEVELS = (
    Level("h1", "#", auto_number=True), Level("h2", "##", auto_number=True), Level("h3", "###", auto_number=True), Level("h4", "####", auto_number=True),
    Level("b1", "○", write_marker=True), Level("b2", "▪", write_marker=True), Level("b3", "-", write_marker=True), Level("b4", "·", write_marker=True),
)
NOTE = "※"
SYMBOLS = "□○-·･•▪◦∙※"
STOPS = ".。!?"
DEFINITION, REFERENCE = r"^\[\^([^\]\s]+)\]:\s*(.*)$", r"\[\^([^\]\s]+)\]"
CHAPTER, CAPTION = r"^\[장\s*[:：]\s*(.+?)\]\s*$", r"^\[표\s*[:：]\s*(.+?)\]\s*$"
COLUMNS, IMAGE = r"^\{cols\s*=\s*([\d.,\s]+)\}\s*$", r"^!\[[^\]]*\]\(([^)]+)\)\s*$"


def _marked(levels: tuple[Level, ...]) -> Column:
    """(level, body) by the longest marker that a line starts with, a space behind it; null without one."""
    out = None
    for x in sorted((x for x in levels if x.marker), key=lambda x: -len(x.marker)):
        hit = F.col("s").startswith(f"{x.marker} ")
        one = F.struct(F.lit(x.key).alias("level"), trim(F.expr(f"substring(s, {len(x.marker) + 2})")).alias("body"))
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return out


def _body(levels: tuple[Level, ...]) -> Column:
    """What a line (s, kind) says behind its marker."""
    return F.when(F.col("kind") == "note", trim(F.expr(f"substring(s, {len(NOTE) + 2})"))).when(F.col("kind") == "para", F.coalesce(_marked(levels)["body"], "s")).otherwise(F.col("s"))


def lines(texts: DataFrame, key: str, text: str, levels: tuple[Level, ...] = LEVELS) -> DataFrame:
    """(key, ln, s, kind, level, body, tab) of each line from 1: kind is blank, definition, chapter, caption, columns, image, table
    (tab numbers the runs of such lines), note, para, or plain for a line without a marker."""
    plain = next((x.key for x in levels if not x.marker), None)
    out = texts.select(key, F.posexplode(split_lines(F.coalesce(text, F.lit("")))).alias("ln", "s")).select(key, (F.col("ln") + 1).alias("ln"), trim(F.col("s")).alias("s"))
    kind = (
        F.when(F.col("s") == "", "blank").when(F.col("s").rlike(DEFINITION), "definition").when(F.col("s").rlike(CHAPTER), "chapter").when(F.col("s").rlike(CAPTION), "caption")
        .when(F.col("s").rlike(COLUMNS), "columns").when(F.col("s").rlike(IMAGE), "image").when(F.col("s").startswith("|"), "table").when(F.col("s").startswith(f"{NOTE} "), "note")
    )
    out = out.withColumn("kind", kind).withColumn("_m", F.when(F.col("kind").isNull(), _marked(levels)))
    out = out.withColumn("kind", F.coalesce("kind", F.when(F.col("_m").isNotNull() | F.lit(plain is not None), "para").otherwise("plain")))
    out = out.withColumns({"level": F.when(F.col("kind") == "para", F.coalesce("_m.level", F.lit(plain))), "body": _body(levels)}).drop("_m")
    w = W.partitionBy(key).orderBy("ln")
    starts = (F.col("kind") == "table") & ~F.coalesce(F.lag("kind").over(w) == "table", F.lit(False))
    return out.withColumn("tab", F.sum(starts.cast("int")).over(w)).withColumn("sep", (F.col("kind") == "table") & F.col("s").rlike(r"(?U)^\|[\s:|\-]+\|$"))


def blocks(texts: DataFrame, key: str, text: str, levels: tuple[Level, ...] = LEVELS) -> DataFrame:
    """(key, line, kind, level, text, rows, caption, cols, name): the blocks of a manuscript, in order of line.

    Kinds are blank (one for a run of blank lines between two blocks; none before the first, nor before a footnote's
    definition), para, table, table_note and image. A line without a marker goes on with the paragraph before it, or starts
    one of the last level. A caption goes to the next table if nothing but blank lines and figures lies between, widths of
    columns to the next table. Rows are as wide as the first. Footnotes stay in the texts; see footnotes().
    """
    return _blocks(lines(texts, key, text, levels), key, levels)


def _blocks(x: DataFrame, key: str, levels: tuple[Level, ...]) -> DataFrame:
    """blocks() of lines()."""
    w = W.partitionBy(key).orderBy("ln")
    back = W.partitionBy(key).orderBy(F.desc("ln")).rowsBetween(W.unboundedPreceding, -1)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("ln"))
    x = x.drop("body")  # it repeats the line, and every window would carry both
    full = F.max(F.when((F.col("kind") == "table") & ~F.col("sep"), F.col("ln"))).over(W.partitionBy(key, "tab", F.col("kind") == "table"))
    first = F.min("ln").over(W.partitionBy(key, "tab", F.col("kind") == "table"))
    x = x.withColumns({"_first": first, "_full": full})
    # lines that make a block: a table by its first line
    makes = F.col("kind").isin("image", "note", "para", "plain") | ((F.col("kind") == "table") & (F.col("ln") == F.col("_first")) & F.col("_full").isNotNull())
    x = x.withColumn("_makes", makes).withColumn("_event", F.when(F.col("_makes"), F.lit("block")).when(F.col("kind") == "definition", "definition"))
    x = x.withColumns({
        "_segment": F.count("_event").over(before), "_next": F.last("_event", True).over(back), "_made": F.count(F.when(F.col("_makes"), 1)).over(before),
        "_cleared": F.max(at("note", "para", "plain", "table")).over(before), "_table": F.max(at("table")).over(before),
        "_caption": F.last(F.when(F.col("kind") == "caption", F.struct("ln", trim(F.regexp_extract("s", CAPTION, 1)).alias("t"))), True).over(before),
        "_cols": F.last(F.when(F.col("kind") == "columns", F.struct("ln", _widths(F.regexp_extract("s", COLUMNS, 1)).alias("w"))), True).over(before),
    })
    rank = F.row_number().over(W.partitionBy(key, "_segment", F.col("kind") == "blank").orderBy("ln"))
    blank = (F.col("kind") == "blank") & (F.col("_made") > 0) & ~F.coalesce(F.col("_next") == "definition", F.lit(False))
    kept = x.withColumn("_rank", rank).filter(F.col("_makes") | (blank & (F.col("_rank") == 1)))
    joins = (F.col("kind") == "plain") & F.coalesce(F.lag("kind").over(w).isin("para", "plain"), F.lit(False))
    kept = kept.withColumn("_start", (~joins).cast("int")).withColumn("_block", F.sum("_start").over(w))
    own = lambda c, since: F.when(F.col(f"{c}.ln") > F.coalesce(F.col(since), F.lit(0)), F.col(c))
    kept = kept.withColumn("body", _body(levels)).withColumns({"_caption": own("_caption", "_cleared"), "_cols": own("_cols", "_table")})
    fields = F.struct("ln", "kind", "level", "body", F.col("tab"), F.col("_caption.t").alias("caption"), F.col("_cols.w").alias("cols"), "s")
    made = kept.groupBy(key, "_block").agg(F.sort_array(F.collect_list(fields)).alias("all")).withColumn("h", F.col("all")[0])
    kind = F.when(F.col("h.kind") == "plain", "para").when(F.col("h.kind") == "note", "table_note").otherwise(F.col("h.kind"))
    made = made.select(
        key, F.col("h.ln").alias("line"), kind.alias("kind"), F.when(F.col("h.kind") == "plain", F.lit(levels[-1].key)).otherwise(F.col("h.level")).alias("level"),
        F.when(kind.isin("para", "table_note"), F.array_join(F.transform("all", lambda b: b["body"]), " ")).otherwise("").alias("text"),
        F.when(kind == "table", F.col("h.tab")).alias("tab"), F.when(kind == "table", F.coalesce("h.caption", F.lit(""))).alias("caption"), F.when(kind == "table", F.col("h.cols")).alias("cols"),
        F.when(kind == "image", trim(F.regexp_extract("h.s", IMAGE, 1))).alias("name"),
    )
    rows = x.filter("kind = 'table' and not sep").select(key, "tab", "ln", F.transform(F.split(F.regexp_replace("s", r"^\|+|\|+$", ""), r"\|"), trim).alias("cells"))
    tables = rows.groupBy(key, "tab").agg(F.transform(F.sort_array(F.collect_list(F.struct("ln", "cells"))), lambda r: r["cells"]).alias("raw"))
    width = F.size(F.col("raw")[0])
    square = F.transform("raw", lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width))
    out = made.join(tables, [key, "tab"], "left").withColumn("rows", square)
    fit = F.when(F.size("cols") == width, F.col("cols"))
    return out.select(key, "line", "kind", "level", "text", "rows", "raw", "caption", F.col("cols").alias("widths"), fit.alias("cols"), "name")


def _widths(c: Column) -> Column:
    """Widths as numbers; null where one is none or all are zero."""
    all_of = F.transform(F.split(c, ","), lambda x: trim(x).try_cast("double"))
    total = F.aggregate(all_of, F.lit(0.0), lambda a, b: a + b)
    return F.when(F.forall(all_of, lambda x: x.isNotNull()) & (total > 0), all_of)


def chapters(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chapter): the last chapter that a manuscript names."""
    return lines(texts, key, text).filter("kind = 'chapter'").groupBy(key).agg(F.max_by(trim(F.regexp_extract("s", CHAPTER, 1)), "ln").alias("chapter"))


def definitions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label, note, line, times): the last definition of each footnote."""
    return _definitions(lines(texts, key, text), key)


def _definitions(x: DataFrame, key: str) -> DataFrame:
    """definitions() of lines()."""
    found = x.filter("kind = 'definition'").select(key, "ln", F.regexp_extract("s", DEFINITION, 1).alias("label"), trim(F.regexp_extract("s", DEFINITION, 2)).alias("note"))
    return found.groupBy(key, "label").agg(F.max_by("note", "ln").alias("note"), F.max("ln").alias("line"), F.count("*").alias("times"))


def footnotes(parts: DataFrame, defined: DataFrame, key: str) -> DataFrame:
    """(key, line, level, nth, label, note, offset, before, after, number, use) of each reference in the paragraphs of blocks().

    offset is the place in the text without the references that are defined; those that aren't stay in the text and have a
    null note, number and use. number counts a manuscript's footnotes, use those of one label.
    """
    paras = parts.filter("kind = 'para'").select(key, "line", "level", F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)).alias("labels"), F.split("text", REFERENCE).alias("gaps"))
    refs = paras.select(key, "line", "level", "gaps", F.posexplode("labels").alias("nth", "label")).join(defined.select(key, "label", "note"), [key, "label"], "left")
    here = W.partitionBy(key, "line").orderBy("nth")
    gap = F.element_at("gaps", F.col("nth") + 1)
    stays = F.when(F.col("note").isNull(), F.length("label") + 3).otherwise(0)
    refs = refs.withColumn("offset", (F.sum(F.length(gap)).over(here) + F.sum(stays).over(here) - stays).cast("int"))
    # what stands right before: the end of the gap, or of a reference that stays, or of the gap before
    shown = F.concat(F.when(F.lag("note").over(here).isNull() & (F.col("nth") > 0), F.lit("]")).otherwise(""), gap)
    before = F.right(F.coalesce(F.last(F.nullif(shown, F.lit("")), True).over(here), F.lit("")), F.lit(1))
    refs = refs.withColumns({"before": before, "after": F.substring(F.element_at("gaps", F.col("nth") + 2), 1, 1)})
    used = F.col("note").isNotNull()
    number = F.row_number().over(W.partitionBy(key, used).orderBy("line", "nth"))
    use = F.row_number().over(W.partitionBy(key, "label").orderBy("line", "nth"))
    return refs.select(key, "line", "level", "nth", "label", "note", "offset", "before", "after", F.when(used, number).alias("number"), F.when(used, use).alias("use"))


def issues(texts: DataFrame, key: str, text: str, levels: tuple[Level, ...] = LEVELS) -> DataFrame:
    """(key, line, issue): everything that reading and checking a manuscript finds, one row each."""
    # many rules look at the same lines, blocks and notes: each is made once
    x = cut(lines(texts, key, text, levels).drop("body"))
    parts, defined = cut(_blocks(x, key, levels)), cut(_definitions(x, key))
    notes = cut(footnotes(parts, defined, key))
    w = W.partitionBy(key).orderBy("ln")
    say = lambda df, what, line="line": df.select(key, F.col(line).alias("line"), F.lit(what).alias("issue"))
    nth = lambda c: F.row_number().over(W.partitionBy(key, c).orderBy("ln"))
    defs = x.filter("kind = 'definition'").withColumn("label", F.regexp_extract("s", DEFINITION, 1))
    cols = x.filter("kind = 'columns'").withColumn("all", F.transform(F.split(F.regexp_extract("s", COLUMNS, 1), ","), lambda v: trim(v).try_cast("double")))
    clear = F.max(F.when(F.col("kind").isin("note", "para", "plain", "table"), F.col("ln"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    caption = F.max(F.when(F.col("kind") == "caption", F.col("ln"))).over(w.rowsBetween(W.unboundedPreceding, -1))
    lost = x.withColumns({"_clear": clear, "_caption": caption}).filter("kind in ('note', 'para', 'plain') and _caption > coalesce(_clear, 0)")
    by_key = {v.key: v for v in levels}
    auto = [k for k, v in by_key.items() if v.auto_bullet]
    found = [
        say(defs.withColumn("_n", nth("label")).filter("_n > 1"), "footnote defined twice", "ln"), say(defs.filter(F.regexp_extract("s", DEFINITION, 2) == ""), "empty footnote", "ln"),
        say(x.filter("kind = 'chapter'").withColumn("_n", nth("kind")).filter("_n > 1"), "chapter named twice", "ln"),
        say(cols.filter(F.exists("all", lambda v: v.isNull())), "widths that are no numbers", "ln"), say(cols.filter(~F.exists("all", lambda v: v.isNull()) & (F.aggregate("all", F.lit(0.0), lambda a, b: a + b) <= 0)), "widths of zero", "ln"),
        say(lost, "caption without a table", "ln"), say(x.filter("kind = 'plain'"), "line without a marker", "ln"),
        say(parts.filter(F.exists("raw", lambda r: F.size(r) != F.size(F.col("raw")[0]))), "row of another width"), say(parts.filter("size(widths) <> size(raw[0])"), "widths for another number of columns"),
        say(parts.filter(F.exists(F.flatten("raw"), lambda c: c.rlike(REFERENCE))), "footnote in a table"),
        say(parts.filter(F.col("level").isin(auto) & F.lit(SYMBOLS).contains(F.substring("text", 1, 1)) & (F.col("text") != "")), "bullet that is set by itself"),
        say(notes.filter("note is null"), "footnote without a definition"), say(notes.filter("use > 1"), "footnote used again"),
        say(defined.join(notes.select(key, "label"), [key, "label"], "left_anti"), "footnote never used"),
    ]
    # a definition's label isn't a line of text that can be called twice; what follows looks at neighbouring blocks
    o = W.partitionBy(key).orderBy("line")
    near = parts.withColumns({"_b": F.coalesce(F.lag("kind").over(o), F.lit("blank")), "_a": F.coalesce(F.lead("kind").over(o), F.lit("blank")), "_p": F.last(F.when(F.col("kind") != "blank", F.col("kind")), True).over(o.rowsBetween(W.unboundedPreceding, -1))})
    found += [
        say(near.filter("kind = 'table_note' and not _p <=> 'table'"), "table note without a table"), say(near.filter("kind = 'table' and _b <> 'blank'"), "no blank line before a table"),
        say(near.filter("kind = 'table' and _a not in ('blank', 'table_note')"), "no blank line after a table"), say(parts.filter("kind = 'para' and trim(text) = ''"), "empty paragraph"),
    ]
    # plain levels, and those whose symbol nobody writes, have no place in the order of levels
    depth = F.create_map(*[F.lit(v) for i, (k, l) in enumerate(by_key.items()) if l.marker and (l.auto_bullet or l.auto_number or l.write_marker) for v in (k, i)])
    paras = parts.filter("kind = 'para'").withColumn("_d", F.element_at(depth, F.col("level"))).withColumn("_l", F.lag("_d").over(o))
    found.append(say(paras.filter("_d - _l > 1"), "level passed over"))
    heads = [k for k, v in by_key.items() if (v.marker or "").startswith("#") or v.auto_number]
    real = notes.filter("note is not null")
    found += [
        say(real.filter(F.col("level").isin(heads)), "footnote in a heading"), say(real.filter("before = ''"), "footnote at the start"), say(real.filter(F.col("before").rlike(r"(?U)^\s+$")), "space before a footnote"),
        say(real.filter((F.col("before") != "") & F.lit(STOPS).contains(F.col("before"))), "footnote after a full stop"), say(real.filter("label rlike '^[0-9]+$' and cast(label as int) <> number"), "footnote out of order"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def style_issues(parts: DataFrame, key: str, levels: tuple[Level, ...] = LEVELS, periods: str = "single", least: dict[str, int] | None = None) -> DataFrame:
    """(key, line, issue) of the paragraphs of blocks() against a house style.

    periods: single (one sentence has no full stop, several end with one), always, never or off; headings with automatic numbers are
    free. least is how many paragraphs of the next level a level must have below it. A marker amid the text is stray.
    """
    paras = parts.filter("kind = 'para'").withColumn("t", trim(F.col("text")))
    order = {v.key: i for i, v in enumerate(levels)}
    auto = [v.key for v in levels if v.auto_number or v.auto_bullet]
    found = []
    marks = sorted({v.marker for v in levels if v.marker} - {"-", "#"})
    stray = "|".join(f"\\Q{m}\\E" for m in marks)
    found.append(paras.filter(F.col("text").rlike(rf"(^|\s)({stray})(?=\s)")).select(key, "line", F.lit("marker in the text").alias("issue")))
    sentences, ends = F.size(F.filter(F.split("t", r"(?<=[.!?])\s+"), lambda x: x != "")), F.col("t").endswith(".")
    rule = {
        "single": F.when((sentences == 1) & ends, "full stop after one sentence").when((sentences > 1) & ~ends, "no full stop after several sentences"), "always": F.when(~ends, "no full stop"),
        "never": F.when(ends, "full stop"), "off": F.lit(None).cast("string"),
    }[periods]
    found.append(paras.filter((F.col("t") != "") & ~F.col("level").isin(auto)).select(key, "line", rule.alias("issue")).filter("issue is not null"))
    at = F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("level"))
    # the next paragraph that isn't deeper ends what is below; counts of all levels are carried to it
    deep = paras.withColumn("d", at).filter("d is not null")
    back = W.partitionBy(key).orderBy(F.desc("line")).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    seen = deep.withColumn("_seen", F.array(*[F.count(F.when(F.col("d") == k, 1)).over(back) for k in range(len(levels) + 1)]))
    ends_at = F.array(*[F.last(F.when(F.col("d") <= k, F.col("_seen")), True).over(after) for k in range(len(levels))])
    seen = seen.withColumn("_end", F.element_at(ends_at, F.col("d") + 1))
    below = F.element_at("_seen", F.col("d") + 2) - F.coalesce(F.element_at("_end", F.col("d") + 2), F.lit(0))
    for name, n in (least or {}).items():
        found.append(seen.filter((F.col("level") == name) & (below < n)).select(key, "line", F.lit("too little below").alias("issue")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def tally(found: DataFrame, key: str, by: str = "issue") -> DataFrame:
    """(key, by, n): how often each is found."""
    return found.groupBy(key, by).agg(F.count("*").alias("n"))


def indent_tree(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ln, parent, depth, text, attrs): an indented list as a tree; a line's parent is the last line before it with a smaller indent.

    A tab is two spaces; lines without text are passed over; `{key=value}` at the end is an item's style. Lines come in
    order, and only the open parents are carried from one to the next.
    """
    raw = texts.select(key, F.posexplode(split_lines(F.coalesce(text, F.lit("")))).alias("ln", "line")).withColumn("line", F.regexp_replace("line", "\t", "  "))
    item = split_attrs(F.regexp_replace(trim(F.col("line")), r"^[-*•]\s+", ""))
    rows = raw.withColumns({"indent": F.length("line") - F.length(F.regexp_replace("line", "^ +", "")), "x": item}).filter("x.text <> ''").select(key, "ln", "indent", "x.text", "x.attrs")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open = None, []
        for b in batches:
            parents, depths = [], []
            for k, ln, indent in zip(b[key].tolist(), b["ln"].tolist(), b["indent"].tolist()):
                if k != now:
                    now, open = k, []
                while open and open[-1][0] >= indent:
                    open.pop()
                parents.append(open[-1][1] if open else None)
                depths.append(len(open))
                open.append((indent, ln))
            yield pd.DataFrame({key: b[key], "ln": b["ln"], "parent": pd.array(parents, "Int32"), "depth": depths})

    kind = rows.schema[key].dataType.simpleString()
    placed = rows.select(key, "ln", "indent").repartition(key).sortWithinPartitions(key, "ln").mapInPandas(walk, f"{key} {kind}, ln int, parent int, depth int")
    return rows.join(placed, [key, "ln"]).select(key, "ln", "parent", "depth", "text", "attrs")
