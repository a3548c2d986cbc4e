"""Levels of a form that nobody has described: what paragraphs of one shape begin with, and a marker for each shape.

Paragraphs are grouped by text, style, paragraph and character shape. The commonest beginning of a group counts where half of
its paragraphs have one. Groups are then folded in order, from the outermost and largest down, each taking the first marker
that its evidence asks for and nobody has; a text has as many groups as its form has shapes, so the fold is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import ALIASES, MARKERS

# Markers of headings, markers that groups without evidence get, keys of markers, names of notes below tables.
HEADINGS = ("#", "##", "###", "####")
FALLBACK = "□○-·※▪◇▶"
KEYS = {"□": "box", "○": "circle", "-": "hyphen", "·": "dot", "･": "dot", "•": "dot", "▪": "dot", "◦": "dot", "∙": "dot", "※": "note", "◇": "diamond", "◆": "diamond", "▶": "arrow"}
NOTE_NAMES = ("표 주", "표주", "자료", "출처", "주석", "표 자료")
# White space, and kinds of numbers that a paragraph may begin with, the first that fits.
BLANKS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{BLANKS}]"
PREFIXES = (
    ("AUTO_CHAPTER", rf"^제{SPACE}?\d{{1,2}}{SPACE}?장{SPACE}"), ("AUTO_SECTION", rf"^제{SPACE}?\d{{1,2}}{SPACE}?절{SPACE}"), ("AUTO_ROMAN", rf"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+[.)]{SPACE}"), ("AUTO_NUM", rf"^\d{{1,2}}\.{SPACE}"),
    ("AUTO_PAREN", rf"^\d{{1,2}}\){SPACE}"), ("AUTO_ALPHA", rf"^[A-Z][.)]{SPACE}"), ("AUTO_CIRCLED", "^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮]"), ("AUTO_HANGUL", rf"^[가나다라마바사아자차카타파하][.)]{SPACE}"),
)
SIGN = rf"^([^\w{BLANKS}]{{1,2}}){SPACE}"


def prefix(text: Column) -> Column:
    """The kind of number that a text begins with, else one or two signs before a blank, else null."""
    out = None
    for name, pattern in PREFIXES:
        hit = text.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(text.rlike(SIGN), F.regexp_extract(text, SIGN, 1))


def lead(text: Column) -> Column:
    """A bullet with a blank behind it at a text's beginning, else null."""
    first = F.substring(text, 1, 1)
    return F.when(F.lit(MARKERS).contains(first) & (first != "") & F.substring(text, 2, 1).isin(" ", "　"), first)


def normalized(c: Column) -> Column:
    """A bullet's marker; empty for what is none."""
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    one = F.coalesce(F.try_element_at(known, c), c)
    return F.when((F.length(one) == 1) & F.lit(MARKERS).contains(one), one).otherwise("")


def commonest(paras: DataFrame, by: list[str], value: Column, order: str) -> DataFrame:
    """(by, value, n): the commonest value of each group and how many have any; of equally common ones the first in order."""
    each = paras.select(*by, order, value.alias("value")).filter("value is not null").groupBy(*by, "value").agg(F.count("*").alias("k"), F.min(order).alias("first"))
    return each.groupBy(*by).agg(F.max_by("value", F.struct("k", -F.col("first"))).alias("value"), F.sum("k").alias("n"))


def groups(paras: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(key, style, para, char, seen, prefix, symbol, name, size, left, bullet, number, after, place, samples) of paragraphs
    (key, ln, style, para, char, text, in_table, after_table), with shapes (key, style, para, char, name, size, left, bullet, number).

    Paragraphs of tables and empty ones don't count. place numbers a text's groups by left margin, size from the largest, and
    first paragraph.
    """
    by = [key, "style", "para", "char"]
    some = paras.filter(~F.col("in_table") & (F.col("text") != ""))
    first3 = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ln", "text"))), 1, 3), lambda x: x["text"])
    few = some.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("ln"))).filter("_r <= 3").groupBy(*by).agg(first3.alias("samples"))
    every = some.groupBy(*by).agg(F.count("*").alias("seen"), F.min("ln").alias("first"), F.count(F.when(F.col("after_table"), 1)).alias("after"))
    half = F.greatest(F.lit(1), F.floor(F.col("seen") / 2))
    for name, value in (("symbol", lead(F.col("text"))), ("prefix", prefix(F.col("text")))):
        most = commonest(some, by, value, "ln").withColumnsRenamed({"value": f"_{name}", "n": f"_n_{name}"})
        every = every.join(most, by, "left").withColumn(name, F.when(F.col(f"_n_{name}") >= half, F.col(f"_{name}"))).drop(f"_{name}", f"_n_{name}")
    out = every.join(few, by).join(shapes, by, "left").withColumns({"size": F.coalesce("size", F.lit(12.0)), "left": F.coalesce("left", F.lit(0.0)), "name": F.coalesce("name", F.concat(F.lit("스타일"), F.col("style").cast("string")))})
    return out.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("left", F.desc("size"), "first")) - 1).drop("first")


def assigned(found: DataFrame, key: str) -> DataFrame:
    """groups() with marker, clash (its own marker was taken), invented (one was given without evidence) and level (the marker's key).

    A shape's bullet comes before numbers, those before the symbol in its texts. Headings take # to #### in order. Each marker
    goes to the first group that asks for it; the others and those without evidence take what is left of FALLBACK.
    """
    heading = F.col("number").isNotNull() | F.coalesce(F.col("prefix").startswith("AUTO_"), F.lit(False))
    own = normalized(F.coalesce("bullet", F.lit("")))
    wish = F.when(own != "", own).when(heading, "#").otherwise(F.coalesce("symbol", F.lit("")))
    listed = found.withColumn("wish", wish).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "wish"))).alias("all"))
    # what each asks for; the first to ask for a marker has it
    nth_heading = lambda i: F.size(F.filter(F.slice("all", F.lit(1), i + 1), lambda y: y["wish"] == "#"))
    asks = lambda x, i: F.when(x["wish"] == "#", F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), F.least(nth_heading(i), F.lit(len(HEADINGS))))).otherwise(x["wish"])
    asked = listed.withColumn("_o", F.transform("all", asks))
    got = F.transform("_o", lambda m, i: F.when((m != "") & (F.array_position(F.col("_o"), m) == i + 1), m).otherwise(""))
    asked = asked.withColumns({"_got": got, "_left": F.array_except(F.array(*[F.lit(c) for c in FALLBACK]), F.col("_o"))})
    # the nth group without a marker takes the nth that is left
    rank = lambda i: F.size(F.filter(F.slice("_got", F.lit(1), i + 1), lambda m: m == ""))
    final = F.transform("_got", lambda m, i: F.struct((i + F.lit(0)).alias("place"), (m == "").alias("_empty"), ((m == "") & (F.col("_o")[i] != "")).alias("clash"), F.when(m != "", m).otherwise(F.coalesce(F.try_element_at(F.col("_left"), F.greatest(rank(i), F.lit(1))), F.lit(""))).alias("marker")))
    each = asked.select(key, F.explode(final).alias("f")).select(key, "f.place", "f.clash", "f.marker", (F.col("f._empty") & (F.col("f.marker") != "")).alias("invented"))
    known = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])
    base = F.coalesce(F.try_element_at(known, F.col("marker")), F.when(F.col("marker").rlike("^#+$"), F.concat(F.lit("h"), F.length("marker"))), F.concat(F.lit("level"), F.col("place").cast("string")))
    nth = F.row_number().over(W.partitionBy(key, "_b").orderBy("place"))
    out = found.join(each, [key, "place"]).withColumn("_b", base)
    return out.withColumn("level", F.concat("_b", F.when(nth > 1, nth.cast("string")).otherwise(""))).drop("_b")


def table_note(found: DataFrame, key: str) -> DataFrame:
    """(key, place, by_name): the group of assigned() that writes below tables: its name says so, or all of its two or more
    paragraphs follow a table; of several the one with most such paragraphs, then the first. Headings are none."""
    heading = F.col("marker").isin(*HEADINGS) | F.col("number").isNotNull() | F.coalesce(F.col("prefix").startswith("AUTO_"), F.lit(False))
    by_name = F.lit(False)
    for n in NOTE_NAMES:
        by_name = by_name | F.col("name").contains(n)
    some = found.filter(~heading).withColumn("_n", by_name).filter(F.col("_n") | ((F.col("seen") >= 2) & (F.col("after") == F.col("seen"))))
    return some.groupBy(key).agg(F.max_by(F.struct("place", "_n"), F.struct("after", -F.col("place"))).alias("x")).select(key, "x.place", F.col("x._n").alias("by_name"))
