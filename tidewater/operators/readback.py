"""A document without a known form read back as marked text: depths from what paragraphs begin with and how large they are.

The depths are those of the kinds that a document really has: kinds of numbers first, then bullets, then sizes. What a
paragraph begins with is cut off, places of notes move along, and the notes go back into the text as numbered references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .levels import SPACE

# Bullets from the outermost in, and kinds of numbers from the highest down.
LADDER = ("□", "■", "○", "●", "-", "–", "·", "･", "•", "※")
NUMBERS = (
    ("ROMAN", rf"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+{SPACE}*[.)]{SPACE}+"), ("DIGIT_DOT", rf"^\d{{1,2}}\.{SPACE}+"), ("HANGUL", rf"^[가-힣]\.{SPACE}+"), ("DIGIT_PAREN", rf"^\d{{1,2}}\){SPACE}+"),
    ("CIRCLED", rf"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮]{SPACE}*"),
)
PICTURE = "[그림 자리 — 도식이면 :::diagram 블록으로 옮길 것]"
STRIP = rf"^{SPACE}+|{SPACE}+$"


def cut(blocks: DataFrame) -> DataFrame:
    """Blocks (.., kind, text, notes array<struct<at,note>>, ..) with symbol and number of paragraphs, which are cut off the text;
    notes move by what was cut, to the beginning at most."""
    first, second = F.substring("text", 1, 1), F.substring("text", 2, 1)
    para = F.col("kind") == "para"
    symbol = F.when(para & first.isin(*LADDER) & second.isin(" ", "　"), first)
    number = size = None
    for name, pattern in NUMBERS:
        hit = F.col("text").rlike(pattern)
        number = F.when(hit, name) if number is None else number.when(hit, name)
        length = F.length(F.regexp_extract("text", pattern, 0))
        size = F.when(hit, length) if size is None else size.when(hit, length)
    out = blocks.withColumn("symbol", symbol).withColumn("number", F.when(para & F.col("symbol").isNull(), number))
    gone = F.when(F.col("symbol").isNotNull(), 2).when(F.col("number").isNotNull(), size)
    rest = F.substring(F.col("text"), gone + 1, F.length("text"))
    out = out.withColumn("_rest", F.when(gone.isNotNull(), rest)).withColumn("_cut", F.length("text") - F.length(F.regexp_replace("_rest", rf"^{SPACE}+", "")))
    # one after the other: a lambda beside a new `text` would see the new one
    moved = F.transform("notes", lambda n: F.struct(F.greatest(n["at"] - F.col("_cut"), F.lit(0)).cast("int").alias("at"), n["note"].alias("note")))
    out = out.withColumn("notes", F.when(F.col("_rest").isNull(), F.col("notes")).otherwise(moved))
    return out.withColumn("text", F.coalesce(F.regexp_replace("_rest", STRIP, ""), "text")).drop("_rest", "_cut")


def depths(blocks: DataFrame, key: str) -> DataFrame:
    """cut() blocks with the depth of paragraphs, from 0: kinds of numbers that the document has, then its bullets, then its sizes."""
    has = blocks.filter("kind = 'para'").groupBy(key).agg(F.collect_set("number").alias("_n"), F.collect_set("symbol").alias("_s"), F.sort_array(F.collect_set("size"), asc=False).alias("_z"))
    ordered = lambda names, c: F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(c, n))
    has = has.withColumns({"_n": ordered([n for n, _ in NUMBERS], F.col("_n")), "_s": ordered(LADDER, F.col("_s"))})
    at = lambda a, v: F.array_position(a, v) - 1
    depth = F.when(F.col("number").isNotNull(), at(F.col("_n"), F.col("number"))).when(F.col("symbol").isNotNull(), F.size("_n") + at(F.col("_s"), F.col("symbol"))).otherwise(F.size("_n") + F.size("_s") + at(F.col("_z"), F.col("size")))
    return blocks.join(has, key, "left").withColumn("depth", F.when(F.col("kind") == "para", depth).cast("int")).drop("_n", "_s", "_z")


def _marked(rank: Column, markers: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in markers]), F.least(rank, F.lit(len(markers)))) if markers else F.lit("")


def _spliced(text: Column, notes: Column) -> Column:
    """The text with [^number] at each place; of those at one place the later number comes first."""
    ordered = F.array_sort(notes, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(b["number"] - a["number"]))
    cut_at = lambda n: F.least(F.greatest(n["at"], F.lit(0)), F.length(text))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, n: F.struct(cut_at(n).alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, cut_at(n) - a["at"]), F.lit("[^"), n["number"].cast("string"), F.lit("]")).alias("out"))
    return F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def numbered(blocks: DataFrame, key: str) -> DataFrame:
    """Blocks whose notes have their number in the document: by block, then by place."""
    notes = blocks.select(key, "ln", F.posexplode("notes").alias("i", "n")).withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("ln", "n.at", "i")))
    each = notes.groupBy(key, "ln").agg(F.collect_list(F.struct("n.at", "number", "n.note")).alias("_all"))
    none = F.array().cast("array<struct<at:int,number:int,note:string>>")
    return blocks.join(each, [key, "ln"], "left").withColumn("notes", F.coalesce("_all", none)).drop("_all")


def lines(blocks: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """(key, ln, lines, last): the lines of each of depths() blocks (kind para, table with rows, or picture), its references in place."""
    rank = F.dense_rank().over(W.partitionBy(key, F.col("kind") == "para").orderBy("depth"))
    some = numbered(blocks, key).withColumn("_m", _marked(rank, markers))
    said = _spliced(F.col("text"), F.col("notes"))
    para = F.when(F.col("_m") != "", F.regexp_replace(F.concat("_m", F.lit(" "), said), STRIP, "")).otherwise(said)
    wide = F.array_max(F.transform("rows", F.size))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), wide))
    table = F.concat(F.array(row(F.col("rows")[0]), rule), F.transform(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), row), F.array(F.lit("")))
    own = F.when(F.col("kind") == "table", table).when(F.col("kind") == "picture", F.array(F.lit(PICTURE))).otherwise(F.array(para))
    some = some.select(key, "ln", "kind", own.alias("lines"), "notes").withColumn("last", F.element_at("lines", -1))
    before = F.lag("last").over(W.partitionBy(key).orderBy("ln"))
    blank = (F.col("kind") != "para") & (before != "")
    return some.withColumn("lines", F.when(blank, F.concat(F.array(F.lit("")), "lines")).otherwise(F.col("lines"))).drop("last")


def marked(blocks: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """(key, text): the whole marked text of each document, with the notes' definitions at its end."""
    some = lines(blocks, key, markers)
    each = some.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ln", "lines", "notes"))).alias("all"))
    body = F.flatten(F.transform("all", lambda x: x["lines"]))
    notes = F.sort_array(F.transform(F.flatten(F.transform("all", lambda x: x["notes"])), lambda n: F.struct(n["number"], n["note"])))
    told = F.transform(notes, lambda n: F.concat(F.lit("[^"), n["number"].cast("string"), F.lit("]: "), n["note"]))
    both = F.when(F.size(told) > 0, F.concat(body, F.array(F.lit("")), told)).otherwise(body)
    return each.select(key, F.concat(F.regexp_replace(F.array_join(both, "\n"), rf"{SPACE}+$", ""), F.lit("\n")).alias("text"))


def evidence(blocks: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """(key, step, reason, value, n, marker): why each depth of depths() blocks is one: its first paragraph's number, bullet or size."""
    paras = blocks.filter("kind = 'para'").groupBy(key, "depth").agg(F.min_by(F.struct("number", "symbol", "size"), "ln").alias("x"), F.count("*").alias("n"))
    step = F.row_number().over(W.partitionBy(key).orderBy("depth"))
    reason = F.when(F.col("x.number").isNotNull(), "number").when(F.col("x.symbol").isNotNull(), "symbol").otherwise("size")
    value = F.coalesce("x.number", "x.symbol", F.format_string("%.1f", F.col("x.size").cast("double")))
    return paras.withColumn("step", step).select(key, "step", reason.alias("reason"), value.alias("value"), "n", _marked(F.col("step"), markers).alias("marker"))
