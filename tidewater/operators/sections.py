"""A guide's paragraphs and tables as a catalog of sections: numbered headings, ids, forms, instructions and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import heading

from .outline import find_limits
from .tree import distinct_ids, distinct_titles, fill_ratio, howto, table_kinds

# Depth of headings by style, markers of styles, marks of instructions, examples and fixed sections.
DEPTHS = {1: 1, 2: 2, 10: 3}
CHAPTER_STYLE, CHAPTER = 40, r"^제(\d+)절$"
MARKERS = {3: "◆", 4: "○", 5: "-", 6: "·", 56: "▶", 16: "◎", 17: "※"}
HOWTO, EXAMPLE, FIXED = "◆ 작성 취지 및 방법 ◆", "작성양식 및 예시", r"수정\s*불가"


def headed(paras: DataFrame, key: str) -> DataFrame:
    """Paragraphs (key, ln, style, text, grid, banner) with sec, the line of the heading that they are under, and depth, no and title of headings.

    A heading needs both the style and the number of its depth; banner is (no, title) of a chapter's banner or null. What comes before the first heading has no section.
    """
    depth = F.element_at(F.create_map(*[F.lit(v) for p in DEPTHS.items() for v in p]), F.col("style"))
    said = F.coalesce(*[F.when(depth == d, heading(F.col("text"), d)) for d in DEPTHS.values()])
    chapter = F.when(F.col("banner.no").rlike(CHAPTER), F.col("banner"))
    h = F.when(chapter.isNotNull(), F.struct(F.lit(0).alias("depth"), chapter["no"].alias("no"), chapter["title"].alias("title"))).when(said.isNotNull(), F.struct(depth.alias("depth"), said["no"].alias("no"), said["title"].alias("title")))
    out = paras.withColumn("h", h)
    return out.withColumn("sec", F.max(F.when(F.col("h").isNotNull(), F.col("ln"))).over(W.partitionBy(key).orderBy("ln")))


def nodes(found: DataFrame, key: str) -> DataFrame:
    """(key, ord, id, depth, no, title, parent, sec) of the headings of headed().

    A section's parent is the last heading one level up, unless one of a higher level came between: then it has none. Its id is the
    parent's and its number; chapters are numbered 01, 02 ... Ids and titles that occur again get a number.
    """
    w = W.partitionBy(key).orderBy("ln")
    heads = found.filter("h is not null").select(key, "ln", F.col("h.depth").alias("depth"), F.col("h.no").alias("no"), F.col("h.title").alias("title"))
    number = F.sum((F.col("depth") == 0).cast("int")).over(w)
    part = F.when(F.col("depth") == 0, F.lpad(number.cast("string"), 2, "0")).otherwise(F.coalesce(F.nullif(F.trim(F.regexp_replace("no", r'[/\\:*?"<>|]', "_")), F.lit("")), F.lit("x")))
    heads = heads.withColumn("part", part)
    # the last heading one level up, if nothing higher came after it
    w = w.rowsBetween(W.unboundedPreceding, -1)
    last = [F.coalesce(F.max(F.when(F.col("depth") == d, F.col("ln"))).over(w), F.lit(-1)) for d in range(3)]
    heads = heads.withColumns({f"_l{d}": v for d, v in enumerate(last)})
    up = F.coalesce(*[F.when((F.col("depth") == d + 1) & (F.col(f"_l{d}") >= F.greatest(F.lit(0), F.lit(0), *[F.col(f"_l{k}") for k in range(d)])), F.col(f"_l{d}")) for d in range(3)])
    heads = heads.select(key, F.col("ln").alias("sec"), "depth", "no", "title", "part", up.alias("_up"))
    # ids level by level, as a section's id begins with its parent's
    known = None
    for d in range(4):
        level = heads.filter(F.col("depth") == d)
        level = level.withColumn("parent", F.lit(None).cast("string")) if known is None else level.join(known.select(key, F.col("sec").alias("_up"), F.col("id").alias("parent")), [key, "_up"], "left")
        level = distinct_ids(level.withColumn("base", F.concat_ws("-", "parent", "part")), [key], "base", ["sec"], "id").select(key, "sec", "depth", "no", "title", "parent", "id")
        known = level if known is None else known.unionByName(level)
    order = F.row_number().over(W.partitionBy(key).orderBy("sec")) - 1
    return distinct_titles(known, [key], "title", ["sec"]).withColumn("ord", order).select(key, "ord", "id", "depth", "no", "title", "parent", "sec")


def forms(found: DataFrame, key: str) -> DataFrame:
    """(key, sec, idx, seq, kind, rows, cols, header, filled, howto) of the tables under the headings; seq counts all tables of a text."""
    seq = F.count(F.col("grid")).over(W.partitionBy(key).orderBy("ln"))
    opened = F.coalesce(F.max(F.when(F.col("text").contains(EXAMPLE), F.col("ln"))).over(W.partitionBy(key, "sec").orderBy("ln")), F.lit(-1))
    tables = found.withColumn("seq", seq).withColumn("_mark", opened).filter("grid is not null and sec is not null")
    before = F.coalesce(F.lag("ln").over(W.partitionBy(key, "sec").orderBy("ln")), F.lit(-1))
    tables = tables.withColumn("opened", F.col("_mark") > before).withColumns({"rows": F.size("grid"), "cols": F.coalesce(F.array_max(F.transform("grid", lambda r: F.size(r))), F.lit(0))})
    kinds = table_kinds(tables.withColumn("_k", F.struct(key, "sec")), "_k", "ln", HOWTO, EXAMPLE)
    idx = F.row_number().over(W.partitionBy(key, "sec").orderBy("ln")) - 1
    said = F.when(F.col("kind") == "howto", howto(F.array_join(F.filter(F.flatten("grid"), lambda c: F.trim(c) != ""), "\n"), HOWTO))
    return kinds.withColumns({"idx": idx, "header": F.coalesce(F.try_element_at("grid", F.lit(1)), F.array().cast("array<string>")), "filled": fill_ratio(F.col("grid")), "howto": said}).select(key, "sec", "idx", "seq", "kind", "rows", "cols", "header", "filled", "howto")


def catalog(paras: DataFrame, key: str) -> DataFrame:
    """nodes() with forms (their number), required (the blank ones), has (instructions), purpose, method, fixed, markers and limits, each of a section's own text."""
    found = headed(paras, key)
    known, tables = nodes(found, key), forms(found, key)
    per = tables.groupBy(key, "sec").agg(F.count("*").alias("forms"), F.count(F.when(F.col("kind") == "blank", 1)).alias("required"), F.max((F.col("kind") == "howto").cast("int")).alias("has"), F.min_by("howto", F.when(F.col("kind") == "howto", F.col("idx"))).alias("howto"))
    marker = F.element_at(F.create_map(*[F.lit(v) for p in MARKERS.items() for v in p]), F.col("style"))
    boxes = F.array_join(F.filter(F.flatten("grid"), lambda c: F.trim(c) != ""), "\n")
    inside = found.filter("sec is not null and h is null").withColumn("said", F.when(F.col("grid").isNotNull() & boxes.contains(HOWTO), F.concat_ws("\n", F.nullif("text", F.lit("")), boxes)).otherwise(F.col("text")))
    body = inside.filter("said <> ''").groupBy(key, "sec").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ln", "said"))), lambda x: x["said"]), "\n").alias("body"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when((F.col("text") != "") & marker.isNotNull(), F.struct("ln", marker.alias("m"))))), lambda x: x["m"])).alias("markers"))
    limits = find_limits(body.select(F.struct(key, "sec").alias("_k"), "body"), "_k", "body").groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "text", "scope", "op", "n", "unit"))), lambda x: x.dropFields("i")).alias("limits"))
    limits = limits.select(F.col(f"_k.{key}").alias(key), F.col("_k.sec").alias("sec"), "limits")
    out = known.join(per, [key, "sec"], "left").join(body, [key, "sec"], "left").join(limits, [key, "sec"], "left")
    return out.select(key, "ord", "id", "depth", "no", "title", "parent", F.coalesce("forms", F.lit(0)).alias("forms"), F.coalesce("required", F.lit(0)).alias("required"), (F.coalesce("has", F.lit(0)) > 0).alias("has"), "howto.purpose", "howto.method", F.coalesce(F.col("body").rlike(FIXED), F.lit(False)).alias("fixed"), F.coalesce("markers", F.array().cast("array<string>")).alias("markers"), "limits")
