"""Marked-up texts by line: outline, tables, counts under a heading, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import bare, item_text, line_kind, line_level, pipe_cells, trim

# What a limit counts, and the words of one.
SCOPES = ("추진전략", "사회보장 전략", "균형발전 전략", "중점추진사업", "세부사업", "대표과업", "세부과업", "성과지표", "주요 계획", "전략과제", "핵심과제", "전략")
LIMIT = r"(\d+)\s*(개|건|명)\s*(이내|이상|이하)"
LOOK_BACK, LEVELS = 40, 8


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ln, kind, level, text) for each line from 0."""
    out = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")).alias("ln", "text"))
    return out.select(key, "ln", line_kind(F.col("text")).alias("kind"), line_level(F.col("text")).alias("level"), "text")


def islands(marked: DataFrame, key: str, order: str, inside) -> DataFrame:
    """(key, island, first, last, n): runs of rows for which `inside` holds, in order."""
    w = W.partitionBy(key).orderBy(order)
    flagged = marked.withColumn("_in", inside)
    start = F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    runs = flagged.withColumn("island", F.sum(start.cast("int")).over(w)).filter("_in")
    return runs.groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def table_rows(texts: DataFrame, key: str, text: str, ends) -> DataFrame:
    """(key, tab, ln, cells): rows of bar tables, without separators. A line for which `ends` holds ends a table; others, as blank
    ones, don't: both uses of this count blank lines as part of a table."""
    out = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")).alias("ln", "line")).withColumn("line", trim(F.col("line")))
    row = F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") > 2)
    body = F.expr("substring(line, 2, length(line) - 2)")
    out = out.withColumn("_row", row).withColumn("_sep", F.col("_row") & body.rlike(r"(?U)^[\s:|-]+$"))
    out = out.withColumn("tab", F.sum(F.when(~F.col("_row") & ends(F.col("line")), 1).otherwise(0)).over(W.partitionBy(key).orderBy("ln")))
    return out.filter("_row and not _sep").select(key, "tab", "ln", pipe_cells(F.col("line")).alias("cells"))


def bar_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tab, ln, cells): rows of the bar tables of a text, all of a table as wide as its widest and none of blank cells only."""
    rows = table_rows(texts, key, text, lambda x: x != "").filter(F.exists("cells", lambda x: x != ""))
    width = F.max(F.size("cells")).over(W.partitionBy(key, "tab"))
    return rows.withColumn("_w", width).select(key, "tab", "ln", F.concat("cells", F.array_repeat(F.lit(""), F.col("_w") - F.size("cells"))).alias("cells"))


def table_shapes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, header, cols, n): each bar table's first row, most columns and number of rows, from 1 in order."""
    rows = table_rows(texts, key, text, lambda x: x != "")
    shapes = rows.groupBy(key, "tab").agg(F.min_by("cells", "ln").alias("header"), F.max(F.size("cells")).alias("cols"), F.count("*").cast("int").alias("n"))
    return shapes.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy("tab"))).select(key, "nth", "header", "cols", "n")


def form_issues(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, nth, level, issue): where the tables found differ from the required ones of the same place.

    Both have (key, nth, header, cols). Fewer tables than required, another number of columns, and header cells that no
    cell found holds or is part of (white space aside).
    """
    pairs = required.select(key, "nth", F.col("header").alias("want"), F.col("cols").alias("wc")).join(found.select(key, "nth", F.col("header").alias("have"), F.col("cols").alias("hc")), [key, "nth"], "left")
    flat = lambda c: F.filter(F.transform(c, lambda x: bare(F.coalesce(x, F.lit("")))), lambda x: x != "")
    have = F.transform("have", lambda x: bare(x))
    gone = F.filter(flat("want"), lambda w: ~F.exists(have, lambda h: h.contains(w) | w.contains(h)))
    few = pairs.groupBy(key).agg(F.count("*").alias("w"), F.count("hc").alias("h")).filter("h < w").select(key, F.lit(0).alias("nth"), F.lit("err").alias("level"), F.format_string("%d of %d tables", "h", "w").alias("issue"))
    wide = pairs.filter("hc <> wc").select(key, "nth", F.lit("err").alias("level"), F.format_string("%d columns instead of %d", "hc", "wc").alias("issue"))
    miss = pairs.filter("hc is not null").withColumn("gone", gone).filter(F.size("gone") > 0).select(key, "nth", F.lit("warn").alias("level"), F.concat(F.lit("missing: "), F.array_join("gone", ", ")).alias("issue"))
    return few.union(wide).union(miss)


def level_jumps(marked: DataFrame, key: str, order: str, level: str = "level") -> DataFrame:
    """Items more than one level below the item before."""
    before = F.lag(level).over(W.partitionBy(key).orderBy(order))
    return marked.filter(F.col(level).isNotNull()).withColumn("before", before).filter(F.col(level) > F.col("before") + 1)


def numbered(marked: DataFrame, key: str, order: str, level: str = "level") -> DataFrame:
    """Items with no: their number within their level, which starts anew below each item of a higher level."""
    w = W.partitionBy(key).orderBy(order)
    items = marked.filter(F.col(level).isNotNull())
    # the last line with a higher level opens the group
    above = F.greatest(F.lit(-1), *[F.when(F.col(level) > k, F.coalesce(F.max(F.when(F.col(level) <= k, F.col(order))).over(w), F.lit(-1))).otherwise(-1) for k in range(1, LEVELS)])
    return items.withColumn("_above", above).withColumn("no", F.row_number().over(W.partitionBy(key, level, "_above").orderBy(order))).drop("_above")


def few_children(marked: DataFrame, key: str, order: str, least: int, level: str = "level") -> DataFrame:
    """(key, order, level, n): items with fewer than `least` children one level below, up to the next item that isn't deeper."""
    items = marked.filter(F.col(level).isNotNull())
    back = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    seen = F.array(*[F.count(F.when(F.col(level) == k, 1)).over(back) for k in range(1, LEVELS + 2)])
    counted = items.withColumn("_seen", seen)
    ends = F.array(*[F.last(F.when(F.col(level) <= k, F.col("_seen")), True).over(after) for k in range(1, LEVELS + 1)])
    counted = counted.withColumn("_end", F.element_at(ends, F.col(level)))
    child = F.col(level) + 1
    n = F.element_at("_seen", child) - F.coalesce(F.element_at("_end", child), F.lit(0))
    return counted.select(key, order, level, n.cast("int").alias("n")).filter(F.col("n") < least)


def count_under(marked: DataFrame, key: str, order: str = "ln") -> DataFrame:
    """(key, order, n): for each item the number of its children.

    Children are the items of the first level met below the item, up to the next item that isn't deeper. Where
    there are none, the rows of the table below count, without its header. Windows from the last line up carry
    the counts so far and those at the next line of each kind, so the work grows with the lines, not with their square.
    """
    back = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    item, table = F.col("kind") == "item", F.col("kind") == "table"
    rows = marked.withColumns({
        "_seen": F.array(*[F.count(F.when(item & (F.col("level") == k), 1)).over(back) for k in range(1, LEVELS + 1)]),
        "_rows": F.count(F.when(table, 1)).over(back),
        "_item": F.last(F.when(item, F.struct(F.col(order).alias("at"), "level")), True).over(after),
        "_breaks": F.col("kind").isin("table", "sep") == F.lit(False),
    })
    # at a table line: rows from it to the first line that is neither table nor separator
    rows = rows.withColumn("_length", F.col("_rows") - F.coalesce(F.last(F.when(F.col("_breaks"), F.col("_rows")), True).over(after), F.lit(0)))
    rows = rows.withColumns({
        "_table": F.last(F.when(table, F.struct(F.col(order).alias("at"), F.col("_length").alias("n"))), True).over(after),
        "_end": F.array(*[F.last(F.when(item & (F.col("level") <= k), F.col("_seen")), True).over(after) for k in range(1, LEVELS + 1)]),
    })
    child = F.when(F.col("_item.level") > F.col("level"), F.col("_item.level"))
    n = F.try_element_at("_seen", child) - F.coalesce(F.try_element_at(F.try_element_at("_end", F.col("level")), child), F.lit(0))
    below = F.when((F.col("_table.n") > 1) & (F.col("_item").isNull() | (F.col("_table.at") < F.col("_item.at"))), F.col("_table.n") - 1)
    return rows.filter(item).select(key, F.col(order).alias(order), F.when(child.isNotNull(), n).otherwise(below).alias("n"))


def check_limits(marked: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """(key, scope, op, n, best, verdict): the largest count under an item whose text has the scope, against each limit of its text.

    limits are (key, scope, op, n). Verdicts: ok, over (any op but min), under (min), empty (items without children), missing, and
    unclear where n is null or NaN or the scope has fewer than two letters.
    """
    known = limits.select(key, "scope", "op", "n").distinct().withColumn("_key", bare(F.coalesce("scope", F.lit(""))))
    unclear = F.col("n").isNull() | F.isnan(F.col("n").cast("double")) | (F.length("_key") < 2)
    counted = marked.filter("kind = 'item'").join(count_under(marked, key), [key, "ln"]).select(key, bare(item_text(F.col("text"))).alias("_text"), F.col("n").alias("found"))
    pairs = known.filter(~unclear).join(counted, key).filter(F.col("_text").contains(F.col("_key")))
    best = pairs.groupBy(key, "scope", "op", "n").agg(F.max("found").alias("best"), F.lit(True).alias("seen"))
    joined = known.alias("k").join(best.alias("b"), (F.col(f"k.{key}") == F.col(f"b.{key}")) & F.col("k.scope").eqNullSafe(F.col("b.scope")) & F.col("k.op").eqNullSafe(F.col("b.op")) & F.col("k.n").eqNullSafe(F.col("b.n")), "left")
    out = joined.select(f"k.{key}", "k.scope", "k.op", "k.n", "_key", "best", "seen")
    verdict = F.when(unclear, "unclear").when(F.col("seen").isNull(), "missing").when(F.col("best").isNull(), "empty").when((F.col("op") == "min") & (F.col("best") < F.col("n")), "under").when(~F.col("op").eqNullSafe("min") & (F.col("best") > F.col("n")), "over").otherwise("ok")
    return out.select(key, "scope", "op", "n", "best", verdict.alias("verdict"))


def find_limits(texts: DataFrame, key: str, text: str, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """(key, i, text, scope, op, n, unit): quantity limits such as `추진전략 5개 이내`, each once, in order.

    What is limited is the scope that ends last within 40 characters before the number, the longer one of a tie; without one
    it is no limit. 이상 is a minimum, the others are maxima.
    """
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")
    some = texts.select(key, flat.alias("_flat")).select(key, F.regexp_extract_all("_flat", F.lit(LIMIT), F.lit(0)).alias("_found"), F.split("_flat", LIMIT).alias("_gaps")).filter(F.size("_found") > 0)
    each = some.select(key, F.posexplode(F.arrays_zip(F.col("_found").alias("said"), F.slice("_gaps", 1, F.size("_found")).alias("gap"))).alias("i", "x"))
    each = each.select(key, "i", "x.said", F.right("x.gap", F.lit(LOOK_BACK)).alias("gap"))
    # as many limits before as may lie within reach
    w = W.partitionBy(key).orderBy("i").rowsBetween(-LOOK_BACK, -1)
    before = F.right(F.concat(F.array_join(F.collect_list(F.concat("gap", "said")).over(w), ""), "gap"), F.lit(LOOK_BACK))
    # read backwards, what ends last comes first, and of two that end together the longer one is tried first
    words = "|".join(f"\\Q{t[::-1]}\\E" for t in sorted(scopes, key=lambda t: -len(t)))
    each = each.withColumn("_back", F.reverse(before)).filter(F.col("_back").rlike(words))
    part = lambda i: F.reverse(F.regexp_extract("_back", f"(?s)^(.*?)({words})", i))
    out = each.select(
        key, "i", trim(F.concat(part(2), part(1), "said")).alias("text"), part(2).alias("scope"),
        F.when(F.regexp_extract("said", LIMIT, 3) == "이상", "min").otherwise("max").alias("op"), F.regexp_extract("said", LIMIT, 1).cast("int").alias("n"), F.regexp_extract("said", LIMIT, 2).alias("unit"),
    )
    first = out.groupBy(key, "scope", "op", "n", "unit").agg(F.min(F.struct("i", "text")).alias("x"))
    nth = F.row_number().over(W.partitionBy(key).orderBy("x.i")) - 1
    return first.select(key, nth.alias("i"), "x.text", "scope", "op", "n", "unit")


def counters(numbered_lines: DataFrame, key: str, order: str, levels: int) -> DataFrame:
    """numbered() lines with path, the counters of all levels down to their own: 0 for a level that hasn't begun below the last higher one."""
    w = W.partitionBy(key).orderBy(order)
    out = numbered_lines
    for k in range(1, levels + 1):
        # a level counts while no higher one has come since
        seen = F.last(F.when(F.col("level") == k, F.struct(order, "no")), True).over(w)
        higher = F.max(F.when(F.col("level") < k, F.col(order))).over(w)
        out = out.withColumn(f"_{k}", F.when(seen[order] > F.coalesce(higher, F.lit(-1)), seen["no"]).otherwise(0))
    return out.withColumn("path", F.slice(F.array(*[F.col(f"_{k}") for k in range(1, levels + 1)]), F.lit(1), F.col("level"))).drop(*[f"_{k}" for k in range(1, levels + 1)])


def fitted(parts: DataFrame, key: str, order: str, text: str, budget: int, gap: int = 2) -> DataFrame:
    """(key, order, start, shown, state) of texts that are joined in order with `gap` characters between them and end at the budget:
    whole, cut where it is crossed, or dropped behind."""
    w = W.partitionBy(key).orderBy(order)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("start", start).withColumn("_room", F.greatest(F.lit(budget) - F.col("start"), F.lit(0)))
    state = F.when(F.length(text) <= F.col("_room"), "whole").when(F.col("_room") > 0, "cut").otherwise("dropped")
    return out.select(key, order, "start", F.substring(text, F.lit(1), F.col("_room").cast("int")).alias("shown"), state.alias("state"))

