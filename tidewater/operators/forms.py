"""Small steps of form analysis: commonest values, majorities, references without a target, entries that are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def commonest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the value that most rows of a key have; of several the one that comes first in order."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_at"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "_at"))
    return counts.withColumn("_r", first).filter("_r = 1").select(*keys, value, "n")


def majority(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): values on at least half of a key's rows, rounded down, and on one at least; null is no value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    counts = counts.withColumn("_all", F.sum("n").over(W.partitionBy(*keys)))
    return counts.filter(F.col(value).isNotNull() & (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("_all") / 2)))).select(*keys, value, "n")


def style_groups(paragraphs: DataFrame, order: str, samples: int = 3) -> DataFrame:
    """(style, para, char, n, samples): paragraphs of equal style, with their first texts."""
    nth = F.row_number().over(W.partitionBy("style", "para", "char").orderBy(order))
    first = F.collect_list(F.when(F.col("_n") <= samples, F.struct(F.col("_n"), F.col("text").alias("t"))))
    return paragraphs.withColumn("_n", nth).groupBy("style", "para", "char").agg(F.count("*").alias("n"), F.transform(F.sort_array(first), lambda x: x["t"]).alias("samples"))


def match_ratio(paragraphs: DataFrame, key: str, matched: Column, least: float = 0.35) -> DataFrame:
    """(key, ratio, guess): the share of matched paragraphs; below `least` levels are to be guessed."""
    return paragraphs.groupBy(key).agg(F.avg(matched.cast("int")).alias("ratio")).withColumn("guess", F.col("ratio") < least)


def after_tables(paragraphs: DataFrame, key: str, order: str) -> DataFrame:
    """Paragraphs with text right after a table, empty ones in between aside."""
    some = paragraphs.filter((F.col("kind") == "table") | (F.trim("text") != ""))
    before = F.lag("kind").over(W.partitionBy(key).orderBy(order))
    return some.withColumn("_b", before).filter("_b = 'table' and kind <> 'table'").drop("_b")


def dangling(used: DataFrame, pool: DataFrame, key: str, attr: str, ref: str) -> DataFrame:
    """(key, attr, missing): references without a target in the key's pool, by kind."""
    gone = used.select(key, attr, ref).distinct().join(pool.select(key, attr, ref).distinct(), [key, attr, ref], "left_anti")
    return gone.groupBy(key, attr).agg(F.sort_array(F.collect_set(ref)).alias("missing"))


def missing_entries(have: Column, needed: tuple[str, ...]) -> Column:
    """Needed entries that aren't there, in the order of what is needed."""
    return F.array_except(F.lit(list(needed)), have)


def placed_blocks(tokens: Column, blocks: Column) -> Column:
    """(placed, missing): blocks with a token in the text, in the text's order; tokens without a block, then blocks without a token."""
    placed = F.filter(tokens, lambda t: F.array_contains(blocks, t))
    lost = F.concat(F.filter(tokens, lambda t: ~F.array_contains(blocks, t)), F.array_except(blocks, tokens))
    return F.struct(placed.alias("placed"), F.array_distinct(lost).alias("missing"))


def relations(links: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """(key, a, b, state): relations of a diagram's tables (key, name, at): drawn to the right or left between neighbours, apart, or unknown."""
    at = lambda c, n: tables.select(key, F.col("name").alias(c), F.col("at").alias(n))
    both = links.join(at("a", "_a"), [key, "a"], "left").join(at("b", "_b"), [key, "b"], "left")
    gap = F.col("_b") - F.col("_a")
    state = F.when(gap.isNull(), "unknown").when(gap == 1, "right").when(gap == -1, "left").otherwise("apart")
    return both.select(key, "a", "b", state.alias("state"))


def catalog_stats(nodes: DataFrame) -> DataFrame:
    """(chapters, nodes, forms, howtos) of nodes (parent, forms, has)."""
    return nodes.agg(F.count(F.when(F.col("parent").isNull(), 1)).alias("chapters"), F.count("*").alias("nodes"), F.coalesce(F.sum("forms"), F.lit(0)).alias("forms"), F.count(F.when(F.col("has"), 1)).alias("howtos"))


def blank_forms(sections: DataFrame, key: str) -> DataFrame:
    """(key, nth, idx): the blank ones among a section's forms (array of idx, kind), in order of idx; a missing idx counts as 0."""
    blank = F.array_sort(F.transform(F.filter("forms", lambda f: f["kind"] == "blank"), lambda f: F.coalesce(f["idx"], F.lit(0))))
    return sections.select(key, F.posexplode(blank).alias("nth", "idx"))
