"""Diagrams in texts: fenced blocks, indented trees with the leaves below each node, and bands of cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.text import diagram_header, split_attrs, trim

from .markers import indent_tree

FENCE = r"^:::\s*(?:diagram)?\s*(.*)$"


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, line, type, title, options, body): the fenced blocks of each text, from 0; line is where a block opens.

    Every other fence closes; the last block may go on to the end. White space behind lines goes, and blank lines at both ends.
    """
    w = W.partitionBy(key).orderBy("ln")
    x = texts.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")).alias("ln", "s"))
    x = x.withColumn("fence", trim(F.col("s")).startswith(":::")).withColumn("nth", F.sum(F.col("fence").cast("int")).over(w)).filter("nth % 2 = 1")
    head = F.max(F.when(F.col("fence"), F.struct("ln", trim(F.regexp_extract(trim(F.col("s")), FENCE, 1)).alias("head"))))
    inside = F.transform(F.sort_array(F.collect_list(F.when(~F.col("fence"), F.struct("ln", F.regexp_replace("s", r"(?U)\s+$", "").alias("s"))))), lambda v: v["s"])
    made = x.groupBy(key, "nth").agg(head.alias("h"), inside.alias("all"))
    full = F.transform(F.filter(F.transform("all", lambda s, i: F.struct(i.alias("i"), (trim(s) != "").alias("said"))), lambda v: v["said"]), lambda v: v["i"])
    made = made.withColumn("_full", full)
    body = F.when(F.size("_full") > 0, F.slice("all", F.array_min("_full") + 1, F.array_max("_full") - F.array_min("_full") + 1)).otherwise(F.array().cast("array<string>"))
    d = diagram_header(F.col("h.head"))
    return made.withColumn("d", d).select(key, ((F.col("nth") - 1) / 2).cast("int").alias("block"), (F.col("h.ln") + 1).alias("line"), "d.type", "d.title", "d.options", body.alias("body"))


def trees(made: DataFrame, key: str) -> DataFrame:
    """(key, block, ln, parent, depth, text, attrs, first, last): blocks() as trees; a node spans the leaves first to last, from 0.

    The nodes of a block come in order with only the open ones carried along: a node's last leaf is known when it closes.
    """
    named = made.select(F.struct(key, "block").alias("id"), F.array_join("body", "\n").alias("t"))
    nodes = indent_tree(named.select(F.to_json("id").alias("_k"), "t"), "_k", "t")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, open_at, leaves = None, [], 0

        def close(depth: int) -> list[tuple]:
            nonlocal leaves
            out = []
            while open_at and open_at[-1][0] >= depth:
                d, ln, first = open_at.pop()
                if first == leaves:  # nothing below it
                    leaves += 1
                out.append((now, ln, first, leaves - 1))
            return out

        for b in batches:
            rows = []
            for k, ln, depth in zip(b["_k"].tolist(), b["ln"].tolist(), b["depth"].tolist()):
                if k != now:
                    rows += close(0)
                    now, leaves = k, 0
                rows += close(depth)
                open_at.append((depth, ln, leaves))
            yield pd.DataFrame(rows, columns=["_k", "ln", "first", "last"])
        yield pd.DataFrame(close(0), columns=["_k", "ln", "first", "last"])

    spans = nodes.select("_k", "ln", "depth").repartition("_k").sortWithinPartitions("_k", "ln").mapInPandas(walk, "_k string, ln int, first int, last int")
    kind = dict(made.dtypes)[key]
    out = nodes.join(spans, ["_k", "ln"]).withColumn("id", F.from_json("_k", f"{key} {kind}, block int"))
    return out.select(f"id.{key}", "id.block", "ln", "parent", "depth", "text", "attrs", "first", "last")


def bands(made: DataFrame, key: str) -> DataFrame:
    """(key, block, band, label, row, cell, text, attrs): blocks() as bands of `label | cell | cell` lines.

    A line with a label begins a band; one without goes on with the last. A line without bars is one cell. Separators, cells and
    lines without text are passed over.
    """
    x = made.select(key, "block", F.posexplode("body").alias("ln", "s")).withColumn("s", trim(F.col("s")))
    x = x.filter((F.col("s") != "") & ~F.col("s").rlike(r"(?U)^\|[\s:|-]+\|?$"))
    parts = F.transform(F.split(F.regexp_replace("s", r"(?U)(\s*\|)+\s*$", ""), r"\|"), trim)
    x = x.withColumn("p", F.when(F.regexp_replace("s", r"(?U)[\s|]+", "") == "", F.array(F.lit(""))).otherwise(parts))
    alone = F.size("p") == 1
    x = x.withColumns({"head": F.when(alone, "").otherwise(F.col("p")[0]), "cells": F.when(alone, F.col("p")).otherwise(F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))))})
    x = x.withColumn("cells", F.filter(F.transform("cells", split_attrs), lambda c: c["text"] != "")).filter(F.size("cells") > 0)
    w = W.partitionBy(key, "block").orderBy("ln")
    begins = (F.col("head") != "") | (F.row_number().over(w) == 1)
    x = x.withColumn("band", F.sum(begins.cast("int")).over(w).cast("int") - 1)
    x = x.withColumns({"label": F.first(split_attrs(F.col("head"))["text"]).over(W.partitionBy(key, "block", "band").orderBy("ln")), "row": F.row_number().over(W.partitionBy(key, "block", "band").orderBy("ln")) - 1})
    return x.select(key, "block", "band", "label", "row", F.posexplode("cells").alias("cell", "c")).select(key, "block", "band", "label", "row", "cell", "c.text", "c.attrs")
