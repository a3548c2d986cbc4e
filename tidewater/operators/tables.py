"""Cells of extracted tables: delimiters, squaring, caps."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = ",\t;"


def delimiter(sample: str) -> str:
    """The delimiter by which the first five lines split most evenly into at least two columns; ties go to the earlier one."""
    def key(item: tuple[int, str]) -> tuple:
        counts = [len(r) for r in list(csv.reader(io.StringIO(sample), delimiter=item[1]))[:5] if r] or [0]
        mean = sum(counts) / len(counts)
        return mean > 1, -sum((c - mean) ** 2 for c in counts) / len(counts), mean, -item[0]

    return max(enumerate(DELIMITERS), key=key)[1]


@F.pandas_udf(T.StringType())
def sniff(samples: pd.Series) -> pd.Series:
    """delimiter() of each sample; a null one has none."""
    return pd.Series([None if x is None else delimiter(x) for x in samples], dtype=object)


def squared(rows: list[list[str]]) -> list[list[str]]:
    """Rows of cells without all-empty rows, padded to the widest."""
    rows = [r for r in rows if any(c != "" for c in r)]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def square(rows: Column) -> Column:
    """squared() for a column of rows."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))
    width = F.aggregate(full, F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    return F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def room(used: int, rows: int, width: int, most: int) -> int:
    """Rows of the next table that fit: it may start while there is room, is cut to what is left, but keeps one row at least."""
    return 0 if used >= most else min(rows, max(1, (most - used) // max(1, width)))


def cap_cells(tables: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, order, rows, width, kept): the rows of each table that fit when a key has room for `most` cells.

    Cells that a cut leaves free go to the next table, so this is a fold over a key's tables and no running sum. Tables come
    in order and only the cells used are carried from one to the next.
    """
    kinds = {f.name: f.dataType for f in tables.schema}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for b in batches:
            kept = []
            for k, rows, width in zip(b[key].tolist(), b["rows"].tolist(), b["width"].tolist()):
                if k != now:
                    now, used = k, 0
                kept.append(room(used, rows, width, most))
                used += kept[-1] * width
            yield b.assign(kept=kept)

    some = tables.filter("rows > 0").select(key, order, F.col("rows").cast("long").alias("rows"), F.col("width").cast("long").alias("width"))
    ordered = some.repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(fold, T.StructType([T.StructField(key, kinds[key]), T.StructField(order, kinds[order]), *[T.StructField(c, T.LongType()) for c in ("rows", "width", "kept")]]))


def csv_rows(text: Column, delimiter: Column) -> Column:
    """Rows of fields of a text with quoted fields: what stands between an odd and an even quote is inside, where delimiters and
    line breaks are text and two quotes are one. A last row without text is none.

    A text is split at its quotes; every other piece is outside, and an empty one between two inner pieces is a quote.
    """
    field, row = "\x01", "\x02"
    pieces = F.split(F.translate(text, field + row, ""), '"', -1)
    outside = lambda p: F.replace(F.regexp_replace(p, r"\r\n?|\n", row), delimiter, F.lit(field))
    last = F.size(pieces) - 1
    kept = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < last), '"').otherwise(outside(p)))
    rows = F.split(F.array_join(kept, ""), row, -1)
    rows = F.when(F.element_at(rows, -1) == "", F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
    return F.transform(rows, lambda r: F.split(r, field, -1))
