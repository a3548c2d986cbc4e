"""Places in an order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import cut

ROWS = 1 << 33  # row numbers of a partition in monotonically_increasing_id()


def positions(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """The rows with their place in the order, from 0: partitions by range, then each row's place in its own behind all before it.

    The sorted rows are checkpointed, so that both steps see the same partitions; what is broadcast has a row a partition.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(ranged).withColumns({"_part": F.floor(F.col("_id") / ROWS), "_row": F.col("_id") % ROWS})
    size = placed.groupBy("_part").count()
    before = size.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))  # a row a partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_id", "_part", "_row", "_before")
