"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

Every shard draws -ln(u) / weight from a hash of the row's key and its own number; a rack's draw is the smallest
of its shards' draws and a region's the smallest of its racks'. The smallest of exponential draws is itself an
exponential draw with the summed weight, so descending region, rack, shard by the smallest draw chooses each
subtree in proportion to its weight. A draw depends on nothing outside its subtree: where weights change, rows
move only into the subtrees that gain and out of those that lose, and a new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

SALTED = 1 << 14  # rows of a shard that are numbered together, on average


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """Equal shards, filled rack by rack and region by region; the count alone decides."""
    return [Shard(i, i // (per_rack * racks_per_region), i // per_rack) for i in range(shards)]


def _draw(key: list[str], shard: Shard) -> Column:
    # 52 bits of the hash as a number in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard.number)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / shard.weight


def place(rows: DataFrame, key: list[str], shards: list[Shard], name: str = "shard") -> DataFrame:
    """The rows with the column `name`: the shard that the descent ends at. Shards of weight 0 take nothing."""
    live = [s for s in shards if s.weight > 0]
    draws = {s.number: F.col(f"__d{s.number}") for s in live}
    rows = rows.withColumns({f"__d{s.number}": _draw(key, s) for s in live})

    def smallest(xs: list[Column]) -> Column:
        return xs[0] if len(xs) == 1 else F.least(*xs)

    def descend(options: dict[int, tuple[Column, Column]]) -> Column:
        """options: number to (draw, what it leads to); ties go to the smaller number."""
        best = smallest([d for d, _ in options.values()])
        out = None
        for d, leads in reversed(list(options.values())):
            out = leads if out is None else F.when(d == best, leads).otherwise(out)
        return out

    regions = {}
    for region in sorted({s.region for s in live}):
        racks = {}
        for rack in sorted({s.rack for s in live if s.region == region}):
            own = {s.number: (draws[s.number], F.lit(s.number)) for s in live if (s.region, s.rack) == (region, rack)}
            racks[rack] = (smallest([d for d, _ in own.values()]), descend(own))
        regions[region] = (smallest([d for d, _ in racks.values()]), descend(racks))
    return rows.withColumn(name, descend(regions).cast("int")).drop(*[f"__d{s.number}" for s in live])


def number_slots(rows: DataFrame, shard: str, order: list[str], name: str = "slot") -> DataFrame:
    """The rows with `name`: 0, 1, 2 ... within each shard, by salts and then `order`. There are as many salts as the largest
    shard needs; their counts pass on as offsets, so that no task holds a whole shard."""
    most = rows.groupBy(shard).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(-(-most // SALTED))))
    counts = cut(rows.groupBy(shard, "__salt").agg(F.count("*").alias("__n")))
    before = F.sum("__n").over(W.partitionBy(shard).orderBy("__salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(shard, "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(W.partitionBy(shard, "__salt").orderBy(*order)) - 1
    return rows.withColumn("__rank", rank).join(offsets, [shard, "__salt"]).withColumn(name, F.col("__rank") + F.col("__before")).drop("__salt", "__rank", "__before")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, by the law `key`: only doc_id and the number of shards decide.

    A null text has size 1 and the checksum of the empty text; a null doc_id is a key like any other; repeated
    rows share a shard and have slots of their own; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, ["doc_id"], layout(shards)), ["doc_id"], layout(shards + 1), "grown_shard")
    return number_slots(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
