"""Shared pieces of the training-data operators: stored tables, bounded batches and components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, shared_dir


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """df, whose Arrow batches are to hold about `size` bytes: with the session's default of 64 MB, several buffers of that size
    a task add up to more than what an executor leaves beside its heap. A session that sets another size keeps it."""
    conf = df.sparkSession.conf
    if conf.get(BATCH, None) in ("67108864", "67108864b", "64m", "64MB"):
        conf.set(BATCH, str(size))
    return df


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed Parquet table, for what is large or read by column."""
    path = f"{shared_dir(df.sparkSession)}/tidewater-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._stored_at = path
    _stored.append((df.sparkSession, path))
    return out


_stored: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clean() -> None:
    """Deletes all tables that stored() has made in this process and nobody has dropped: for when all results are written."""
    while _stored:
        _delete(*_stored.pop())


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() from which nothing is read any more: all that was made of them is stored itself."""
    for t in tables:
        _stored[:] = [x for x in _stored if x[1] != t._stored_at]
        _delete(t.sparkSession, t._stored_at)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with none of the taken ones (in any case)."""
    used, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """(id, k1, k2): the id and 128 bits of the text, so that repeated ids with different texts stay apart."""
    text = F.col(text_col)
    return F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node that it reaches.

    Alternates the large-star and small-star steps until nothing moves. Each step is a grouped
    minimum (combined before the shuffle) and a join (split by AQE where one node is hot), and each
    round is checkpointed. Minima are checkpointed before they are joined, as only then AQE splits a hot node. Rows with a null end and loops are ignored; an empty input gives no rows.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        e = cut(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = tuple(now)
