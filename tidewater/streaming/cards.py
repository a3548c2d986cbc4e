"""The latest card of each section over a stream of saved cards, in buckets of which a batch rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.order import positions

BUCKETS = 64
KEPT = 2  # versions of a bucket that stay: the last, and the one that a batch reads when it runs again


def _versions(spark: SparkSession, folder: str) -> dict[int, list[int]]:
    """Batches that wrote each bucket, in order; as many entries as there are buckets."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/cards")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    number = lambda s: int(s.getPath().getName().partition("=")[2])
    named = lambda p, what: [s for s in files.listStatus(p) if s.getPath().getName().startswith(f"{what}=")] if files.exists(p) else []
    return {number(b): sorted(number(v) for v in named(b.getPath(), "batch")) for b in named(path, "bucket")}


def _read(spark: SparkSession, folder: str, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{folder}/cards").parquet(*paths)


def keep_latest(cards: DataFrame, folder: str, key: str = "id", order: str = "ord", buckets: int = BUCKETS) -> StreamingQuery:
    """Runs the stream of cards (key, order, ...) to its end; each batch writes the buckets of its keys to folder/cards/bucket=b/batch=n.

    A section's card is replaced in its place, a new section's comes behind those before; of several cards of a batch the last in
    order counts. A batch that runs again after a failure reads the versions before it and overwrites its own partitions only, so
    nothing counts twice. Buckets without a card of the batch aren't read or written.
    """
    spark = cards.sparkSession
    values = [c for c in cards.columns if c not in (key, order)]
    kinds = {f.name: f.dataType.simpleString() for f in cards.schema}
    schema = ", ".join([f"{key} {kinds[key]}", *(f"{c} {kinds[c]}" for c in values), "first_batch long", f"first_order {kinds[order]}", "bucket int", "batch long"])

    def upsert(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        last = F.max_by(F.struct(*values), order).alias("new")
        new = batch.groupBy(key).agg(last, F.min(order).alias("new_order")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most as many as there are buckets
        known = {b: [n for n in v if n < number] for b, v in _versions(own, folder).items() if b in touched}
        paths = [f"{folder}/cards/bucket={b}/batch={v[-1]}" for b, v in known.items() if v]
        old = _read(own, folder, paths, schema).drop("batch") if paths else own.createDataFrame([], schema).drop("batch")
        both = old.join(new, [key, "bucket"], "full")
        fresh = F.col("new").isNotNull()
        told = [F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in values]
        out = both.select(key, *told, F.coalesce("first_batch", F.lit(number)).alias("first_batch"), F.coalesce("first_order", "new_order").alias("first_order"), "bucket", F.lit(number).alias("batch"))
        out.repartition("bucket").write.partitionBy("bucket", "batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/cards")
        fs = own._jvm.org.apache.hadoop.fs
        for b, v in known.items():
            for n in v[: -(KEPT - 1)]:
                path = fs.Path(f"{folder}/cards/bucket={b}/batch={n}")
                path.getFileSystem(own._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    return cards.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(upsert).start()


def read(spark: SparkSession, folder: str, order: str = "ord") -> DataFrame:
    """The cards as they are now, with their place in the order in which their sections first came."""
    versions = _versions(spark, folder)
    if not versions:
        raise ValueError(f"no cards in {folder}")
    paths = [f"{folder}/cards/bucket={b}/batch={v[-1]}" for b, v in versions.items()]
    found = spark.read.option("basePath", f"{folder}/cards").parquet(*paths)
    return positions(found, "first_batch", "first_order", name=order).drop("first_batch", "first_order", "bucket", "batch")
