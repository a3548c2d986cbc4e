"""Settings in layers, nested as deep as they are: later layers lie over earlier ones, value by value.

Each layer's JSON becomes rows of paths and values, one level of nesting a step. What lies over a value is then a question of
paths: a later value or object at its place, or a later value at a place above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def paths(layers: DataFrame, key: str, layer: str, text: str) -> DataFrame:
    """(key, layer, path array, value): every value of each layer's JSON, arrays whole; an object is a row without a value.
    A null or malformed text has no rows, and neither has one that isn't an object."""
    spark = layers.sparkSession
    # a small file is read by one task, and each level of nesting stays where its texts are
    layers = layers.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, layer)
    now = layers.select(key, layer, F.array().cast("array<string>").alias("path"), F.try_parse_json(text).alias("v")).filter("v is not null")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    now, out = now.filter(is_object), None
    while True:
        inside = now.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_k"), F.col("value").alias("_v")))
        level = inside.select(key, layer, F.concat("path", F.array("_k")).alias("path"), F.col("_v").alias("v")).withColumn("object", is_object).persist()
        told = level.select(key, layer, "path", F.when(~F.col("object"), F.to_json("v")).alias("value"))
        out = told if out is None else out.union(told)
        now = level.filter("object").drop("object")
        if now.isEmpty():  # as many steps as the deepest layer has levels
            return out


def merged(layers: DataFrame, key: str, layer: str, text: str) -> DataFrame:
    """(key, path, value) of the layers (key, layer, text) of each key laid over each other in order of layer.

    An object goes into an object; anything else replaces what is there, as null does. An empty object is a value only where
    nothing is left inside it.
    """
    rows = paths(layers, key, layer, text).withColumns({"object": F.col("value").isNull()})
    at = W.partitionBy(key, "path")
    last_value = F.max(F.when(~F.col("object"), F.col(layer)))
    rows = rows.withColumns({"_value": last_value.over(at), "_object": F.max(F.when(F.col("object"), F.col(layer))).over(at)})
    # a later value above it hides a row
    above = rows.filter(~F.col("object")).groupBy(F.col(key).alias("_key"), F.col("path").alias("_above")).agg(F.max(layer).alias("_cut"))
    places = rows.select(key, "path", layer, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice(F.col("path"), F.lit(1), n))).alias("_above")).filter("size(_above) < size(path)")
    hidden = places.join(above, (F.col(key) == F.col("_key")) & (places["_above"] == above["_above"]) & (F.col("_cut") > F.col(layer))).select(key, "path", layer).distinct()
    seen = rows.join(hidden, [key, "path", layer], "left_anti")
    leaves = seen.filter(~F.col("object") & (F.col(layer) == F.col("_value")) & ~F.coalesce(F.col("_object") > F.col(layer), F.lit(False))).select(key, "path", "value")
    objects = seen.filter(F.col("object") & ~F.coalesce(F.col("_value") > F.col(layer), F.lit(False))).select(key, "path").distinct()
    full = leaves.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda n: F.slice(F.col("path"), F.lit(1), n))).alias("path")).distinct()
    inner = objects.select(key, F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).filter("size(path) > 0").distinct()
    empty = objects.join(full, [key, "path"], "left_anti").join(inner, [key, "path"], "left_anti").select(key, "path", F.lit("{}").alias("value"))
    return leaves.union(empty)
