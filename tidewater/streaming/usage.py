"""The usage ledger over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.ledger import ZONE, zone_day


def usage_stream(events: DataFrame, model: str, ts: str, late: str = "1 hour", zone: str = ZONE) -> DataFrame:
    """(day, hour, model, n): counts per hour within the zone's day.

    A day in a zone with daylight saving has 23 to 25 hours, so the state is kept by the hour, which the watermark can
    evict, with the day beside it; a day's total is the sum of its hours. Events later than `late` are dropped.
    """
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    by_hour = timed.groupBy(F.window("_ts", "1 hour").alias("w"), zone_day(F.col("_ts"), zone).alias("day"), F.col(model).alias("model"))
    return by_hour.agg(F.count("*").alias("n")).select("day", F.col("w.start").alias("hour"), "model", "n")
