"""The usage ledger as keyed state: a page a day and model, turned over at the zone's midnight by a timer on event time.

A page counts uses, keeps that a limit was hit once it was, and the last positive limit that an event named. Several pages of a
model may be open while events come out of order; a page ends when the watermark passes its midnight, and events of ended
days are dropped, as a ledger never goes back to a day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewater.operators.ledger import ZONE, next_reset, zone_day

PAGE = "model string, day string, n long, exhausted boolean, limit long, final boolean"
BUCKETS = 512  # of models, whose state is kept together
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ledger(StatefulProcessor):
    """State of a bucket of models: the open pages of a day, side by side, by the day's end in milliseconds.

    A call to the state costs far more than a page, so it is asked once a day and bucket, not once a page.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "ends long", "day string, model array<string>, n array<long>, exhausted array<boolean>, limit array<long>, limit_at array<long>")

    def _open(self, ends: int) -> dict[str, tuple] | None:
        value = self.pages.getValue((ends,)) if self.pages.containsKey((ends,)) else None
        return value and {m: (value[0], *page) for m, *page in zip(*value[1:])}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: dict[int, dict[str, tuple]] = {}
        touched: dict[int, set] = {}
        for b in rows:
            for model, day, ends, out, limit, at in zip(*[b[c].tolist() for c in ("model", "day", "ends", "out", "limit", "at")]):
                if ends not in days:
                    days[ends] = self._open(ends)
                    if days[ends] is None:
                        days[ends] = {}
                        self.handle.registerTimer(int(ends))
                    touched[ends] = set()
                day, n, exhausted, last, last_at = days[ends].get(model, (day, 0, False, 0, -1))
                if limit > 0 and at >= last_at:
                    last, last_at = int(limit), int(at)
                days[ends][model] = (day, n + 1, exhausted or bool(out), last, last_at)
                touched[ends].add(model)
        for ends, pages in days.items():
            day, n, exhausted, limit, limit_at = zip(*pages.values())
            self.pages.updateValue((ends,), (day[0], list(pages), list(n), list(exhausted), list(limit), list(limit_at)))
        yield self._told([(m, days[ends][m]) for ends, models in touched.items() for m in models], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = int(expiredTimerInfo.getExpiryTimeInMs())
        pages = self._open(ends)
        self.pages.removeKey((ends,))
        yield self._told(list(pages.items()), True)

    @staticmethod
    def _told(pages: list[tuple], final: bool) -> pd.DataFrame:
        return pd.DataFrame([(model, day, n, exhausted, limit, final) for model, (day, n, exhausted, limit, _) in pages], columns=[x.split()[0] for x in PAGE.split(", ")])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, model: str, ts: str, exhausted: Column, limit: Column, late: str = "1 day", zone: str = ZONE) -> DataFrame:
    """(model, day, n, exhausted, limit, final): a page whenever it changes, and once more when its day is over.

    Events more than `late` behind the latest are dropped. Start the stream with state in RocksDB (see start_with_rocks()).
    """
    at = F.col(ts).cast("timestamp")
    timed = events.select(F.col(model).cast("string").alias("model"), at.alias("_ts"), exhausted.alias("out"), F.coalesce(limit.cast("long"), F.lit(0)).alias("limit")).filter("_ts is not null")
    timed = timed.withColumns({"day": zone_day(F.col("_ts"), zone).cast("string"), "ends": F.unix_millis(next_reset(F.col("_ts"), zone)), "at": F.unix_micros("_ts")}).withWatermark("_ts", late)
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("model"), F.lit(BUCKETS)))
    return timed.groupBy("bucket").transformWithStateInPandas(Ledger(), PAGE, "Update", "EventTime")


def start_with_rocks(writer, session):
    """Starts a stream whose operators keep their state in RocksDB; the session's own setting stays as it was."""
    before = session.conf.get(PROVIDER, None)
    session.conf.set(PROVIDER, ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            session.conf.unset(PROVIDER)
        else:
            session.conf.set(PROVIDER, before)
