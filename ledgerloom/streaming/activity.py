"""Running statistics of keys over a stream whose loads overlap: late rows count, repeated ones don't.

The watermark stays behind the latest row by the overlap, and only rows older than it are let go. State of a key: its totals, and
the ids met that are younger; a timer for each day that holds ids forgets them, so the state is bounded by the rows of the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_US = 86_400_000_000
OVERLAP_DAYS = 8
SCHEMA = "key string, n bigint, empty bigint, total double, last_us bigint"
#: The state store that keyed maps and timers need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Activity(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "n bigint, empty bigint, total double, last_us bigint")
        self.met = handle.getMapState("met", "id bigint", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, empty, total, last = self.totals.get() if self.totals.exists() else (0, 0, 0.0, 0)
        days: set[int] = set()
        floor = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            for i, us, value in zip(part["id"].tolist(), part["us"].tolist(), part["value"].tolist(), strict=True):
                if us < floor or self.met.containsKey((i,)):
                    continue
                self.met.updateValue((i,), (us,))
                days.add(us // DAY_US)
                known = value is not None and value == value
                n, empty, total, last = n + 1, empty + (not known), total + (value if known else 0.0), max(last, us)
        self.totals.update((n, empty, total, last))
        for day in days:
            self.handle.registerTimer((day + 1) * DAY_US // 1000)
        yield pd.DataFrame([(key[0], n, empty, total, last)], columns=["key", "n", "empty", "total", "last_us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for i in [i for i, us in self.met.iterator() if us[0] < end]:
            self.met.removeKey(i)
        return iter(())

    def close(self) -> None:
        pass


def running(events: DataFrame, key: str, id_col: str, ts: str, value: str, overlap_days: int = OVERLAP_DAYS) -> DataFrame:
    """(key, n, empty, mean, last_seen) of each key, again whenever it gets rows: the last row of a key is its state. Update mode; the session needs ``PROVIDER``."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(id_col).cast("bigint").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(value).cast("double").alias("value"))
    rows = rows.where("key IS NOT NULL AND id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{overlap_days} days")
    out = rows.groupBy("key").transformWithStateInPandas(Activity(), SCHEMA, "Update", "EventTime")
    return out.select("key", "n", "empty", (F.col("total") / F.nullif(F.col("n") - F.col("empty"), F.lit(0))).alias("mean"), F.timestamp_micros("last_us").alias("last_seen"))


def once_over(events: DataFrame, key: str, id_col: str, ts: str, value: str) -> DataFrame:
    """The same of a batch: each id of a key counts once, by its first row in time."""
    rows = events.where(F.col(key).isNotNull() & F.col(id_col).isNotNull() & F.col(ts).isNotNull())
    one = rows.groupBy(F.col(key).cast("string").alias("key"), F.col(id_col)).agg(F.min(F.struct(F.col(ts), F.col(value).cast("double").alias(value))).alias("r"))
    return one.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col(f"r.{value}").isNull()).alias("empty"), F.avg(f"r.{value}").alias("mean"), F.max(F.col(f"r.{ts}").cast("timestamp")).alias("last_seen"))
