"""Review windows as keyed state: opened by a review, closed by a quiet spell."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gapspark import fixed

WINDOW_EVENTS = "film_link STRING, event STRING, event_day DATE"
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000


#: Parts of the films by hash; the films of a part share one state value and one timer.
BUCKETS = 256


class WindowKeeper(StatefulProcessor):
    """Last review day per film; emits ``opened`` and ``closed`` events.

    The window of a film closes once more than ``quiet_days`` pass in event time
    without a review and opens again with the next one. A call handles all films of a
    bucket at once: their last days are one table, read and written whole, and the bucket's
    timer is that of the film that closes first.
    """

    def __init__(self, quiet_days: int = fixed.QUIET_DAYS):
        self.quiet_days = quiet_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last_days = handle.getValueState("last_days", "films BINARY")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[["film_link", "day_number"]] for part in rows]
        days = pd.concat(parts).drop_duplicates().sort_values(["film_link", "day_number"], ignore_index=True)
        known = self._known()
        # the day before a film's first one here is the last one of the batches before
        stored = days["film_link"].map(known).astype("float64")
        before = days.groupby("film_link")["day_number"].shift().astype("float64")
        last = np.fmax(before, stored)
        gone = days["day_number"] - last > self.quiet_days
        closed = self._frame(days["film_link"][gone], "closed", last[gone] + self.quiet_days + 1)
        new = gone | last.isna()
        opened = self._frame(days["film_link"][new], "opened", days["day_number"][new])
        newest = days.groupby("film_link")["day_number"].max()
        self._keep(pd.concat([known, newest]).groupby(level=0).max())
        if len(opened):
            yield pd.concat([closed, opened], ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the films that the watermark has passed too, not only the one the timer was for
        known = self._known()
        over = (known + self.quiet_days + 1) * _DAY_MS <= timerValues.getCurrentWatermarkInMs()
        self._keep(known[~over])
        ended = known[over]
        if len(ended):
            yield self._frame(ended.index.to_series(), "closed", ended + self.quiet_days + 1)

    def close(self) -> None:
        pass

    def _known(self) -> pd.Series:
        """Last review day of the bucket's films with an open window, by film."""
        if not self.last_days.exists():
            return pd.Series([], index=pd.Index([], dtype=object), dtype="int64")
        table = pa.ipc.open_stream(self.last_days.get()[0]).read_pandas()
        return pd.Series(table["day"].to_numpy(), index=pd.Index(table["film_link"], dtype=object))

    def _keep(self, known: pd.Series) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not len(known):
            self.last_days.clear()
            return
        table = pa.table({"film_link": pa.array(known.index, pa.string()), "day": pa.array(known.to_numpy(), pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.last_days.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer((int(known.min()) + self.quiet_days + 1) * _DAY_MS)

    @staticmethod
    def _frame(films: pd.Series, event: str, days: pd.Series) -> pd.DataFrame:
        dates = [_EPOCH + dt.timedelta(days=int(day)) for day in days]
        return pd.DataFrame({"film_link": films.to_numpy(), "event": event, "event_day": dates}, columns=["film_link", "event", "event_day"])


def review_days(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """One row per film and day with a review.

    Collapsing a film's day to one row bounds what reaches the task that keeps
    the state of a film by the calendar, whatever its number of reviews.
    """
    return (
        stream.withWatermark(ts, delay)
        .withColumn("day_ts", F.date_trunc("day", ts))
        .groupBy("film_link", F.window(ts, "1 day").alias("span"))
        .agg(F.count("*").alias("reviews"))
        .select(
            "film_link",
            F.datediff(F.col("span.start").cast("date"), F.lit("1970-01-01").cast("date")).alias(
                "day_number"
            ),
            F.col("span.start").alias("day_start"),
        )
    )


def window_events(days: DataFrame, quiet_days: int = fixed.QUIET_DAYS, buckets: int = BUCKETS) -> DataFrame:
    """Open and close events of every film; needs the RocksDB state store.

    A checkpoint goes with its number of buckets.
    """
    bucket = F.pmod(F.xxhash64("film_link"), F.lit(buckets)).cast("int")
    return days.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=WindowKeeper(quiet_days),
        outputStructType=WINDOW_EVENTS,
        outputMode="Append",
        timeMode="EventTime",
    )
