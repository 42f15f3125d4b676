"""Rate limits as streaming state: what an account has used up when a call comes in, and whether it may run at all."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "account long, call_id long, at timestamp, hour_calls int, day_calls int, month_symbols int, cooling boolean, busy boolean"
NAMES = [c.split()[0] for c in OUT.split(", ")]
HOUR, DAY = timedelta(hours=1), timedelta(days=1)


class Quota(StatefulProcessor):
    """State of an account: the calls of its last day, the symbols of its month, the end of a cooldown, and since when a run is on.

    All of it is bounded by what an account does in a month. A timer a day after the last call drops the calls, and one after
    the month its symbols, so an account that falls silent leaves nothing but its two dates.
    """

    def __init__(self, cooldown: timedelta, stale: timedelta) -> None:
        self.cooldown, self.stale = cooldown, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "at timestamp")
        self.symbols = handle.getMapState("symbols", "symbol string", "month int")
        self.dates = handle.getValueState("dates", "cooling_until timestamp, run_since timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "call_id"], ignore_index=True)  # an account's calls of one batch
        calls = [x[0] for x in self.calls.get()] if self.calls.exists() else []
        until, since = self.dates.get() if self.dates.exists() else (None, None)
        known = {k[0]: v[0] for k, v in self.symbols.iterator()} if self.symbols.exists() else {}
        before, out = dict(known), []
        for call, at, symbol, kind in zip(frame["call_id"], frame["at"], frame["symbol"], frame["kind"], strict=True):
            at = at.to_pydatetime()
            month = 100 * at.year + at.month
            calls = [x for x in calls if x > at - DAY] + [at]
            known = {s: m for s, m in known.items() if m == month} | {symbol: month}
            cooling, busy = until is not None and at < until, False
            if kind == "limit":
                until = at + self.cooldown
            elif kind == "start":
                busy = since is not None and at - since < self.stale
                since = since if busy else at
            elif kind == "end":
                since = None
            out.append((key[0], call, at, sum(x > at - HOUR for x in calls), len(calls), len(known), cooling, busy))
        self.calls.put([(x,) for x in calls])
        for s in before.keys() - known.keys():
            self.symbols.removeKey((s,))
        for s, m in known.items():
            if before.get(s) != m:
                self.symbols.updateValue((s,), (m,))
        self.dates.update((until, since))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        last = frame["at"].iloc[-1]
        for t in (last + DAY, (last + pd.offsets.MonthBegin(1)).normalize()):
            self.handle.registerTimer(int(t.value // 1_000_000))
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        if at == at.normalize() and at.day == 1:
            self.symbols.clear()
        else:
            self.calls.clear()
        return iter([])

    def close(self) -> None:
        pass


def used(stream: DataFrame, cooldown: timedelta, stale: timedelta, delay: str = "1 hour") -> DataFrame:
    """OUT for each call of a stream (account, call_id, at, symbol, kind), in the order of time within an account.

    hour_calls and day_calls count the account's calls of the hour and day that end with this one, month_symbols its different
    symbols of the calendar month so far. A call of kind "limit" starts a cooldown, in which later ones are cooling; "start"
    begins a run, which is busy if another one has not ended and began less than `stale` before, and "end" ends it. Calls
    later than the watermark's delay are dropped.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.withWatermark("at", delay).groupBy("account").transformWithStateInPandas(Quota(cooldown, stale), OUT, "Append", "EventTime")


def call_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("account long, call_id long, at timestamp, symbol string, kind string").parquet(folder)
