"""Debouncing a stream of file events: state for each path, and event-time timers that let a burst go once it is quiet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "path string, n bigint, type string, last_ts timestamp"
DELETED = "deleted"


class Debouncer(StatefulProcessor):
    """Of each path the burst that isn't over: how many events, the last one's type and place, and when it ends if it stays quiet.

    An event within ``quiet`` of the one before goes on with the burst, a later one starts a new one. A deletion throws away
    what is still pending then, and is told at once.
    """

    def __init__(self, quiet_ms: int, deleted: str):
        self.quiet, self.deleted = quiet_ms * 1000, deleted

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n bigint, type string, last bigint, seq bigint")

    def _told(self, key, burst: tuple) -> dict:
        return {"path": key[0], "n": burst[0], "type": burst[1], "last_ts": pd.Timestamp(burst[2], unit="us", tz="UTC")}

    def _end(self, burst: tuple) -> int:
        """When a burst ends, in whole milliseconds, which is how timers count."""
        return -(-(int(burst[2]) + self.quiet) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        burst = tuple(self.pending.get()) if self.pending.exists() else None
        if burst is not None:
            self.handle.deleteTimer(self._end(burst))
        out = []
        for row in pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable").itertuples():  # one path's events of one batch
            if burst is not None and row.us - burst[2] >= self.quiet:  # it was over before this event
                out.append(self._told(key, burst))
                burst = None
            if row.type == self.deleted:
                out.append(self._told(key, (1, row.type, row.us)))
                burst = None
            elif burst is None:
                burst = (1, row.type, row.us, row.seq)
            else:
                last = max((burst[2], burst[3], burst[1]), (row.us, row.seq, row.type))
                burst = (burst[0] + 1, last[2], last[0], last[1])
        if burst is None:
            self.pending.clear()
        else:
            self.pending.update((int(burst[0]), burst[1], int(burst[2]), int(burst[3])))
            self.handle.registerTimer(self._end(burst))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        burst = tuple(self.pending.get())
        self.pending.clear()
        yield pd.DataFrame([self._told(key, burst)])


def debounce_stream(events: DataFrame, quiet_seconds: float = 2.0, late: str = "0 seconds", deleted: str = DELETED) -> DataFrame:
    """(path, n, type, last_ts) of bursts in a stream of events (path, ts, type, seq), each once it was quiet for so long.

    Time is that of the events: a burst is told when the watermark has passed its end, so one that isn't over yet waits in the
    state for the next run. Needs a state store with column families (``spark.sql.streaming.stateStore.providerClass``), which
    this sets to RocksDB for the session where it isn't.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if events.sparkSession.conf.get(key, "") != provider:
        events.sparkSession.conf.set(key, provider)
    rows = events.withWatermark("ts", late).select("path", "ts", "type", F.col("seq").cast("bigint").alias("seq"), F.unix_micros("ts").alias("us"))
    return rows.groupBy("path").transformWithStateInPandas(Debouncer(round(quiet_seconds * 1000), deleted), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
