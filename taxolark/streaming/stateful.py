"""Sessions of a stream by a processor with state and timers; rows that come too late are kept aside."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Days by which Spark's own watermark lags, so that it drops nothing; the processor keeps the true one.
LAG_DAYS = 3650
_LAG_MS = LAG_DAYS * 86_400_000
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ROWS = "key string, nth long, kind string, first timestamp, last timestamp, n long, total double, trail string"


class Sessions(StatefulProcessor):
    """Per key: waiting rows (list), the number of sessions closed (value), a timer for the next to close.

    A row is late if it is older than the newest row of all keys by more than the delay.
    A session closes when no row can extend it any more, so rows within the delay may
    come in any order. A gap of exactly ``gap_ms`` parts two sessions.
    """

    def __init__(self, gap_ms: int, delay_ms: int, trail: int):
        self.gap, self.delay, self.trail = gap_ms, delay_ms, trail

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, value double, kind string")
        self.closed = handle.getValueState("closed", "n long")

    def _now(self, timers) -> int:
        """The watermark in milliseconds."""
        return timers.getCurrentWatermarkInMs() + _LAG_MS - self.delay

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, fresh = self._now(timerValues), []
        for part in rows:
            ms = part["at"] // 1000
            late = part[ms < now]
            if len(late):
                t = pd.to_datetime(late["at"], unit="us")
                yield pd.DataFrame({"key": key[0], "nth": -1, "kind": "late", "first": t, "last": t, "n": 1, "total": late["value"].astype(float), "trail": late["kind"]})
            own = part[ms >= now]
            fresh += list(zip(own["at"].tolist(), own["value"].tolist(), own["kind"].tolist(), strict=True))
        if fresh:
            self.waiting.appendList(fresh)
            self._set_timer(min(r[0] for r in fresh))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now(timerValues)
        waiting = sorted((r for r in self.waiting.get()), key=lambda r: (r[0], r[2], r[1]))
        nth = self.closed.get()[0] if self.closed.exists() else 0
        out, open_ = [], []
        for rows in self._split(waiting):
            if rows[-1][0] // 1000 + self.gap <= now:
                trail = ">".join(r[2] for r in rows[-self.trail :])
                out.append((key[0], nth, "session", rows[0][0], rows[-1][0], len(rows), float(sum(r[1] for r in rows)), trail))
                nth += 1
            else:
                open_ += rows
        self.closed.update((nth,))
        if open_:
            self.waiting.put(open_)
            self._set_timer(min(self._ends(open_)) - self.gap * 1000)
        else:
            self.waiting.clear()
        if out:
            found = pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])
            yield found.assign(first=pd.to_datetime(found["first"], unit="us"), last=pd.to_datetime(found["last"], unit="us"))

    def _split(self, rows: list) -> Iterator[list]:
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][0] - rows[i - 1][0] >= self.gap * 1000:
                yield rows[start:i]
                start = i

    def _ends(self, rows: list) -> list[int]:
        return [s[-1][0] + self.gap * 1000 for s in self._split(rows)]

    def _set_timer(self, at: int) -> None:
        """When a session whose last row is then would close: an earlier call is harmless, it closes what it can."""
        self.handle.registerTimer(max(1, -(-at // 1000) + self.gap + self.delay - _LAG_MS))

    def close(self) -> None:
        pass


def sessions(stream: DataFrame, key: str, at: str, value: str, kind: str, gap_ms: int, delay_ms: int, trail: int = 3) -> DataFrame:
    """(key, nth, kind, first, last, n, total, trail): closed sessions of a stream's keys, and its late rows one by one.

    ``kind`` is session or late; ``trail`` the last few kinds of a session's rows, ``nth``
    its number from 0 within the key, -1 for late rows. Rows without key or time have
    no session and are left out. Sessions that are still open stay in the state.
    """
    own = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("ts"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    own = own.where("key is not null and ts is not null").withColumn("at", F.unix_micros("ts")).withWatermark("ts", f"{LAG_DAYS} days")
    return own.groupBy("key").transformWithStateInPandas(Sessions(gap_ms, delay_ms, trail), ROWS, "Append", "EventTime")


def start(found: DataFrame, closed: str, late: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes sessions to one folder and late rows to another, a part for each batch that a repeated one replaces.

    The state lies in the checkpoint; a query started again with it goes on where it was.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, path in (("session", closed), ("late", late)):
            batch.where(F.col("kind") == name).drop("kind").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    conf = found.sparkSession.conf
    before = conf.get(_PROVIDER[0], None)
    conf.set(*_PROVIDER)  # a query keeps the store that it was started with
    try:
        writer = found.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if before is None:
            conf.unset(_PROVIDER[0])
        else:
            conf.set(_PROVIDER[0], before)
