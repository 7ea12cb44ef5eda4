"""A cache with a time to live as a stateful stream: every request is fetched, served or answered with a stale value.

A request carries what a fetch at its time would give (null: the fetch fails).  The state of a key is
its last fetched value and when that was.  Requests inside the time to live are served from it; the first one after
that fetches; if the fetch fails, the value before it is served as stale, and the next request tries again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000


def answers(at: np.ndarray, value: np.ndarray, ttl: int, keep: int | None, known: tuple[float, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, int] | None]:
    """Answer, value and time of the value for requests of one key in rising order (times in microseconds), and the state after them.

    Costs a step per fetch, not per request: all requests up to the end of a value's life are served at once.
    """
    n = len(at)
    answer, given, as_of = np.full(n, "failed", object), np.full(n, np.nan), np.zeros(n, np.int64)
    good = np.append(np.flatnonzero(~np.isnan(value)), n)
    i = 0
    while i < n:
        if known is not None:
            # A request that is older than the value (from a later batch) is served as well.
            due = int(np.searchsorted(at, known[1] + ttl))
            answer[i:due], given[i:due], as_of[i:due] = "served", *known
            i = max(i, due)
        fetched = good[np.searchsorted(good, i)] if i < n else n
        if known is not None:
            stale = fetched if keep is None else min(fetched, max(i, int(np.searchsorted(at, known[1] + keep))))
            answer[i:stale], given[i:stale], as_of[i:stale] = "stale", *known
        if fetched < n:
            known = (float(value[fetched]), int(at[fetched]))
            answer[fetched], given[fetched], as_of[fetched] = "fetch", *known
        i = fetched + 1
    return answer, given, as_of, known


class TtlCache(StatefulProcessor):
    """Requests of a key in the order of time and id; its state goes when the value is no longer worth keeping."""

    def __init__(self, columns: list[str], ttl: int, keep: int | None):
        self.columns, self.ttl, self.keep_for = columns, ttl, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "value double, fetched long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One key's requests of one batch, three numbers each: maxFilesPerTrigger bounds them.
        name, ts, order, value = self.columns
        batch = pd.concat([r[[ts, order, value]] for r in rows]).sort_values([ts, order], kind="stable")
        at = batch[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        before = self.known.get() if self.known.exists() else None
        answer, given, as_of, known = answers(at, batch[value].to_numpy(float), self.ttl * SECOND, self.keep_for and self.keep_for * SECOND, before and (before[0], before[1]))
        if known is not None and (before is None or known[1] != before[1]):
            self.known.update(known)
            if self.keep_for is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(known[1] // 1000 + self.keep_for * 1000)
        stamps = pd.Series(as_of).astype("datetime64[us]").where(pd.Series(as_of != 0))
        out = pd.DataFrame({name: key[0], ts: batch[ts].to_numpy(), order: batch[order].to_numpy(), "answer": answer, value: pd.Series(given).where(~np.isnan(given)), "as_of": stamps})
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The value may not even be served as stale any more."""
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_answers(requests: DataFrame, key: str, ts: str, order: str, value: str, ttl_seconds: int, keep_seconds: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """key, ts, order, answer (fetch, served, stale or failed), value, as_of for every request of a stream.

    Requests are taken in the order of ts and then order inside a batch; a later batch comes after an earlier one.
    ``keep_seconds`` limits how old a stale value may be, and frees the state of idle keys by timers on
    event time, once the watermark (``delay`` behind the latest request) has passed; without it every key keeps one value.
    """
    columns = [key, ts, order, value]
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"{key} {kinds[key]}, {ts} timestamp, {order} {kinds[order]}, answer string, {value} double, as_of timestamp"
    narrow = requests.select(key, ts, order, requests[value].cast("double").alias(value))
    if keep_seconds is not None:
        narrow = narrow.withWatermark(ts, delay)
    return narrow.groupBy(key).transformWithStateInPandas(TtlCache(columns, ttl_seconds, keep_seconds), schema, "Append", "None" if keep_seconds is None else "EventTime")


def ttl_stream(requests: DataFrame, out: str, key: str, ts: str, order: str, value: str, ttl_seconds: int, keep_seconds: int | None = None) -> StreamingQuery:
    """Answers of every batch appended to ``out/answers``; goes on from its checkpoint after a restart."""
    spark = requests.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (ttl_answers(requests, key, ts, order, value, ttl_seconds, keep_seconds).writeStream.outputMode("append").format("parquet")
                .option("path", f"{out}/answers").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    finally:
        spark.conf.set(PROVIDER, before)
