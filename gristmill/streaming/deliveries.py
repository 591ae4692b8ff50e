"""Stateful streams: deliveries accepted once within a time to live, bounded memories of keys, steps of counters.

State goes when it can't matter any more: by a timer in event time, or by a bound on what is held. What comes later than the watermark
may be dropped. :func:`dedupe_remembered` and :func:`counter_steps` need the state store of RocksDB
(``spark.sql.streaming.stateStore.providerClass``), as Spark's ``transformWithState`` does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gristmill.operators.activity import Remembered

ACCEPTED = "key string, at long"


def _accepting(ttl_seconds: int):
    def fold(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (last,) = state.get if state.exists else (None,)
        kept = []
        for at in sorted(x for part in parts for x in part["at"].tolist()):
            if last is None or at - last > ttl_seconds:
                kept.append(at)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl_seconds + 1) * 1_000, state.getCurrentWatermarkMs() + 1))
        if kept:
            yield pd.DataFrame({"key": [key[0]] * len(kept), "at": kept})

    return fold


def dedupe(deliveries: DataFrame, ttl_seconds: int = 3600, lateness: str = "0 seconds") -> DataFrame:
    """Deliveries (key string, at in whole seconds) that aren't repeats of one accepted in the ``ttl_seconds`` before.

    The time to live runs from the last accepted delivery, and a key's one number of state goes when the watermark has passed it. Within a
    micro-batch deliveries are sorted; over micro-batches those of one key come in order but for ``lateness``. Rows without a time go.
    """
    timed = deliveries.where("at IS NOT NULL").select("key", "at").withColumn("ts", F.timestamp_seconds(F.col("at") + 1)).withWatermark("ts", lateness)  # a watermark begins at 0
    return timed.groupBy("key").applyInPandasWithState(_accepting(ttl_seconds), ACCEPTED, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def scheduled_once(triggers: DataFrame, delay_seconds: int = 30) -> DataFrame:
    """Triggers (key, at) that schedule something: one that finds its key scheduled leaves the timer as it is."""
    return dedupe(triggers, delay_seconds)


class Remembering(StatefulProcessor):
    """Holds the keys that a scope accepted last, as many as its memory takes."""

    def __init__(self, ttl_seconds: int, capacity: int):
        self.ttl, self.capacity = ttl_seconds, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getListState("seen", "key string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        memory = Remembered(self.ttl, self.capacity, [(k, at) for k, at in self.seen.get()] if self.seen.exists() else [])
        new = sorted((int(at), k) for part in rows for k, at in zip(part["key"], part["at"], strict=True))
        kept = [(key[0], k, at) for at, k in new if memory.accepts(k, at)]
        self.seen.clear()
        if memory.held:
            self.seen.put(list(memory.held.items()))
        if kept:
            yield pd.DataFrame(kept, columns=["scope", "key", "at"])

    def close(self) -> None:
        pass


def dedupe_remembered(deliveries: DataFrame, ttl_seconds: int = 3600, capacity: int = 1_000) -> DataFrame:
    """:func:`gristmill.operators.activity.remembered_deliveries` as a stream of deliveries (scope, key, at): at most ``capacity`` keys of state a scope."""
    whole = deliveries.where("at IS NOT NULL AND key IS NOT NULL").select("scope", "key", "at")
    return whole.groupBy("scope").transformWithStateInPandas(Remembering(ttl_seconds, capacity), "scope string, key string, at long", "append", "None")


class Stepping(StatefulProcessor):
    """Holds the last sample of a series, until the series has been silent for long."""

    def __init__(self, silence_seconds: int):
        self.silence = silence_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "value"], kind="stable")
        before = self.last.get()[0] if self.last.exists() else None
        steps = []
        for value in new["value"].tolist():
            steps.append(0.0 if before is None else value if value < before else value - before)
            before = value
        self.last.update((before,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(new["ts"].max().timestamp() + self.silence) * 1_000)
        yield pd.DataFrame({"series": [key[0]] * len(new), "ts": new["ts"].to_numpy(), "grown": steps})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def counter_steps(samples: DataFrame, lateness: str = "1 minute", silence_seconds: int = 86_400) -> DataFrame:
    """series, ts, grown: what each sample (series string, ts, value) of a cumulative counter adds, a drop taken as a reset; nothing for a series' first.

    Sums of ``grown`` over windows are the increases of :func:`gristmill.operators.counters.increases`. A series that was silent for
    ``silence_seconds`` begins anew.
    """
    timed = samples.where("ts IS NOT NULL AND value IS NOT NULL").select("series", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", lateness)
    return timed.groupBy("series").transformWithStateInPandas(Stepping(silence_seconds), "series string, ts timestamp, grown double", "append", "EventTime")
