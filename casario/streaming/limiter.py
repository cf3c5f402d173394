"""A sliding-window limiter over events: admission depends on the admissions before.

Both forms admit an event while fewer than ``most`` events of its key were admitted within the last ``seconds``; refused events leave
no trace. They agree event by event: the stream holds events back until the watermark has passed them and admits them in order
of time, whatever order, trigger or Arrow batch they came in. An event later than the watermark is dropped, as in any Spark
stream. Events without a time are refused.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

#: Held events in one entry of a key's state.
CHUNK = 65_536


class Window:
    """Admits while fewer than `most` events were admitted within the last `span` microseconds; refused events leave no trace."""

    def __init__(self, most: int, span: int, admitted=()):
        self.most, self.span, self.times = most, span, deque(admitted)

    def admits(self, at: int) -> bool:
        while self.times and self.times[0] <= at - self.span:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(at)
        return True


def _micros(time: str):
    return F.unix_micros(F.col(time).cast("timestamp"))


def admitted(events: DataFrame, key: str, time: str, most: int, seconds: float) -> DataFrame:
    """events with admitido, in order of time.

    Batches by key: keys share a hashed partition, which is sorted and streamed; only `most` times are held, so a hot
    key takes a long task but no memory. Its events can't be split, as each admission depends on the ones before.
    """
    span = round(seconds * 1e6)
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.withColumns({"_t": F.coalesce(_micros(time), F.lit(0)), "_known": F.col(time).isNotNull()}).repartition(n, key).sortWithinPartitions(key, "_known", "_t", *[c for c in events.columns if c not in (key, time)][:1])

    def run(batches):
        now, window = None, None
        for b in batches:
            flags = []
            for k, t, known in zip(b[key], b["_t"], b["_known"], strict=True):
                if window is None or k != now:
                    now, window = k, Window(most, span)
                flags.append(known and window.admits(t))
            yield b.drop(columns=["_t", "_known"]).assign(admitido=flags)

    return rows.mapInPandas(run, T.StructType([*events.schema.fields, T.StructField("admitido", T.BooleanType())]))


class Limiter(StatefulProcessor):
    """The state of a key: events that the watermark hasn't passed yet, admitted times that still count, and one timer.

    The timer is due at the earliest held event; without held events, when the last admission stops counting: then the key's state goes.
    """

    def __init__(self, key: str, most: int, span: int):
        self.key, self.most, self.span = key, most, span

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "times binary")
        self.past = handle.getValueState("past", "times binary")
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int | None) -> None:
        """One timer at most, in milliseconds."""
        now = self.due.get()[0] if self.due.exists() else None
        if now == at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if at is None:
            self.due.clear()
        else:
            self.handle.registerTimer(at)
            self.due.update((at,))

    def _frame(self, key, times, flags) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(times), "micros": pd.array(times, "Int64"), "admitido": flags})

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for b in rows:
            known = b["micros"].notna().to_numpy()
            if not known.all():
                yield self._frame(key, [None] * int((~known).sum()), [False] * int((~known).sum()))
            times = b["micros"][known].to_numpy(dtype=np.int64)
            for a in range(0, len(times), CHUNK):
                self.held.appendValue((times[a : a + CHUNK].tobytes(),))
            if len(times):
                first = int(times.min()) if first is None else min(first, int(times.min()))
        if first is not None:
            at = -(-first // 1000)
            # A timer that is due earlier already stands for events that are held, or for the end of the key's state, which looks again.
            self._wake(min(at, self.due.get()[0]) if self.due.exists() else at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.sort(np.concatenate([np.empty(0, np.int64), *(np.frombuffer(c[0], np.int64) for c in self.held.get())]))
        ready, rest = held[held <= passed], held[held > passed]
        window = Window(self.most, self.span, np.frombuffer(self.past.get()[0], np.int64).tolist() if self.past.exists() else ())
        flags = [window.admits(t) for t in ready.tolist()]
        if len(ready):
            yield self._frame(key, ready, flags)
            self.held.clear()
            for a in range(0, len(rest), CHUNK):
                self.held.appendValue((rest[a : a + CHUNK].tobytes(),))
        while window.times and window.times[0] <= passed - self.span:
            window.times.popleft()
        if window.times:
            self.past.update((np.array(window.times, np.int64).tobytes(),))
        else:
            self.past.clear()
        self._wake(-(-int(rest[0]) // 1000) if len(rest) else -(-(window.times[-1] + self.span) // 1000) if window.times else None)

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, key: str, time: str, most: int, seconds: float, lateness: str = "10 seconds") -> DataFrame:
    """The same on a stream: key, _t (microseconds) and admitido of each event, once the watermark (``lateness`` behind the latest event) has passed it.

    Needs the state store on RocksDB (spark.sql.streaming.stateStore.providerClass), as all streams with timers do.
    """
    span, kind = round(seconds * 1e6), events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key), F.col(time).cast("timestamp").alias("event_time"), _micros(time).alias("micros")).withWatermark("event_time", lateness)
    out = rows.groupBy(key).transformWithStateInPandas(Limiter(key, most, span), f"`{key}` {kind}, micros long, admitido boolean", "append", "eventTime")
    return out.withColumnRenamed("micros", "_t")
