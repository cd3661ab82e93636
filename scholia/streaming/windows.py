"""Keyed state of the exact rate audit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor


class WindowCounts(StatefulProcessor):
    """Counts in ``(at - seconds, at]`` for every time of a key, given when the watermark has passed it.

    The state has a row for each time: how many events, and whether it was answered.
    One timer stands at the earliest open time, or where none is open at the time at which
    the last answered one leaves every window, which empties the state of a silent key.
    """

    def __init__(self, seconds: int):
        self.width = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "at bigint", "events bigint, answered boolean")
        self.timer = handle.getValueState("timer", "millis bigint")

    def _wake_at(self, micros: int | None) -> None:
        """Moves the timer of the key."""
        at = None if micros is None else -(-micros // 1000)
        old = self.timer.get()[0] if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: Counter = Counter()
        for part in rows:
            new.update(part["micros"].value_counts().to_dict())
        for at, n in new.items():
            before = self.times.getValue((int(at),)) if self.times.containsKey((int(at),)) else (0, False)
            self.times.updateValue((int(at),), (before[0] + int(n), False))
        old = self.timer.get()[0] if self.timer.exists() else None
        first = min(new)
        if old is None or first < old * 1000:
            self._wake_at(int(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((at[0], value[0], value[1]) for at, value in self.times.iterator())
        at, n = (np.array([row[i] for row in held], np.int64) for i in (0, 1))
        total = np.concatenate(([0], np.cumsum(n)))
        inside = total[1:] - total[np.searchsorted(at, at - self.width, side="right")]
        ready = np.array([not row[2] for row in held], bool) & (at <= passed)
        # no later row can be at or before the watermark, so what lies a window before it is done with
        gone = at <= passed - self.width
        for i in np.flatnonzero(ready & ~gone):
            self.times.updateValue((int(at[i]),), (int(n[i]), True))
        for i in np.flatnonzero(gone):
            self.times.removeKey((int(at[i]),))
        waiting = at[at > passed]
        kept = at[~gone]
        self._wake_at(int(waiting[0]) if len(waiting) else int(kept[-1]) + self.width if len(kept) else None)
        if ready.any():
            yield pd.DataFrame({"key": key[0], "micros": at[ready], "events": n[ready], "in_window": inside[ready]})

    def close(self) -> None:
        pass
