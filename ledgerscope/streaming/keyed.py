"""Keyed structuring alerts as a stateful processor with map state by time slot and event-time timers."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerscope.params import Params

#: Time slots in one window, and rows in one state value: a slot with more rows has several values.
SLOTS, PART = 120, 256

ALERT_SCHEMA = T.StructType([
    T.StructField("customer_id", T.StringType()), T.StructField("alert_time", T.TimestampType()),
    T.StructField("window_count", T.LongType()), T.StructField("transaction_id", T.StringType())])


class StructuringProcessor(StatefulProcessor):
    """Alerts of one customer's just-under rows; see ``jobs.structuring_state`` for the rule.

    State of a customer:
    - ``rows``: (slot, part) -> up to ``PART`` times and ids, in the order of arrival;
    - ``sizes``: slot -> number of rows;
    - ``progress``: the time up to which rows are judged, the last alert and the next timer.

    A slot is a ``SLOTS``-th of the window, so the far end of a row's window falls into one slot, whose rows are read; the
    slots between count as a whole. A timer wakes a customer when the watermark passes its next waiting row, or else when
    its oldest slot has left every future window and is removed. No value grows with the number of rows.
    """

    def __init__(self, params: Params):
        self.window = params.structuring_window_days * 86_400_000_000
        self.least = params.structuring_min_count
        self.slot = self.window // SLOTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slot long, part int", "times array<long>, ids array<string>")
        self.sizes = handle.getMapState("sizes", "slot long", "n long")
        self.progress = handle.getValueState("progress", "judged long, last_alert long, wake long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            times = pdf["timestamp"].to_numpy("datetime64[us]").astype("int64")
            ids = pdf["transaction_id"].to_numpy()
            slots = times // self.slot
            for slot in sorted(set(slots.tolist())):
                here = slots == slot
                self._append(int(slot), times[here].tolist(), ids[here].tolist())
            if len(times):
                earliest = min(int(times.min()), earliest if earliest is not None else int(times.min()))
        if earliest is not None:
            judged, last_alert, wake = self._state()
            self._wake_at(judged, last_alert, wake, self._timer(earliest), timerValues)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        judged, last_alert, _ = self._state()
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        sizes = {k[0]: v[0] for k, v in self.sizes.iterator()}
        alerts, last_alert = self._judge(sizes, judged, mark, last_alert)
        judged = mark if judged is None else max(judged, mark)
        for slot in [s for s in sizes if (s + 1) * self.slot <= judged - self.window]:
            for part in range(-(-sizes.pop(slot) // PART)):
                self.rows.removeKey((slot, part))
            self.sizes.removeKey((slot,))
        if sizes:
            waiting = self._first_after(sizes, judged)
            leave = (min(sizes) + 1) * self.slot + self.window
            self._wake_at(judged, last_alert, None, self._timer(waiting if waiting is not None else leave), timerValues)
        else:
            self.progress.clear()
        if alerts:
            yield pd.DataFrame([(key[0], pd.Timestamp(t, unit="us"), n, i) for t, n, i in alerts],
                               columns=["customer_id", "alert_time", "window_count", "transaction_id"])

    def _judge(self, sizes: dict[int, int], judged: int | None, mark: int, last_alert: int | None) -> tuple[list, int | None]:
        """Alerts of the rows after ``judged`` up to ``mark``; slots that cannot hold one are not read."""
        alerts = []
        for slot in sorted(sizes):
            last_time = (slot + 1) * self.slot - 1
            if slot * self.slot > mark:
                break
            if (judged is not None and last_time <= judged) or (last_alert is not None and last_alert > last_time - self.window):
                continue
            far = slot - SLOTS
            between = sum(n for s, n in sizes.items() if far < s < slot)
            if sizes.get(far, 0) + between + sizes[slot] < self.least:
                continue
            mine = self._read(slot, sizes[slot])
            times, old = [t for t, _ in mine], [t for t, _ in self._read(far, sizes.get(far, 0))]
            for t, i in mine:
                if t > mark:
                    break
                if (judged is not None and t <= judged) or (last_alert is not None and last_alert > t - self.window):
                    continue
                n = len(old) - bisect_right(old, t - self.window) + between + bisect_right(times, t)  # peers of one time count
                if n >= self.least:
                    last_alert = t
                    alerts.append((t, n, i))
        return alerts, last_alert

    def _append(self, slot: int, times: list[int], ids: list[str]) -> None:
        n = self.sizes.getValue((slot,))[0] if self.sizes.containsKey((slot,)) else 0
        part, done = n // PART, 0
        if n % PART:
            old_times, old_ids = (list(x) for x in self.rows.getValue((slot, part)))
            done = min(PART - len(old_times), len(times))
            self.rows.updateValue((slot, part), (old_times + times[:done], old_ids + ids[:done]))
            part += 1
        for a in range(done, len(times), PART):
            self.rows.updateValue((slot, part), (times[a:a + PART], ids[a:a + PART]))
            part += 1
        self.sizes.updateValue((slot,), (n + len(times),))

    def _read(self, slot: int, n: int) -> list[tuple[int, str]]:
        """(time, id) of the rows of one slot, in order."""
        found = []
        for part in range(-(-n // PART)):
            times, ids = self.rows.getValue((slot, part))
            found += zip([int(t) for t in times], ids)
        return sorted(found)

    def _first_after(self, sizes: dict[int, int], judged: int) -> int | None:
        for slot in sorted(sizes):
            if (slot + 1) * self.slot - 1 > judged:
                later = [t for t, _ in self._read(slot, sizes[slot]) if t > judged]
                if later:
                    return later[0]
        return None

    def _state(self) -> tuple[int | None, int | None, int | None]:
        return tuple(self.progress.get()) if self.progress.exists() else (None, None, None)

    @staticmethod
    def _timer(time_us: int) -> int:
        """A timer fires when the watermark is beyond it: the last millisecond before the one that passes the time."""
        return -(-time_us // 1000) - 1

    def _wake_at(self, judged: int | None, last_alert: int | None, wake: int | None, at: int, timerValues: Any) -> None:
        if judged is not None and at <= judged // 1000 - 1:
            at = judged // 1000
        if wake is None or at < wake:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at)
            wake = at
        self.progress.update((judged, last_alert, wake))
