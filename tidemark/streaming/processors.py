"""Stateful processors of the event-time operators for Structured Streaming.

Each keeps what one key needs and nothing more, and drops it when its time is over. Within a batch Spark hands a key's rows in any
order, so they are sorted by event time first; timers fire after the batch's rows, so every processor asks its own state, not the
timer, whether something is still alive. Times are milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.windows import CustomWindow

ON_TIME, LATE = "ON_TIME", "LATE"


class _Keyed(StatefulProcessor):
    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def timer(self, old: int | None, new: int | None) -> None:
        """A key has one timer: a new one takes the old one's place."""
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)


class LateFirings(_Keyed):
    """Counts of one (window, screen, ad): an on-time pane when the window has passed, then one pane for each batch with late rows.

    The stream's watermark lags by the allowed lateness L, so the window has passed once the watermark reaches its end - L, and Spark
    drops rows after its end by itself. ``mode``: capped or total.
    """

    STATE = "clicks long, impressions long, fired boolean, panes int"
    OUTPUT = "screen_id string, ad_id string, window_start long, window_end long, clicks int, impressions int, pane_timing string, pane_index int"

    def __init__(self, lateness: int, mode: str = "capped"):
        self.lateness, self.merge = lateness, max if mode == "capped" else int.__add__

    def _row(self, key: Any, s: tuple, timing: str) -> Row:
        return Row(screen_id=key[0], ad_id=key[1], window_start=key[2], window_end=key[3], clicks=int(s[0]), impressions=int(s[1]), pane_timing=timing, pane_index=int(s[3]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = tuple(self.state.get()) if self.state.exists() else (0, 0, False, 0)
        fresh = not self.state.exists()
        for r in rows:
            s = (self.merge(int(s[0]), int(r.clicks)), self.merge(int(s[1]), int(r.impressions)), s[2], s[3])
        mark = timerValues.getCurrentWatermarkInMs()
        due = key[3] - self.lateness
        if s[2] or (fresh and self.lateness and mark >= due):
            yield self._row(key, s, LATE)
            s = (s[0], s[1], True, s[3] + 1)
        if fresh:
            self.handle.registerTimer(max(due, 1))
            if self.lateness:
                self.handle.registerTimer(key[3])
        self.state.update(s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        s = tuple(self.state.get())
        if not s[2]:
            yield self._row(key, s, ON_TIME)
            s = (s[0], s[1], True, s[3] + 1)
            self.state.update(s)
        if timerValues.getCurrentWatermarkInMs() >= key[3]:
            self.state.clear()


class Repeater(_Keyed):
    """Re-emits a key's latest value every ``interval`` until ``ttl`` after it, on a clock that starts with its first value."""

    STATE = "value string, seen long, tick long"
    OUTPUT = "key string, value string, event_time timestamp"

    def __init__(self, interval: int, ttl: int):
        self.interval, self.ttl = interval, ttl

    @staticmethod
    def _row(key: Any, value: str, at: int) -> Row:
        from datetime import UTC, datetime

        return Row(key=key[0], value=value, event_time=datetime.fromtimestamp(at / 1000, UTC))

    def _ticks(self, key: Any, s: tuple, until: int, inclusive: bool) -> tuple[list[Row], tuple | None]:
        out, (value, seen, tick) = [], s
        while tick is not None and (tick <= until if inclusive else tick < until):
            out.append(self._row(key, value, tick))
            tick = tick + self.interval if tick < seen + self.ttl else None
        return out, None if tick is None else (value, seen, tick)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = tuple(self.state.get()) if self.state.exists() else None
        before = s[2] if s else None
        for r in sorted(rows, key=lambda r: (r.t, r.value)):
            if s is not None:
                out, s = self._ticks(key, s, r.t, False)
                yield from out
            if s is None:
                yield self._row(key, r.value, r.t)
                s = (r.value, r.t, r.t + self.interval)
            else:
                s = (r.value, r.t, s[2])
        self.timer(before, s[2])
        self.state.update(s)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.state.exists():
            return
        out, s = self._ticks(key, tuple(self.state.get()), timerValues.getCurrentWatermarkInMs(), True)
        yield from out
        if s is None:
            self.state.clear()
        else:
            self.state.update(s)
            self.handle.registerTimer(s[2])


class LookupCache(_Keyed):
    """Left rows wait for, or take, the latest lookup of their key; any row of the key extends its life by ``ttl``.

    Input rows: is_left, payload, t. Output: payload, lookup (null in the dead letters) and the time of the result.
    """

    STATE = "lookup string, lookup_t long, latest long"
    OUTPUT = "key string, payload string, lookup string, event_ms long"

    def __init__(self, ttl: int):
        if ttl <= 0:
            raise ValueError("ttl must be positive")
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "payload string")

    def _expire(self, key: Any, latest: int) -> Iterator[Row]:
        for w in self.waiting.get():
            yield Row(key=key[0], payload=w[0], lookup=None, event_ms=latest)
        self.waiting.clear()
        self.state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lookup, lookup_t, latest = tuple(self.state.get()) if self.state.exists() else (None, None, None)
        before = None if latest is None else latest + self.ttl + 1
        for r in sorted(rows, key=lambda r: (r.t, r.is_left, r.payload)):
            if latest is not None and r.t > latest + self.ttl:
                yield from self._expire(key, latest)
                lookup = lookup_t = latest = None
            latest = r.t if latest is None else max(latest, r.t)
            if r.is_left and lookup is None:
                self.waiting.appendValue((r.payload,))
            elif r.is_left:
                yield Row(key=key[0], payload=r.payload, lookup=lookup, event_ms=r.t)
            else:
                if lookup is None or r.t >= lookup_t:
                    lookup, lookup_t = r.payload, r.t
                for w in self.waiting.get():
                    yield Row(key=key[0], payload=w[0], lookup=lookup, event_ms=r.t)
                self.waiting.clear()
        self.timer(before, latest + self.ttl + 1)
        self.state.update((lookup, lookup_t, latest))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.state.exists():
            latest = self.state.get()[2]
            if timerValues.getCurrentWatermarkInMs() > latest + self.ttl:
                yield from self._expire(key, latest)


class CustomWindows(_Keyed):
    """The custom window of one (screen, ad) under the stream's watermark: fires when that passes its end, merges until ``lateness``
    later, and fires again if merged."""

    STATE = "start long, last_start long, end long, click boolean, clicks int, impressions int, fired boolean"
    OUTPUT = "screen_id string, ad_id string, clicks int, impressions int, start_ms long, end_ms long"

    def __init__(self, to_click: int, to_impression: int, lateness: int):
        self.to_click, self.to_impression, self.lateness = to_click, to_impression, lateness

    @staticmethod
    def _row(key: Any, w: CustomWindow) -> Row:
        return Row(screen_id=key[0], ad_id=key[1], clicks=int(w.clicks), impressions=int(w.impressions), start_ms=w.start, end_ms=w.end)

    def _load(self) -> CustomWindow | None:
        if not self.state.exists():
            return None
        w = CustomWindow(0, False, 1)
        for name, value in zip(CustomWindow.__slots__, tuple(self.state.get()), strict=True):
            setattr(w, name, value)
        return w

    def _passed(self, timerValues: Any) -> int:
        """How far the events have come: the stream's watermark lags by the allowed lateness."""
        return timerValues.getCurrentWatermarkInMs() + self.lateness

    def _due(self, w: CustomWindow) -> int:
        return max(1, w.end + 1 if w.fired else w.end + 1 - self.lateness)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        mark = self._passed(timerValues)
        w = self._load()
        before = None if w is None else self._due(w)
        for r in sorted(rows, key=lambda r: (r.t, r.click)):
            length = self.to_impression if r.click else self.to_click
            if w is not None and mark > w.end and not w.fired:
                yield self._row(key, w)
                w.fired = True
            if w is None or mark > w.end + self.lateness:
                w = CustomWindow(r.t, bool(r.click), length)
            else:
                w.merge(r.t, bool(r.click), length)
        self.timer(before, self._due(w))
        self.state.update(tuple(getattr(w, c) for c in CustomWindow.__slots__))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        w = self._load()
        if w is None:
            return
        mark = self._passed(timerValues)
        if mark > w.end and not w.fired:
            yield self._row(key, w)
            w.fired = True
            if mark <= w.end + self.lateness:
                self.handle.registerTimer(self._due(w))
        if mark > w.end + self.lateness:
            self.state.clear()
        else:
            self.state.update(tuple(getattr(w, c) for c in CustomWindow.__slots__))
