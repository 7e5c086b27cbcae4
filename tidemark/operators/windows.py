"""Click-through counts in fixed, sliding and event-driven custom windows.

Results carry window_start, window_end and event_time, the window's last instant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ctr import capped, to_ctr, total
from tidemark.model import CLICK, IMPRESSION, millis, plus


def bounds(window: str = "window") -> list[Column]:
    end = F.col(f"{window}.end")
    return [F.col(f"{window}.start").alias("window_start"), end.alias("window_end"), plus(end, -1).alias("event_time")]


def fixed_window_ctr(events: DataFrame, duration: str) -> DataFrame:
    """Per fixed window, screen and ad: whether there was a click and an impression."""
    grouped = to_ctr(events).groupBy(F.window("event_time", duration), "screen_id", "ad_id").agg(capped("clicks"), capped("impressions"))
    return grouped.select("screen_id", "ad_id", "clicks", "impressions", *bounds())


def sliding_window_ctr(ctrs: DataFrame, duration: str, period: str, strict: bool = False) -> DataFrame:
    """Sums of per-screen counts in sliding windows, each result placed in the fixed window of ``period`` that holds its last instant.

    Where windows start and end on whole periods, counts are first added up by period, so the copies that overlapping windows take
    are of sums and not of rows. ``strict``: one screen with two ads in a window is an error, else they are counted apart.
    """
    if millis(duration) % millis(period) == 0:
        ctrs = ctrs.groupBy(F.window("event_time", period), "screen_id", "ad_id").agg(total("clicks"), total("impressions")).withColumn("event_time", F.col("window.start"))
    window = F.window("event_time", duration, period)
    if strict:
        one_ad = F.assert_true(F.min("ad_id") == F.max("ad_id"), F.lit("a screen has two ads in one window"))
        grouped = ctrs.groupBy(window, "screen_id").agg(F.min("ad_id").alias("ad_id"), total("clicks"), total("impressions"), one_ad.alias("_checked"))
        grouped = grouped.where(F.col("_checked").isNull()).drop("_checked")
    else:
        grouped = ctrs.groupBy(window, "screen_id", "ad_id").agg(total("clicks"), total("impressions"))
    out = grouped.select("screen_id", "ad_id", "clicks", "impressions", *bounds())
    pane = F.window("event_time", period)
    return out.select("*", pane["start"].alias("pane_start"), pane["end"].alias("pane_end"))


def _acted(events: DataFrame, strict: bool) -> DataFrame:
    """Only clicks and impressions have a custom window. ``strict``: others are an error."""
    known = F.col("action").isin(CLICK, IMPRESSION)
    if strict:
        wrong = F.raise_error(F.concat(F.lit("no window for action "), F.coalesce("action", F.lit("null"))))
        events = events.withColumn("action", F.when(known, F.col("action")).otherwise(wrong.cast("string")))
        return events
    return events.where(known)


def custom_window_ctr(events: DataFrame, impression_to_click: str = "10 minutes", click_to_impression: str = "1 minute", strict: bool = False) -> DataFrame:
    """One custom window per screen and ad, all input seen before the watermark moves.

    An impression opens [t, t + impression_to_click), a click [t, t + click_to_impression). All windows of a key merge, in order of
    time: a click closes the merged one at its latest start. Equal windows fall together first, so only more than one distinct
    (time, action) counts as a merge.
    """
    e = to_ctr(_acted(events, strict))
    moment = F.struct("event_time", "clicks")
    grouped = e.groupBy("screen_id", "ad_id").agg(capped("clicks"), capped("impressions"), F.min("event_time").alias("window_start"), F.max("event_time").alias("_last"), F.min(moment).alias("_a"), F.max(moment).alias("_b"))
    end = F.when(F.col("clicks") == 0, plus("_last", millis(impression_to_click) - 1)).when(F.col("_a") == F.col("_b"), plus("_last", millis(click_to_impression) - 1)).otherwise(F.col("_last"))
    return grouped.select("screen_id", "ad_id", "clicks", "impressions", "window_start", end.alias("event_time"))


class CustomWindow:
    """The held custom window of one key, for a watermark that moves with the events. Times are in milliseconds."""

    __slots__ = ("start", "last_start", "end", "click", "clicks", "impressions", "fired")

    def __init__(self, t: int, click: bool, length: int):
        self.start = self.last_start = t
        self.end, self.click = t + length - 1, click
        self.clicks, self.impressions, self.fired = int(click), int(not click), False

    def merge(self, t: int, click: bool, length: int) -> None:
        if (t, t + length - 1, click) == (self.start, self.end, self.click):
            return
        latest_start = max(self.last_start, t)
        self.start, self.last_start, self.click = min(self.start, t), latest_start, self.click or click
        self.end = latest_start if self.click else max(self.end, t + length - 1)
        self.clicks, self.impressions, self.fired = max(self.clicks, int(click)), max(self.impressions, int(not click)), False


def fold_custom(moments: Iterator[tuple[int, bool]], to_click: int, to_impression: int, lateness: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, clicks, impressions) of each firing, for (time, is click) in order of time with the watermark at each event.

    A window fires when the watermark has passed its end, takes part in merges until ``lateness`` later, and fires again if merged.
    """
    held: CustomWindow | None = None
    for t, click in moments:
        length = to_impression if click else to_click
        if held is not None and held.end < t and not held.fired:
            yield held.start, held.end, held.clicks, held.impressions
            held.fired = True
        if held is None or held.end + lateness < t:
            held = CustomWindow(t, click, length)
        else:
            held.merge(t, click, length)
    if held is not None and not held.fired:
        yield held.start, held.end, held.clicks, held.impressions


def keyed_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(key, its rows) of batches sorted by key; rows stream, so a hot key never has to fit in memory. Consume in order."""
    from itertools import groupby

    rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
    return groupby(rows, key=lambda r: r[: len(keys)])


def custom_window_ctr_live(events: DataFrame, impression_to_click: str = "10 minutes", click_to_impression: str = "1 minute", lateness: str = "0 minutes", strict: bool = False, tie: str = "event_id") -> DataFrame:
    """Custom windows under a watermark that follows the events of each key, in (event_time, ``tie``) order.

    The fold is sequential, so it runs over partitions sorted by key and time and holds one window at a time.
    """
    e = _acted(events, strict).select("screen_id", "ad_id", F.unix_millis(F.col("event_time").cast("timestamp")).alias("t"), (F.col("action") == CLICK).alias("click"), F.col(tie).alias("tie"))
    args = millis(impression_to_click), millis(click_to_impression), millis(lateness)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, rows in keyed_runs(batches, ["screen_id", "ad_id"]):
            for start, end, clicks, impressions in fold_custom(((r[2], bool(r[3])) for r in rows), *args):
                out.append((*key, clicks, impressions, start, end))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        yield pd.DataFrame(out, columns=names)

    names = ["screen_id", "ad_id", "clicks", "impressions", "start_ms", "end_ms"]
    ordered = e.repartition("screen_id", "ad_id").sortWithinPartitions("screen_id", "ad_id", "t", "tie")
    done = ordered.mapInPandas(run, "screen_id string, ad_id string, clicks int, impressions int, start_ms long, end_ms long")
    at = lambda c: F.timestamp_millis(c).cast("timestamp_ntz")
    return done.select("screen_id", "ad_id", "clicks", "impressions", at(F.col("start_ms")).alias("window_start"), at(F.col("end_ms")).alias("event_time"))
