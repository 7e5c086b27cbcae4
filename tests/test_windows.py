"""Scenarios on one day: times of day as strings, actions I and C."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import ctr
from tidemark.operators import panes, windows
from tidemark.operators.windows import fold_custom

ACTIONS = {"I": "Impression", "C": "Click", "U": "Unknown"}
SCHEMA = "event_time timestamp_ntz, ad_id string, screen_id string, action string, event_id long"


def at(t, before=False):
    h, m, *s = map(int, t.split(":"))
    out = datetime(1970, 1, 1, h, m, s[0] if s else 0)
    return out - timedelta(milliseconds=1) if before else out


def end(t):
    return at(t, True)


def events(spark, *rows):
    return spark.createDataFrame([(at(t), "ad", "screen", ACTIONS[a], n) for n, (a, t) in enumerate(rows)], SCHEMA)


def found(df):
    return sorted((r.event_time, r.clicks, r.impressions) for r in df.collect())


@pytest.mark.parametrize("rows,want", [
    ([("I", "12:00:01"), ("C", "12:00:02")], [(end("12:10"), 1, 1)]),
    ([("C", "12:00:01"), ("I", "12:00:02")], [(end("12:10"), 1, 1)]),
    ([("I", "12:00:01"), ("I", "12:00:01"), ("C", "12:00:02")], [(end("12:10"), 1, 1)]),
    ([("I", "12:00:01"), ("C", "12:00:02"), ("C", "12:00:02")], [(end("12:10"), 1, 1)]),
    ([("I", "12:00:01"), ("C", "12:10:01")], [(end("12:10"), 0, 1), (end("12:20"), 1, 0)]),
    ([("I", "12:09:59"), ("C", "12:10:00")], [(end("12:10"), 0, 1), (end("12:20"), 1, 0)]),
    ([("U", "12:00:01")], [(end("12:10"), 0, 0)]),
])
def test_fixed(spark, rows, want):
    assert found(windows.fixed_window_ctr(events(spark, *rows), "10 minutes")) == want


def arrived(df, marks):
    """marks: the watermark before each row's batch, or None."""
    spark = df.sparkSession
    m = spark.createDataFrame([(n, b, at(w) if w else None) for n, (b, w) in enumerate(marks)], "event_id long, batch_id int, watermark timestamp_ntz")
    return df.join(m, "event_id")


def pane_rows(df):
    return sorted((r.event_time, r.pane_index, r.pane_timing, r.clicks, r.impressions) for r in df.collect())


@pytest.mark.parametrize("rows,marks,lateness,want", [
    ([("I", "12:00:01"), ("C", "12:09:59")], [(0, None), (1, "12:10")], "0 minutes", [(end("12:10"), 0, "ON_TIME", 0, 1)]),
    ([("I", "12:00:01"), ("C", "12:09:59")], [(0, None), (1, "12:10")], "1 minute", [(end("12:10"), 0, "ON_TIME", 0, 1), (end("12:10"), 1, "LATE", 1, 1)]),
    ([("C", "12:09:59"), ("I", "12:09:59")], [(1, "12:10"), (1, "12:10")], "1 minute", [(end("12:10"), 0, "LATE", 1, 1)]),
    ([("C", "12:09:59"), ("I", "12:09:59")], [(1, "12:12"), (1, "12:12")], "1 minute", []),
])
def test_fixed_panes(spark, rows, marks, lateness, want):
    assert pane_rows(panes.fixed_window_panes(arrived(events(spark, *rows), marks), "10 minutes", lateness)) == want


def counts(spark, *rows):
    return spark.createDataFrame([(at(t), "screen", "ad", c, i, n) for n, (t, c, i) in enumerate(rows)], "event_time timestamp_ntz, screen_id string, ad_id string, clicks int, impressions int, event_id long")


@pytest.mark.parametrize("rows,want", [
    ([("12:00:01", 1, 1)], [(end("12:10"), 1, 1), (end("12:20"), 1, 1)]),
    ([("12:00:01", 1, 1), ("12:10:01", 0, 1)], [(end("12:10"), 1, 1), (end("12:20"), 1, 2), (end("12:30"), 0, 1)]),
])
def test_sliding(spark, rows, want):
    got = windows.sliding_window_ctr(counts(spark, *rows), "20 minutes", "10 minutes")
    assert found(got) == want
    assert all(r.pane_end - timedelta(milliseconds=1) == r.event_time for r in got.collect())


def test_sliding_panes(spark):
    rows = arrived(counts(spark, ("12:00:01", 1, 1), ("12:05:01", 0, 1)), [(0, None), (1, "12:10")])
    got = pane_rows(panes.sliding_window_panes(rows, "20 minutes", "10 minutes", "5 minutes"))
    assert got == [(end("12:10"), 0, "ON_TIME", 1, 1), (end("12:10"), 1, "LATE", 1, 2), (end("12:20"), 0, "ON_TIME", 1, 2)]


def test_sliding_with_odd_period_and_two_ads(spark):
    df = counts(spark, ("12:00:01", 1, 1))
    assert len(found(windows.sliding_window_ctr(df, "25 minutes", "10 minutes"))) in (2, 3)
    two = df.union(df.withColumn("ad_id", F.lit("other")))
    assert len(found(windows.sliding_window_ctr(two, "20 minutes", "10 minutes"))) == 4
    with pytest.raises(PySparkException, match="two ads"):
        windows.sliding_window_ctr(two, "20 minutes", "10 minutes", strict=True).collect()
    assert len(found(windows.sliding_window_ctr(df, "20 minutes", "10 minutes", strict=True))) == 2


@pytest.mark.parametrize("rows,want", [
    ([("I", "12:00:00"), ("C", "12:00:01")], [(at("12:00:01"), 1, 1)]),
    ([("C", "12:00:00"), ("I", "12:00:01")], [(at("12:00:01"), 1, 1)]),
    ([("C", "12:00"), ("I", "12:02")], [(at("12:02:00"), 1, 1)]),
    ([("I", "12:00")], [(end("12:10"), 0, 1)]), ([("C", "12:00"), ("C", "12:00")], [(end("12:01"), 1, 0)]),
])
def test_custom(spark, rows, want):
    assert found(windows.custom_window_ctr(events(spark, *rows))) == want


@pytest.mark.parametrize("rows,lateness,want", [
    ([("I", "12:00:00"), ("C", "12:00:01")], "0 minutes", [(at("12:00:01"), 1, 1)]),
    ([("I", "12:00"), ("C", "12:11")], "0 minutes", [(end("12:10"), 0, 1), (end("12:12"), 1, 0)]),
    ([("I", "12:00"), ("C", "12:10:59")], "1 minute", [(end("12:10"), 0, 1), (at("12:10:59"), 1, 1)]),
    ([("C", "12:00"), ("I", "12:02")], "0 minutes", [(end("12:01"), 1, 0), (end("12:12"), 0, 1)]),
    ([("U", "12:00")], "0 minutes", []),
])
def test_custom_live(spark, rows, lateness, want):
    assert found(windows.custom_window_ctr_live(events(spark, *rows), lateness=lateness)) == want


def test_unknown_actions_in_strict_mode(spark):
    with pytest.raises(PySparkException, match="no window for action"):
        windows.custom_window_ctr(events(spark, ("U", "12:00")), strict=True).collect()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), min_size=1, max_size=12))
def test_fold_without_expiry_is_the_closed_form(moments):
    moments = sorted(moments)
    got = list(fold_custom(iter(moments), 10**6, 10**6, 10**9))[-1:]
    last, click = max(t for t, _ in moments), any(c for _, c in moments)
    want = last + 10**6 - 1 if not click or len(set(moments)) == 1 else last
    assert got == [(moments[0][0], want, int(click), int(not all(c for _, c in moments)))]


def test_ratio_and_instants(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 1)], "clicks int, impressions int")
    assert [r[0] for r in df.select(ctr.ratio()).collect()] == [0.5, None, 0.0]
    t = spark.createDataFrame([("a", datetime(1960, 1, 1)), ("b", datetime(2000, 1, 1)), ("c", None)], "k string, t timestamp_ntz")
    assert {r.k: r.m.year for r in t.groupBy("k").agg(ctr.max_instant("t").alias("m")).collect()} == {"a": 1970, "b": 2000, "c": 1970}
