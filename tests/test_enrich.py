from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_windows import at, end
from tidemark.operators import enrich
from tidemark.operators.repeat import fold_repeat, repeat, repeat_single


def screens(spark, *rows):
    return spark.createDataFrame([(at(t), s, p, n) for n, (t, s, p) in enumerate(rows)], "event_time timestamp_ntz, screen_id string, publication_id string, event_id long")


def publications(spark, *rows):
    return spark.createDataFrame([(at(t), "pub", v, n) for n, (t, v) in enumerate(rows, 100)], "event_time timestamp_ntz, publication_id string, version string, event_id long")


def ads(spark, *times):
    return spark.createDataFrame([(at(t), "ad", "s", "Unknown", n) for n, t in enumerate(times)], "event_time timestamp_ntz, ad_id string, screen_id string, action string, event_id long")


@pytest.mark.parametrize("screen,event,met,dead", [
    ("12:00:00", "12:00:01", [end("12:10")], []), ("12:00:01", "12:00:00", [end("12:10")], []), ("12:09:59", "12:10:00", [end("12:20")], []), ("12:00:01", "12:20:01", [], [end("12:30")]),
])
def test_repeater_join(spark, screen, event, met, dead):
    good, rest = enrich.enrich_by_repeater(ads(spark, event), screens(spark, (screen, "s", "p")))
    assert [r.event_time for r in good.collect()] == met and [r.event_time for r in rest.collect()] == dead


@pytest.mark.parametrize("pubs,screen,want", [
    ([("12:00", "v")], "13:00", "v"), ([("12:00", "v")], "11:59:59", "v"), ([("12:00:00", "first"), ("12:00:01", "second")], "13:00", "second"), ([("12:00:01", "second"), ("12:00:00", "first")], "13:00", "second"),
])
def test_latest(spark, pubs, screen, want):
    good, rest = enrich.enrich_by_latest(screens(spark, (screen, "s", "pub"), (screen, "lost", "none")), publications(spark, *pubs))
    assert [(r.screen_id, r.version, r.event_time) for r in good.collect()] == [("s", want, at(screen))]
    assert [r.screen_id for r in rest.collect()] == ["lost"]


@pytest.mark.parametrize("pubs,screen,met,dead", [
    ([("12:00", "v")], "13:00:00", ("v", "13:00:00"), None), ([("12:00", "v")], "11:59:59", ("v", "12:00:00"), None), ([("12:00", "v")], "10:59:59", None, "10:59:59"), ([("12:00", "v")], "13:00:01", None, "13:00:01"),
    ([("12:00:00", "first"), ("12:00:00", "second")], "13:00", ("second", "13:00:00"), None), ([("12:00:00", "first"), ("12:00:01", "second")], "13:00", ("second", "13:00:00"), None), ([("12:00:01", "second"), ("12:00:00", "first")], "13:00", ("second", "13:00:00"), None),
])
def test_lookup_cache(spark, pubs, screen, met, dead):
    good, rest = enrich.enrich_by_cache(screens(spark, (screen, "s", "pub")), publications(spark, *pubs))
    assert [(r.version, r.event_time) for r in good.collect()] == ([(met[0], at(met[1]))] if met else [])
    assert [r.event_time for r in rest.collect()] == ([at(dead)] if dead else [])


def fold_cache(rows, ttl):
    """(screen, version or None, time) by a plain fold over (time, id, is_left) rows in order."""
    held, seen, wait, latest, out = None, None, [], None, []
    for t, name, left in rows:
        if latest is not None and t > latest + ttl:
            out += [(w, None, latest) for w in wait]
            held, wait = None, []
        latest = t
        if not left:
            held = name
            out += [(w, held, t) for w in wait]
            wait = []
        elif held is None:
            wait.append(name)
        else:
            out.append((name, held, t))
    return sorted(out + [(w, None, latest) for w in wait], key=str)


def test_lookup_cache_is_the_fold(spark):
    import random

    r = random.Random(1)
    keys, base, left, right = {}, datetime(2024, 1, 1), [], []
    for k in range(200):
        for _ in range(r.randint(1, 9)):
            keys.setdefault(f"k{k}", []).append((r.randint(0, 60), len(left) + len(right), r.random() < 0.6))
            t, n, is_left = keys[f"k{k}"][-1]
            (left if is_left else right).append((base + timedelta(seconds=t), f"{n}", f"k{k}", n))
    ls = spark.createDataFrame(left, "event_time timestamp_ntz, screen_id string, publication_id string, event_id long")
    rs = spark.createDataFrame(right, "event_time timestamp_ntz, version string, publication_id string, event_id long")
    good, rest = enrich.enrich_by_cache(ls, rs, "10 seconds")
    got = {}
    for x in [*good.collect(), *rest.collect()]:
        got.setdefault(x.publication_id, []).append((x.screen_id, x.asDict().get("version"), int((x.event_time - base).total_seconds())))
    want = {k: fold_cache([(t, f"{n}", left_) for t, n, left_ in sorted(rows)], 10) for k, rows in keys.items()}
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 50), st.integers(0, 200))
def test_one_value_is_repeated_as_often_as_the_closed_form_says(interval, ttl):
    assert [t for t, _ in fold_repeat(iter([(7, "v")]), interval, ttl)] == [7 + k * interval for k in range(max(1, -(-ttl // interval)) + 1)]


def test_repeater_keeps_its_clock_and_takes_newer_values(spark):
    got = list(fold_repeat(iter([(0, "a"), (5, "b"), (10, "c"), (100, "d")]), 10, 15))
    assert got == [(0, "a"), (10, "c"), (20, "c"), (30, "c"), (100, "d"), (110, "d"), (120, "d")]
    df = screens(spark, ("12:00", "s", "p"), ("12:30", "t", "q"))
    a = repeat(df, "screen_id", "publication_id", "10 minutes", "25 minutes").collect()
    b = repeat_single(df.drop("event_id"), "10 minutes", "25 minutes").collect()
    assert sorted((r.screen_id, r.publication_id, r.event_time) for r in a) == sorted((r.screen_id, r.publication_id, r.event_time) for r in b) and len(a) == 8


def test_co_group(spark):
    both = enrich.co_group(screens(spark, ("12:00", "s", "pub"), ("12:01", "s", "x")), publications(spark, ("12:00", "v")), "publication_id")
    assert {r.publication_id: (len(r.left_rows), len(r.right_rows or [])) for r in both.collect()} == {"pub": (1, 1), "x": (1, 0)}
