"""Each stateful operator as a stream. A far-off key's row after the data moves the watermark on; its own results are left out."""

from datetime import UTC, datetime, timedelta

import pytest

from tidemark.streaming import streams as S

AD = "event_time timestamp, ad_id string, screen_id string, action string"


def at(t):
    h, m, *s = map(int, t.split(":"))
    return datetime(2024, 1, 1, h, m, s[0] if s else 0, tzinfo=UTC)


@pytest.fixture
def run(spark, tmp_path):
    S.use_rocksdb(spark)
    n = [0]

    def go(schema, batches, build):
        n[0] += 1
        t = S.TestStream(spark, str(tmp_path / f"in{n[0]}"), spark.createDataFrame([], schema).schema)
        for b in batches:
            t.add(*b)
        return t.run(build(t.stream()), f"out_{tmp_path.name.replace('-', '_')}_{n[0]}", str(tmp_path / f"ck{n[0]}"))

    return go


def naive(t):
    return t.replace(tzinfo=None) if t.tzinfo else t


def ev(a, t, key="s"):
    return (at(t), "ad", key, {"I": "Impression", "C": "Click"}[a])


BEAT = [[ev("I", "20:00", "beat")], [ev("I", "20:30", "beat")], [ev("I", "21:00", "beat")]]


def own(rows, *cols):
    return sorted(tuple(naive(r[c]) if isinstance(r[c], datetime) else r[c] for c in cols) for r in rows if r.screen_id == "s")


def day(t, ms=0):
    return naive(at(t)) + timedelta(milliseconds=ms)


def test_fixed_windows_append(run):
    rows = run(AD, [[ev("I", "12:00:01"), ev("C", "12:00:02")], [ev("I", "12:11")], *BEAT], lambda s: S.fixed_window_ctr(s, "10 minutes"))
    assert own(rows, "event_time", "clicks", "impressions") == [(day("12:10", -1), 1, 1), (day("12:20", -1), 0, 1)]


def test_on_time_and_late_panes(run):
    batches = [[ev("I", "12:00:01")], [ev("I", "12:10:30", "beat")], [ev("I", "12:10:31", "beat")], [ev("C", "12:09:59")], *BEAT]
    rows = run(AD, batches, lambda s: S.fixed_window_panes(s, "10 minutes", "1 minute"))
    assert own(rows, "event_time", "pane_index", "pane_timing", "clicks", "impressions") == [(day("12:10", -1), 0, "ON_TIME", 0, 1), (day("12:10", -1), 1, "LATE", 1, 1)]


def test_custom_windows_live(run):
    batches = [[ev("I", "12:00")], [ev("I", "12:10:30", "beat")], [ev("I", "12:10:31", "beat")], [ev("C", "12:11")], *BEAT]
    rows = run(AD, batches, lambda s: S.custom_window_ctr(s))
    assert own(rows, "event_time", "clicks", "impressions") == [(day("12:10", -1), 0, 1), (day("12:12", -1), 1, 0)]
    late = run(AD, batches, lambda s: S.custom_window_ctr(s, lateness="1 minute"))
    assert own(late, "event_time", "clicks", "impressions") == [(day("12:10", -1), 0, 1), (day("12:11"), 1, 1)]
    near = run(AD, [[ev("I", "12:00:00"), ev("C", "12:00:01")], *BEAT], lambda s: S.custom_window_ctr(s))
    assert own(near, "event_time", "clicks", "impressions") == [(day("12:00:01"), 1, 1)]


def test_repeater(run):
    schema = "event_time timestamp, screen_id string, publication_id string"
    batches = [[(at("12:00"), "s", "a")], [(at("12:05"), "s", "b")], [(at("20:00"), "beat", "x")], [(at("20:30"), "beat", "x")]]
    rows = run(schema, batches, lambda s: S.repeat(s, "screen_id", "publication_id", "10 minutes", "10 minutes"))
    assert own(rows, "event_time", "publication_id") == [(day("12:00"), "a"), (day("12:10"), "b"), (day("12:20"), "b")]


def test_lookup_cache(run, spark):
    schema = "event_time timestamp, publication_id string, screen_id string, version string"
    batches = [
        [(at("10:59:59"), "p", "expired", None)], [(at("11:59:59"), "p", "waits", None)], [(at("12:00"), "p", None, "v1")], [(at("12:30"), "p", "cached", None)], [(at("12:31"), "p", None, "v2")],
        [(at("13:31"), "p", "last", None)], [(at("15:00"), "p", "late", None)], [(at("20:00"), "beat", "x", None)], [(at("20:30"), "beat", "x", None)],
    ]

    def build(s):
        return S.enrich_by_cache(s.where("screen_id is not null"), s.where("version is not null"), "1 hour")

    rows = run(schema, batches, build)
    got = sorted((r.screen_id, r.version, naive(r.event_time)) for r in rows if r.publication_id == "p")
    assert got == [
        ("cached", "v1", day("12:30")), ("expired", "v1", day("12:00")), ("last", "v2", day("13:31")), ("late", None, day("15:00")), ("waits", "v1", day("12:00")),
    ]


def test_latest_version(run, spark):
    pubs = spark.createDataFrame([(at("12:00"), "p", "v1", 1), (at("12:01"), "p", "v2", 2)], "event_time timestamp, publication_id string, version string, event_id long")
    rows = run("event_time timestamp, screen_id string, publication_id string", [[(at("11:00"), "s", "p"), (at("11:01"), "t", "q")]], lambda s: S.enrich_by_latest(s, pubs))
    assert sorted((r.screen_id, r.version) for r in rows) == [("s", "v2"), ("t", None)]


def test_sliding_panes(run):
    schema = "event_time timestamp, screen_id string, ad_id string, clicks int, impressions int"
    rows = run(schema, [[(at("12:00:01"), "s", "ad", 1, 1), (at("12:00:02"), "s", "ad", 0, 1)], [(at("20:00"), "beat", "ad", 0, 0)], [(at("20:30"), "beat", "ad", 0, 0)]], lambda s: S.sliding_window_panes(s, "20 minutes", "10 minutes"))
    assert own(rows, "event_time", "pane_timing", "clicks", "impressions") == [(day("12:10", -1), "ON_TIME", 1, 2), (day("12:20", -1), "ON_TIME", 1, 2)]


def test_dead_letters_apart(run, spark, tmp_path):
    good, dead = [], []
    f = S.split_batches("version", lambda df: good.extend(df.collect()), lambda df: dead.extend(df.collect()))
    f(spark.createDataFrame([("s", "v"), ("t", None)], "screen_id string, version string"), 0)
    assert [r.screen_id for r in good] == ["s"] and [tuple(r) for r in dead] == [("t",)]


def test_windowed_join(run, spark):
    screens = spark.createDataFrame([(at("12:01"), "s", "p")], "event_time timestamp, screen_id string, publication_id string")
    rows = run(AD, [[ev("I", "12:00")], [ev("C", "12:10")]], lambda s: S.enrich_in_window(s, screens, "10 minutes"))
    assert own(rows, "event_time", "publication_id") == [(day("12:10", -1), "p"), (day("12:20", -1), None)]


def test_unknown_events_are_enriched(run, spark):
    screens = spark.createDataFrame([(at("12:01"), "s", "p")], "event_time timestamp, screen_id string, publication_id string")
    rows = run(AD, [[(at("12:00"), "a", "s", "Unknown")], [(at("12:10"), "a", "s", "Unknown")], [ev("C", "12:40")]], lambda s: S.enrich_in_window(s, screens, "10 minutes"))
    assert [r for r in own(rows, "event_time", "action", "publication_id") if r[1] == "Unknown"] == [(day("12:10", -1), "Unknown", "p"), (day("12:20", -1), "Unknown", None)]
