"""Enrichment joins between inputs whose windows don't fit each other. Each gives matched rows and the rows without a match apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ctr import latest
from tidemark.model import millis, plus
from tidemark.operators.repeat import repeat
from tidemark.operators.windows import bounds


def split(joined: DataFrame, matched: str, drop: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of one nullable join result with a match, and those without, which lose the other side's columns."""
    return joined.where(F.col(matched).isNotNull()), joined.where(F.col(matched).isNull()).drop(*drop)


def enrich_by_latest(screens: DataFrame, publications: DataFrame, tie: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Screens with the latest version of their publication, whenever it came; and screens of unknown publications.

    The right side shrinks to one row for each publication before the join. Whether it is broadcast is left to the optimizer, which
    knows its size.
    """
    newest = latest(publications.select("publication_id", "event_time", "version", tie), ["publication_id"], "event_time", tie)
    newest = newest.select("publication_id", "version", F.lit(True).alias("_met"))
    joined = screens.join(newest, "publication_id", "left")
    met, rest = split(joined, "_met", ["version", "_met"])
    return met.drop("_met"), rest


def enrich_in_window(events: DataFrame, screens: DataFrame, duration: str) -> tuple[DataFrame, DataFrame]:
    """Left outer join on screen and fixed window; one row for each match. event_time is the window's last instant."""
    left = events.select("screen_id", "ad_id", "action", F.window("event_time", duration))
    right = screens.select("screen_id", "publication_id", F.window("event_time", duration), F.lit(True).alias("_met"))
    joined = left.join(right, ["screen_id", "window"], "left")
    out = joined.select("screen_id", "ad_id", "action", "publication_id", *bounds(), "_met")
    met, rest = split(out, "_met", ["publication_id", "_met"])
    return met.drop("_met"), rest


def enrich_by_repeater(events: DataFrame, screens: DataFrame, duration: str = "10 minutes", ttl: str = "10 minutes", tie: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Ad events with their screen, which is repeated into the windows after its own until ``ttl``; and events without a screen."""
    return enrich_in_window(events, repeat(screens, "screen_id", "publication_id", duration, ttl, tie), duration)


def co_group(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' rows of each key as two arrays of structs, in event time order; a key on one side has an empty other.

    Meant for keys with few rows; ``enrich_by_cache`` does the keyed work over streams of rows.
    """
    sides = []
    for name, df in (("left_rows", left), ("right_rows", right)):
        rest = [c for c in df.columns if c not in (key, "event_time")]
        sides.append(df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("event_time", *rest))).alias(name)))
    return sides[0].join(sides[1], key, "full")


def enrich_by_cache(screens: DataFrame, publications: DataFrame, ttl: str = "1 hour", tie: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """Screens with their publication out of a cache by key: a version stays until no row of its key came for ``ttl``, and a screen
    that comes first waits as long. Enriched rows are stamped with the time at which both were there, others with the time of the
    last row before the cache was cleared.

    Per key, in (event_time, ``tie``) order: a gap over ``ttl`` starts a new session of the cache. Within one, a screen takes the
    latest version before it, else the first after it. Versions are compared by their own time, so one that comes out of order
    never replaces a later one.
    """
    if millis(ttl) <= 0:
        raise ValueError("ttl must be positive")
    left = screens.select("publication_id", "event_time", F.col(tie).alias("_tie"), "screen_id", F.lit(None).cast("string").alias("version"), F.lit(True).alias("_left"))
    right = publications.select("publication_id", "event_time", F.col(tie).alias("_tie"), F.lit(None).cast("string").alias("screen_id"), "version", F.lit(False).alias("_left"))
    rows = left.unionByName(right)
    by_key = Window.partitionBy("publication_id").orderBy("event_time", "_tie", "_left")
    before = F.lag("event_time").over(by_key)
    fresh = before.isNull() | (F.col("event_time") > plus(before, millis(ttl)))
    rows = rows.withColumn("_new", fresh.cast("int"))
    rows = rows.withColumn("_session", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    session = Window.partitionBy("publication_id", "_session").orderBy("event_time", "_tie", "_left")
    found = F.when(~F.col("_left"), F.struct("version", "event_time"))
    rows = rows.withColumns({
        "_past": F.last(found, ignorenulls=True).over(session.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.first(found, ignorenulls=True).over(session.rowsBetween(0, Window.unboundedFollowing)),
        "_last": F.max("event_time").over(Window.partitionBy("publication_id", "_session")),
    })
    screen = rows.where("_left")
    at = F.when(F.col("_past").isNotNull(), F.col("event_time")).when(F.col("_next").isNotNull(), F.col("_next.event_time")).otherwise(F.col("_last"))
    out = screen.select("publication_id", "screen_id", F.coalesce("_past.version", "_next.version").alias("version"), at.alias("event_time"), (F.col("_past").isNotNull() | F.col("_next").isNotNull()).alias("_met"))
    return out.where("_met").drop("_met"), out.where("not _met").drop("_met", "version")
