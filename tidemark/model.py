"""Record schemas, and how the ``events`` table maps onto them.

Event time is an ordinary column everywhere. All instants have millisecond resolution: the last instant of a window is its end minus
one millisecond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLICK, IMPRESSION, UNKNOWN = "Click", "Impression", "Unknown"

_PAIR = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)])


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


AD_EVENT = _schema(event_time=T.TimestampType(), ad_id=T.StringType(), screen_id=T.StringType(), action=T.StringType())
SCREEN = _schema(event_time=T.TimestampType(), screen_id=T.StringType(), publication_id=T.StringType())
PUBLICATION = _schema(event_time=T.TimestampType(), publication_id=T.StringType(), version=T.StringType())
AD_CTR = _schema(event_time=T.TimestampType(), screen_id=T.StringType(), ad_id=T.StringType(), clicks=T.IntegerType(), impressions=T.IntegerType())


def _record(attributes: T.DataType) -> T.StructType:
    need = [("id", T.LongType()), ("timestamp", T.TimestampType()), ("name", T.StringType())]
    return T.StructType([*(T.StructField(n, k, False) for n, k in need), T.StructField("description", T.StringType()), T.StructField("attributes", attributes)])


RECORD = _record(T.ArrayType(_PAIR))
#: The same record as files of the row format hold it, with the attributes as a nullable map.
MAP_RECORD = _record(T.MapType(T.StringType(), T.StringType()))


def millis(duration: str) -> int:
    """Whole milliseconds of a day-time interval such as '10 minutes' or '1 hour'."""
    unit = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    parts = duration.lower().split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a duration: {duration!r}")
    return sum(int(n) * unit[name.rstrip("s") if name != "s" else "second"] for n, name in zip(parts[::2], parts[1::2], strict=True))


def plus(time: Column | str, ms: int) -> Column:
    """``time`` moved by ``ms`` milliseconds; keeps its type."""
    c = F.col(time) if isinstance(time, str) else time
    return c + F.expr(f"make_dt_interval(0, 0, 0, {ms / 1000:.3f})")


def ad_events(events: DataFrame, screens: int | None = 10, known: bool = False) -> DataFrame:
    """event_time, ad_id, screen_id, action, event_id; ``screens``: users share so many screens, None gives each user their own.
    ``known``: clicks and impressions only, as a filter on the source's own column, which reaches its scan."""
    events = events.where(F.col("event_type").isin("click", "view")) if known else events
    screen = F.col("user_id") % screens if screens else F.col("user_id")
    action = F.when(F.col("event_type") == "click", CLICK).when(F.col("event_type") == "view", IMPRESSION).otherwise(UNKNOWN)
    return events.select(F.col("ts").alias("event_time"), F.get_json_object("props", "$.k").alias("ad_id"), screen.cast("string").alias("screen_id"), action.alias("action"), "event_id")


def screens_of_signups(events: DataFrame) -> DataFrame:
    """event_time, screen_id, publication_id, event_id: a sign-up puts a user's screen up."""
    own = events.where("event_type = 'signup'")
    return own.select(F.col("ts").alias("event_time"), F.col("user_id").cast("string").alias("screen_id"), F.col("event_id").cast("string").alias("publication_id"), "event_id")


def publications(events: DataFrame) -> DataFrame:
    """event_time, publication_id, version, event_id: a sign-up publishes a version under the user's id."""
    own = events.where("event_type = 'signup'")
    return own.select(F.col("ts").alias("event_time"), F.col("user_id").cast("string").alias("publication_id"), F.col("event_id").cast("string").alias("version"), "event_id")


def screens_of_views(events: DataFrame) -> DataFrame:
    """event_time, screen_id, publication_id, event_id: a view is a screen that shows the user's publication."""
    own = events.where("event_type = 'view'")
    return own.select(F.col("ts").alias("event_time"), F.col("event_id").cast("string").alias("screen_id"), F.col("user_id").cast("string").alias("publication_id"), "event_id")
