"""Click-through columns and their two ways of adding up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import CLICK, IMPRESSION


def to_ctr(events: DataFrame) -> DataFrame:
    """``events`` with clicks and impressions, 0 or 1 each. An unknown action gives 0/0, and its row stays."""
    one = lambda action: F.when(F.col("action") == action, 1).otherwise(0).cast("int")
    return events.withColumns({"clicks": one(CLICK), "impressions": one(IMPRESSION)})


def capped(column: str, cap: int = 1) -> Column:
    """The sum of a count column, ``cap`` at most. With counts of 0 and 1 and a cap of 1 that is the maximum, which needs no wide sum."""
    return (F.max(column) if cap == 1 else F.least(F.lit(cap), F.sum(column))).cast("int").alias(column)


def total(column: str) -> Column:
    return F.sum(column).cast("int").alias(column)


def ratio(clicks: str = "clicks", impressions: str = "impressions") -> Column:
    """Clicks per impression, null without impressions."""
    return F.try_divide(F.col(clicks).cast("double"), F.col(impressions).cast("double"))


def max_instant(time: str) -> Column:
    """The latest instant of a group, the epoch if there is none later."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.greatest(F.coalesce(F.max(F.col(time).cast("timestamp_ntz")), epoch), epoch)


def latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key; of rows at one time the one with the greatest ``tie``. One combinable aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])
