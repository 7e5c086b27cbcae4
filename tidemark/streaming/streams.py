"""The event-time operators over streaming DataFrames.

Input streams have ``event_time`` as a timestamp with time zone; streaming accepts no other kind. Results with panes come from
stateful processors, which need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.ctr import capped, latest, to_ctr
from tidemark.model import CLICK, UNKNOWN, millis
from tidemark.operators.windows import bounds
from tidemark.streaming.processors import CustomWindows, LateFirings, LookupCache, Repeater

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of any size: on local disk, with changes written to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def fixed_window_ctr(events: DataFrame, duration: str) -> DataFrame:
    """Append mode: each window's result once, when the watermark has passed it. Rows behind the watermark are dropped."""
    marked = to_ctr(events).withWatermark("event_time", "0 seconds")
    grouped = marked.groupBy(F.window("event_time", duration), "screen_id", "ad_id").agg(capped("clicks"), capped("impressions"))
    return grouped.select("screen_id", "ad_id", "clicks", "impressions", *bounds())


def _late(ctrs: DataFrame, window: F.Column, lateness: str, mode: str) -> DataFrame:
    marked = ctrs.withWatermark("event_time", f"{millis(lateness)} milliseconds").select("screen_id", "ad_id", "clicks", "impressions", "event_time", window.alias("w"))
    keyed = marked.withColumns({"window_start": F.unix_millis("w.start"), "window_end": F.unix_millis("w.end")}).drop("w")
    grouped = keyed.groupBy("screen_id", "ad_id", "window_start", "window_end")
    out = grouped.transformWithState(LateFirings(millis(lateness), mode), LateFirings.OUTPUT, "append", "eventTime")
    at = lambda c: F.timestamp_millis(c)
    return out.select("screen_id", "ad_id", "clicks", "impressions", at(F.col("window_start")).alias("window_start"), at(F.col("window_end")).alias("window_end"), at(F.col("window_end") - 1).alias("event_time"), "pane_timing", "pane_index")


def fixed_window_panes(events: DataFrame, duration: str, lateness: str = "0 minutes") -> DataFrame:
    return _late(to_ctr(events), F.window("event_time", duration), lateness, "capped")


def sliding_window_panes(ctrs: DataFrame, duration: str, period: str, lateness: str = "0 minutes") -> DataFrame:
    return _late(ctrs, F.window("event_time", duration, period), lateness, "total")


def repeat(screens: DataFrame, key: str, value: str, interval: str, ttl: str) -> DataFrame:
    """key, value, event_time; event_time carries the watermark, so the result can be windowed and joined downstream."""
    marked = screens.withWatermark("event_time", "0 seconds").select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.unix_millis("event_time").alias("t"), "event_time")
    out = marked.groupBy("key").transformWithState(Repeater(millis(interval), millis(ttl)), Repeater.OUTPUT, "append", "eventTime", eventTimeColumnName="event_time")
    return out.select(F.col("key").alias(key), F.col("value").alias(value), "event_time")


def enrich_by_latest(screens: DataFrame, publications: DataFrame, tie: str = "event_id") -> DataFrame:
    """Each screen at once, with the latest version of its publication as the static side stands when the batch starts; version is
    null in dead letters. Reading the static side anew is up to its source."""
    newest = latest(publications.select("publication_id", "event_time", "version", tie), ["publication_id"], "event_time", tie)
    return screens.join(newest.select("publication_id", "version"), "publication_id", "left")


def enrich_in_window(events: DataFrame, screens: DataFrame, duration: str) -> DataFrame:
    """Left outer join on screen and fixed window; a row without a match comes once its window is over. Split it by a null
    publication_id in ``foreachBatch``."""
    left = events.withWatermark("event_time", "0 seconds").select("screen_id", "ad_id", "action", F.window("event_time", duration))
    right = screens.select("screen_id", "publication_id", F.window("event_time", duration))
    return left.join(right, ["screen_id", "window"], "left").select("screen_id", "ad_id", "action", "publication_id", *bounds())


def enrich_by_cache(screens: DataFrame, publications: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """publication_id, screen_id, version (null in dead letters), event_time."""
    side = lambda df, payload, left: df.select(F.col("publication_id").alias("key"), F.col(payload).alias("payload"), F.lit(left).alias("is_left"), F.unix_millis("event_time").alias("t"), "event_time")
    both = side(screens, "screen_id", True).unionByName(side(publications, "version", False)).withWatermark("event_time", "0 seconds")
    out = both.groupBy("key").transformWithState(LookupCache(millis(ttl)), LookupCache.OUTPUT, "append", "eventTime")
    return out.select(F.col("key").alias("publication_id"), F.col("payload").alias("screen_id"), F.col("lookup").alias("version"), F.timestamp_millis("event_ms").alias("event_time"))


def custom_window_ctr(events: DataFrame, impression_to_click: str = "10 minutes", click_to_impression: str = "1 minute", lateness: str = "0 minutes") -> DataFrame:
    marked = events.where(F.col("action") != UNKNOWN).withWatermark("event_time", f"{millis(lateness)} milliseconds")
    rows = marked.select("screen_id", "ad_id", F.unix_millis("event_time").alias("t"), (F.col("action") == CLICK).alias("click"), "event_time")
    args = millis(impression_to_click), millis(click_to_impression), millis(lateness)
    out = rows.groupBy("screen_id", "ad_id").transformWithState(CustomWindows(*args), CustomWindows.OUTPUT, "append", "eventTime")
    return out.select("screen_id", "ad_id", "clicks", "impressions", F.timestamp_millis("start_ms").alias("window_start"), F.timestamp_millis("end_ms").alias("event_time"))


def split_batches(matched: str, good: Callable[[DataFrame], None], dead: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives matched rows to one writer and dead letters to another, computed once."""

    def batch(df: DataFrame, _: int) -> None:
        kept = df.persist()
        try:
            good(kept.where(F.col(matched).isNotNull()))
            dead(kept.where(F.col(matched).isNull()).drop(matched))
        finally:
            kept.unpersist()

    return batch


class TestStream:
    """Numbered files as a stream: each batch of rows is one trigger, and its event times move the watermark."""

    __test__ = False

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema, self.n = spark, Path(path), schema, 0

    def add(self, *rows: tuple) -> TestStream:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / f"b{self.n:04d}"))
        self.n += 1
        return self

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(self.path))

    def run(self, df: DataFrame, name: str, checkpoint: str) -> list:
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        if q.exception():
            raise q.exception()
        return self.spark.table(name).collect()
