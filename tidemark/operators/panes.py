"""On-time and late panes of windowed counts, for input that carries its arrival.

Rows have ``batch_id`` (order of arrival) and ``watermark`` (where the watermark stood before the batch; null: nowhere yet). A row is
on time if the watermark hasn't passed its window's last instant, late if it has by at most the allowed lateness, else dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ctr import to_ctr
from tidemark.model import millis, plus
from tidemark.operators.windows import bounds

ON_TIME, LATE = "ON_TIME", "LATE"


def with_arrival(events: DataFrame, batch: F.Column, tie: str = "event_id") -> DataFrame:
    """``events`` with batch_id and the watermark before it: the latest event time of all earlier batches.

    Batches are few, so the running maximum is over one row for each batch.
    """
    rows = events.withColumn("batch_id", batch)
    tops = rows.groupBy("batch_id").agg(F.max("event_time").alias("_top"))
    marks = tops.select("batch_id", F.max("_top").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)).alias("watermark"))
    return rows.join(marks, "batch_id")


def _panes(rows: DataFrame, window: F.Column, keys: list[str], lateness: str, add: str) -> DataFrame:
    rows = rows.select("*", window)
    last = plus(F.col("window.end"), -1)
    on_time = F.col("watermark").isNull() | (F.col("watermark") <= last)
    rows = rows.where(on_time | (F.col("watermark") <= plus(last, millis(lateness))))
    # The on-time pane comes first, then one pane for each batch that holds late rows.
    pane = F.when(on_time, F.lit(None)).otherwise(F.col("batch_id"))
    merge = F.max if add == "capped" else F.sum
    grouped = rows.groupBy("window", *keys, pane.alias("_batch")).agg(*[merge(c).alias(c) for c in ("clicks", "impressions")])
    order = Window.partitionBy("window", *keys).orderBy(F.col("_batch").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return grouped.select(
        *keys, *[merge(c).over(so_far).cast("int").alias(c) for c in ("clicks", "impressions")], *bounds(),
        F.when(F.col("_batch").isNull(), ON_TIME).otherwise(LATE).alias("pane_timing"), (F.row_number().over(order) - 1).cast("int").alias("pane_index"),
    )


def fixed_window_panes(events: DataFrame, duration: str, lateness: str = "0 minutes") -> DataFrame:
    """Panes of the fixed-window counts; a late pane holds all that its window has had so far."""
    return _panes(to_ctr(events), F.window("event_time", duration), ["screen_id", "ad_id"], lateness, "capped")


def sliding_window_panes(ctrs: DataFrame, duration: str, period: str, lateness: str = "0 minutes") -> DataFrame:
    """Panes of the sliding sums of per-screen counts. Rows of one period, key and batch are added up before they are copied into their
    windows, where windows begin and end with periods."""
    if millis(duration) % millis(period) == 0:
        sums = ctrs.groupBy(F.window("event_time", period), "screen_id", "ad_id", "batch_id", "watermark").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
        ctrs = sums.withColumn("event_time", F.col("window.start")).drop("window")
    return _panes(ctrs, F.window("event_time", duration, period), ["screen_id", "ad_id"], lateness, "total")
