"""The repeater: re-emits the latest value of each key at a fixed interval until its time to live is over.

The first value is emitted at once and starts the key's clock; a newer one takes its place and is emitted with the next tick. A tick
emits, then goes on if it comes before the last value's time plus the time to live, else the key is forgotten. A value that comes
with a tick counts before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import millis
from tidemark.operators.windows import keyed_runs


def fold_repeat(values: Iterator[tuple[int, object]], interval: int, ttl: int) -> Iterator[tuple[int, object]]:
    """(time, value) of all emissions for (time, value) in order of time, in milliseconds."""
    held, seen, tick = None, 0, None

    def ticks(until: int | None) -> Iterator[tuple[int, object]]:
        nonlocal tick
        while tick is not None and (until is None or tick < until):
            yield tick, held
            tick = tick + interval if tick < seen + ttl else None

    for t, value in values:
        yield from ticks(t)
        if tick is None:
            yield t, value
            tick = t + interval
        held, seen = value, t
    yield from ticks(None)


def repeat(df: DataFrame, key: str, value: str, interval: str, ttl: str, tie: str = "event_id") -> DataFrame:
    """key, value, event_time of all emissions, values taken in (event_time, ``tie``) order. One value per key is held at a time."""
    kind = df.schema[key].dataType.simpleString(), df.schema[value].dataType.simpleString()
    args = millis(interval), millis(ttl)
    own = df.select(F.col(key).alias("k"), F.unix_millis(F.col("event_time").cast("timestamp")).alias("t"), F.col(value).alias("v"), F.col(tie).alias("tie"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for k, rows in keyed_runs(batches, ["k"]):
            for t, v in fold_repeat(((r[1], r[2]) for r in rows), *args):
                out.append((k[0], v, t))
                if len(out) >= 50_000:
                    yield pd.DataFrame(out, columns=["k", "v", "t"])
                    out = []
        yield pd.DataFrame(out, columns=["k", "v", "t"])

    ordered = own.repartition("k").sortWithinPartitions("k", "t", "tie")
    done = ordered.mapInPandas(run, f"k {kind[0]}, v {kind[1]}, t long")
    return done.select(F.col("k").alias(key), F.col("v").alias(value), F.timestamp_millis("t").cast("timestamp_ntz").alias("event_time"))


def repeat_single(df: DataFrame, interval: str, ttl: str) -> DataFrame:
    """The repeater where each key has one row: times t + k * interval for k = 0 .. max(1, ceil(ttl / interval)), no Python."""
    n = max(1, -(-millis(ttl) // millis(interval)))
    steps = F.explode(F.expr(f"transform(sequence(0, {n}), k -> event_time + make_dt_interval(0, 0, 0, k * {millis(interval) / 1000:.3f}))"))
    return df.select(*[c for c in df.columns if c != "event_time"], steps.alias("event_time"))
