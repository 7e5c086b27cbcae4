"""Writers of typed tables. A table is never created here; rows are projected to its schema and appended unless told otherwise."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

APPEND, TRUNCATE, EMPTY = "append", "truncate", "empty"


def fitted(df: DataFrame, table: str) -> DataFrame:
    """``df`` by name and type as ``table`` wants it; a missing or ill-typed column is an error before anything is written."""
    schema = df.sparkSession.table(table).schema
    if missing := set(schema.names) - set(df.columns):
        raise ValueError(f"{table} wants {', '.join(sorted(missing))}")
    return df.to(schema)


def write_table(df: DataFrame, table: str, disposition: str = APPEND) -> None:
    """``append`` adds rows, ``truncate`` replaces them, ``empty`` adds to an empty table only. A missing table is an error."""
    if disposition not in (APPEND, TRUNCATE, EMPTY):
        raise ValueError(f"no disposition {disposition!r}")
    rows = fitted(df, table)
    if disposition == EMPTY and df.sparkSession.table(table).limit(1).count():
        raise ValueError(f"{table} isn't empty")
    rows.write.insertInto(table, overwrite=disposition == TRUNCATE)


def write_all(df: DataFrame, writers: list[Callable[[DataFrame], None]]) -> None:
    """Several sinks off one input, which is computed once."""
    kept = df.persist()
    try:
        for w in writers:
            w(kept)
    finally:
        kept.unpersist()


def retrying(write: Callable[[DataFrame], None], attempts: int = 3, pause: float = 1.0, transient: Callable[[Exception], bool] = lambda e: not isinstance(e, (AnalysisException, ValueError))) -> Callable[[DataFrame], None]:
    """``write`` again after an error that may pass; others, and the last one, are raised."""

    def run(df: DataFrame) -> None:
        for k in range(attempts):
            try:
                return write(df)
            except Exception as e:
                if k + 1 == attempts or not transient(e):
                    raise
                time.sleep(pause * 2**k)

    return run


def write_batch(df: DataFrame, table: str, batch_col: str, batch_id: int) -> None:
    """Make ``df`` the rows of one batch in ``table``, which is partitioned by ``batch_col``. A batch that is written again, whole or
    after a failure halfway, replaces itself and touches no other."""
    spark, key = df.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    rows = fitted(df.withColumn(batch_col, F.lit(batch_id)), table)
    old = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        rows.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, old)


def reasons(rules: dict[str, str]) -> Column:
    """The names of the SQL conditions that a row fails, comma-joined; null for a good row. An unknown condition fails."""
    failed = F.concat_ws(",", *[F.when(~F.coalesce(F.expr(cond), F.lit(False)), F.lit(name)) for name, cond in rules.items()])
    return F.nullif(failed, F.lit(""))


def insert_stream(
    stream: DataFrame, table: str, checkpoint: str, rejects: str | None = None, valid: str | dict[str, str] | None = None, every: str | None = None, files: int | None = None, attempts: int = 3,
    batch_col: str | None = None,
) -> StreamingQuery:
    """Append a stream's batches to ``table``. Rows that fail a SQL condition of ``valid`` (by name, or one alone) go to ``rejects``
    instead; a table of rejects with a column ``reason`` gets the names of the conditions there.

    ``every``: time between batches, all that is there and stop without it; ``files``: files a batch, through a round-robin shuffle.
    ``batch_col``: both tables are partitioned by it, and a batch replaces its own partition, so retries and replays after a restart
    leave each row once. Without it a batch is appended at least once.
    """
    rules = {"invalid": valid} if isinstance(valid, str) else valid

    def put(df: DataFrame, to: str, batch_id: int) -> None:
        write = (lambda d: write_batch(d, to, batch_col, batch_id)) if batch_col else (lambda d: write_table(d, to))
        retrying(write, attempts)(df)

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.repartition(files) if files else df
        if not rules:
            return put(df, table, batch_id)
        kept = df.withColumn("reason", reasons(rules)).persist()
        try:
            put(kept.where("reason is null").drop("reason"), table, batch_id)
            if rejects:
                put(kept.where("reason is not null"), rejects, batch_id)
        finally:
            kept.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


@contextlib.contextmanager
def step(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs that run inside carry ``name`` in the monitor and the event log."""
    sc, key = spark.sparkContext, "spark.job.description"
    old = sc.getLocalProperty(key)
    sc.setJobDescription(name)
    try:
        yield
    finally:
        sc.setLocalProperty(key, old)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with its rows counted on the way, and ``metrics`` beside them; ``get`` of the second gives them after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(m) for m, c in metrics.items()]), seen


def show(df: DataFrame, prefix: str = "", n: int = 20) -> None:
    """Print a few rows, each after ``prefix``."""
    for row in df.limit(n).select(F.to_json(F.struct("*"))).collect():
        print(f"{prefix}{row[0]}")


def ensure_table(spark: SparkSession, table: str, schema, fmt: str = "parquet", by: str | None = None) -> None:
    """Create an empty table, partitioned ``by`` a column, for jobs and tests; the writers themselves never do."""
    writer = spark.createDataFrame([], schema).write.format(fmt).mode("ignore")
    (writer.partitionBy(by) if by else writer).saveAsTable(table)
