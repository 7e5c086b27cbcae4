"""Shared storage of intermediate tables.

Every table that an operator of this subpackage cuts its lineage with lives in the folder that the session names in
``spark.checkpoint.dir``; losing an executor therefore never loses one of them.
"""

from __future__ import annotations

import atexit
import contextlib
import pickle
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import give_back

BROADCAST_BYTES = 8 << 20  # of a list of ids, by its own count
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared one. Only a local session, where all is one machine, may leave the setting
    out; its tables then lie beside the warehouse's."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """What the registered queries ask of their session, unless it says otherwise: batches of at most ``rows`` texts for Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Let Python steps that run inside get batches of at most ``rows`` rows; texts are long, and both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, str(min(rows, int(old)) if old and int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class Scratch:
    """Intermediate tables of one operator call: ``keep`` writes one, ``drop`` deletes it, ``close`` deletes all but some."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.tables: list[tuple[str, DataFrame]] = []

    def folder(self, label: str) -> str:
        """A new folder's path; the folder is deleted at exit at the latest."""
        path = f"{shared_dir(self.spark)}/{self.name}-{label}-{uuid.uuid4().hex}"
        _written.append((self.spark, path))
        return path

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = self.folder(label)
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, out))
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the table that ``keep`` returned as ``df``."""
        for path, table in self.tables:
            if table is df:
                delete(self.spark, path)
        self.tables = [(p, t) for p, t in self.tables if t is not df]

    def close(self, *but: DataFrame) -> None:
        for _, table in list(self.tables):
            if not any(table is b for b in but):
                self.drop(table)


@contextlib.contextmanager
def released(spark: SparkSession, *but: Scratch) -> Iterator[None]:
    """Delete, at the end, all tables that were written inside, but for those that ``but`` still hold."""
    first = len(_written)
    yield
    held = {path for scratch in but for path, _ in scratch.tables}
    for _, path in _written[first:]:
        if path not in held:
            delete(spark, path)
    _written[first:] = [x for x in _written[first:] if x[1] in held]


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            delete(spark, path)


def chosen(df: DataFrame, *cols: str) -> DataFrame:
    """Only ``cols``: extra columns of the input, whatever their names, can't clash with an operator's own."""
    return df.select(*[f"`{c}`" for c in cols])


def is_small(ids: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast: its values, each with 16 bytes beside it, take at most ``most`` bytes, by count."""
    varying = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, kind in ids.dtypes if kind in ("string", "binary")]
    size = F.lit(24 * len(ids.columns))
    for v in varying:
        size = size + v
    return (ids.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def only(big: DataFrame, ids: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """A join with a list of ids that broadcasts it while it is small and shuffles both sides otherwise."""
    return big.join(F.broadcast(ids) if is_small(ids) else ids, key, how)


def join_uneven(big: DataFrame, groups: DataFrame, key: str, count: str = "n_rows", how: str = "inner", least: int = 1000, share: int = 100_000) -> DataFrame:
    """``big`` (a written table) joined with ``groups`` (one row for each key, ``count``: its rows in ``big``) by inner or left join.

    Heavy keys, of more than ``least`` rows and of more than a ``share``-th of all, go by broadcast, so none of them lands in one task;
    there are at most ``share`` of them, whatever the table. All other keys are shuffled. Rows with a null key come only from a left
    join, which should be given none.
    """
    total, top = groups.agg(F.sum(count), F.max(count)).first()
    most = max(least, (total or 0) // share)
    if (top or 0) <= most:
        return big.join(groups, key, how)
    heavy = groups.where(F.col(count) > most)
    rest = big.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return big.join(F.broadcast(heavy), key).unionByName(rest.join(groups.where(F.col(count) <= most), key, how))


def _place(id_col: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(id_col), 1) / float(1 << 63)


def _low(counts: dict, by: str, n: float, id_col: str) -> Column:
    low = F.lit(0.0)
    for value, count in counts.items():
        low = F.when(F.col(by) == F.lit(value), F.lit(n / count + 1e-9)).otherwise(low)
    return _place(id_col) < low


def labelled_sample(scratch: Scratch, docs: DataFrame, labels: DataFrame, n: int, max_bytes: int) -> tuple[DataFrame, dict]:
    """A written table (y, place, doc_id, text) that holds, for each y of ``labels`` (doc_id, y), at least the ``n`` texts of at most
    ``max_bytes`` with the least place, a hash of their id, and the number of labels of each y. ``fitted`` takes those ``n``.

    Ids are tried from the least hash on, eight times as many in each round, until every y has its ``n`` texts or no labels are
    left; so labels of long or missing texts never use the sample up, and one round is the rule.
    """
    counts = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    times = 1.3
    while True:
        few = labels.where(_low(counts, "y", times * n, "doc_id"))
        own = chosen(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
        met = only(own, few, "doc_id").select("y", _place("doc_id").alias("place"), "doc_id", "text").distinct()
        got = scratch.keep(met, "sample")
        have = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
        if all(have.get(y, 0) >= n or times * n >= count for y, count in counts.items()):
            return got, counts
        scratch.drop(got)
        times *= 8


def fitted(sample: DataFrame, n: int, fit: Callable[[list[tuple]], object]) -> object:
    """``fit`` of the (doc_id, text, y) of the first ``n`` rows of each y of a written ``sample``. One executor task reads and fits, so the
    driver never holds the sample or the fit's working memory; a task that is lost is run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict = {}
        for batch in batches:
            for y, place, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(y, []).append((place, doc_id, text))
        rows = sorted((doc_id, text, y) for y, group in by.items() for _, doc_id, text in sorted(group)[:n])
        by.clear()
        out = pickle.dumps(fit(rows))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], names=["model"])

    got = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return fit([]) if got is None else pickle.loads(got["model"])
