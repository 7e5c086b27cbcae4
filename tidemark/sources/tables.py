"""Scans of typed tables, and a generated one. All are lazy: filters and column lists reach the file scan."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import RECORD


def table_name(spec: str) -> str:
    """A table id such as project:dataset.table as an identifier."""
    return spec.replace(":", ".")


def generate_records(spark: SparkSession, n: int = 100, at: str = "2024-01-01 00:00:00") -> DataFrame:
    """Records 1..n of the RECORD schema, all at one instant."""
    i = F.col("id")
    pair = lambda k: F.struct(F.lit(f"key {k}").alias("key"), F.concat(F.lit("value "), i).alias("value"))
    rows = spark.range(1, n + 1).select(
        "id", F.lit(datetime.fromisoformat(at).replace(tzinfo=UTC)).alias("timestamp"), F.concat(F.lit("some name "), i).alias("name"), F.concat(F.lit("some description "), i).alias("description"), F.array(pair(1), pair(2)).alias("attributes")
    )
    return rows.to(RECORD)


def scan_query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The rows of a query over catalog tables, and over ``tables`` by the names they are given here, used as {name}."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def scan_table(source: DataFrame | str, spark: SparkSession | None = None, restriction: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A whole table, by catalog name or as a DataFrame; only ``columns`` and rows that pass the SQL ``restriction`` are read."""
    df = spark.table(table_name(source)) if isinstance(source, str) else source
    df = df.where(restriction) if restriction else df
    return df.select(*columns) if columns else df


def map_to_pairs(column: str) -> F.Column:
    """A nullable map as key/value structs; null gives an empty list, as repeated fields have no null."""
    return F.coalesce(F.map_entries(column), F.array().cast("array<struct<key: string, value: string>>"))


def pairs_to_map(column: str) -> F.Column:
    return F.map_from_entries(column)


def print_sample(df: DataFrame, n: int = 1) -> DataFrame:
    """Any ``n`` rows; which ones isn't defined."""
    return df.limit(n)


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"))
