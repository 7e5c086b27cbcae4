"""Table jobs: four that read and two that write. ``python -m tidemark.plans.jobs JOB --table NAME``.

Reading jobs print a sample and a count. Writing jobs make records 1..100; the table has to be there.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import MAP_RECORD
from tidemark.sources import sinks, tables

COLUMNS = ["id", "timestamp", "name", "description", "attributes"]
RESTRICTION = "name LIKE '%9%'"


def read_query(spark: SparkSession, table: str) -> DataFrame:
    """The records whose name has a 9, by query."""
    return tables.scan_query(spark, f"SELECT {', '.join(COLUMNS)} FROM {tables.table_name(table)} WHERE {RESTRICTION}")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """All records."""
    return tables.scan_table(table, spark)


def read_restricted(spark: SparkSession, table: str) -> DataFrame:
    """The records whose name has a 9, by a restriction that the scan applies."""
    return tables.scan_table(table, spark, restriction=RESTRICTION)


def read_columns(spark: SparkSession, table: str) -> DataFrame:
    """All records, by a scan of the record's columns."""
    return tables.scan_table(table, spark, columns=COLUMNS)


def save_records(spark: SparkSession, table: str) -> None:
    """Append generated records, checked against the table's schema."""
    sinks.write_table(tables.generate_records(spark), tables.table_name(table))


def save_map_records(spark: SparkSession, table: str) -> None:
    """Append generated records that hold their attributes as a map, by two sinks off one input: each record lands twice."""
    as_map = tables.generate_records(spark).withColumn("attributes", tables.pairs_to_map("attributes")).to(MAP_RECORD)
    put = sinks.retrying(lambda df: sinks.write_table(df.withColumn("attributes", tables.map_to_pairs("attributes")), tables.table_name(table)))
    sinks.write_all(as_map, [put, put])


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"read-query": read_query, "read-table": read_table, "read-restricted": read_restricted, "read-columns": read_columns}
WRITERS: dict[str, Callable[[SparkSession, str], None]] = {"save-records": save_records, "save-map-records": save_map_records}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("job", choices=[*READERS, *WRITERS])
    parser.add_argument("--table", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(args.job).getOrCreate()
    if args.job in WRITERS:
        return WRITERS[args.job](spark, args.table)
    df = READERS[args.job](spark, args.table)
    sinks.show(tables.print_sample(df), "Sample: ", 1)
    sinks.show(tables.count(df), "Count: ", 1)
    return None


if __name__ == "__main__":
    main()
