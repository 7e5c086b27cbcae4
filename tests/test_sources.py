import shutil
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.model import MAP_RECORD, RECORD, millis
from tidemark.plans import jobs
from tidemark.sources import sinks, tables


@pytest.fixture
def name(spark):
    table = f"t_{uuid.uuid4().hex}"
    sinks.ensure_table(spark, table, RECORD)
    yield table
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    shutil.rmtree(Path("/tmp/tidemark-warehouse") / table, ignore_errors=True)


def test_dispositions(spark, name):
    rows = tables.generate_records(spark, 10)
    sinks.write_table(rows, name, sinks.EMPTY)
    sinks.write_table(rows.select("attributes", "name", "id", "timestamp", "description"), name)
    assert spark.table(name).count() == 20
    with pytest.raises(ValueError):
        sinks.write_table(rows, name, sinks.EMPTY)
    sinks.write_table(rows, name, sinks.TRUNCATE)
    assert tables.count(tables.scan_table(name, spark)).first()["count"] == 10
    with pytest.raises(AnalysisException):
        sinks.write_table(rows, "no_such_table")
    with pytest.raises(ValueError, match="wants name"):
        sinks.write_table(rows.drop("name"), name)


def test_two_sinks_write_twice(spark, name):
    put = lambda df: sinks.write_table(df, name)
    sinks.write_all(tables.generate_records(spark), [put, put])
    assert spark.table(name).count() == 200


def test_scans_push_filters_down(spark, name):
    sinks.write_table(tables.generate_records(spark), name)
    got = tables.scan_table(name, spark, "name LIKE '%9%'", ["id", "name"])
    assert got.count() == 19
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(name,9)" in plan and "description" not in plan.split("ReadSchema")[1]
    assert tables.scan_query(spark, f"SELECT id FROM {name} WHERE name LIKE '%9%'").count() == 19
    assert tables.print_sample(spark.table(name)).count() == 1 and tables.table_name("a:b.c") == "a.b.c"


def test_maps_and_pairs(spark):
    rows = tables.generate_records(spark, 2)
    m = rows.withColumn("attributes", tables.pairs_to_map("attributes")).to(MAP_RECORD)
    assert m.first().attributes == {"key 1": "value 1", "key 2": "value 1"}
    none = m.withColumn("attributes", F.lit(None).cast("map<string,string>"))
    assert none.select(tables.map_to_pairs("attributes").alias("a")).first().a == []


def test_retries(spark):
    calls = []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")

    sinks.retrying(flaky, 3, 0)(None)
    assert len(calls) == 3
    with pytest.raises(OSError):
        sinks.retrying(lambda _: (_ for _ in ()).throw(OSError("x")), 2, 0)(None)
    with pytest.raises(ValueError):
        sinks.retrying(lambda _: (_ for _ in ()).throw(ValueError("x")), 5, 0)(None)


def test_stream_inserts_with_rejects(spark, name, tmp_path):
    bad = f"{name}_bad"
    sinks.ensure_table(spark, bad, RECORD)
    tables.generate_records(spark, 20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RECORD).parquet(str(tmp_path / "in"))
    sinks.insert_stream(stream, name, str(tmp_path / "ck"), rejects=bad, valid="name NOT LIKE '%9%'", files=2).awaitTermination(120)
    assert (spark.table(name).count(), spark.table(bad).count()) == (18, 2)
    spark.sql(f"DROP TABLE {bad}")


def test_reasons_of_rejects_and_replayed_batches(spark, tmp_path):
    good, bad = (f"t_{uuid.uuid4().hex}" for _ in range(2))
    sinks.ensure_table(spark, good, "id long, name string, batch int", by="batch")
    sinks.ensure_table(spark, bad, "id long, name string, reason string, batch int", by="batch")
    spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (None, None), (5, "e")], "id long, name string").write.parquet(str(tmp_path / "in"))
    rules = {"no id": "id IS NOT NULL", "name": "name < 'd' OR id = 5"}
    for checkpoint in ("one", "two"):  # a second run from a new checkpoint replays batch 0
        stream = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
        sinks.insert_stream(stream, good, str(tmp_path / checkpoint), rejects=bad, valid=rules, batch_col="batch").awaitTermination(120)
        for t in (good, bad):
            spark.catalog.refreshTable(t)  # a stream writes from a session of its own
        assert sorted((r.id, r.name, r.batch) for r in spark.table(good).collect()) == [(1, "a", 0), (5, "e", 0)]
        assert sorted((str(r.id), str(r.name), r.reason) for r in spark.table(bad).collect()) == [("2", "None", "name"), ("None", "None", "no id,name"), ("None", "c", "no id")]
    sinks.write_batch(spark.createDataFrame([(9, "z")], "id long, name string"), good, "batch", 1)
    sinks.write_batch(spark.createDataFrame([(8, "y")], "id long, name string"), good, "batch", 1)
    assert sorted((r.id, r.batch) for r in spark.table(good).collect()) == [(1, 0), (5, 0), (8, 1)]
    for t in (good, bad):
        spark.sql(f"DROP TABLE {t}")


def test_step_names_and_counts(spark):
    sc = spark.sparkContext
    with sinks.step(spark, "outer"):
        with sinks.step(spark, "inner"):
            assert sc.getLocalProperty("spark.job.description") == "inner"
        assert sc.getLocalProperty("spark.job.description") == "outer"
    df, seen = sinks.observed(spark.range(7), "ids", top=F.max("id"))
    df.collect()
    assert seen.get == {"rows": 7, "top": 6}


def test_durations():
    assert millis("10 minutes") == 600_000 and millis("1 hour 30 seconds") == 3_630_000
    with pytest.raises(ValueError):
        millis("soon")


def test_jobs(spark, name, capsys):
    for job in ("save-records", "save-map-records"):
        jobs.main([job, "--table", name], spark)
    assert spark.table(name).count() == 300 and spark.table(name).where("size(attributes) = 2").count() == 300
    counts = []
    for job in ("read-query", "read-table", "read-restricted", "read-columns"):
        jobs.main([job, "--table", name], spark)
        sample, count = capsys.readouterr().out.strip().split("\n")
        assert sample.startswith('Sample: {"id":')
        counts.append(count)
    assert counts == [f'Count: {{"count":{n}}}' for n in (57, 300, 57, 300)]


def test_show(spark, capsys):
    sinks.show(spark.range(1), "Sample: ")
    assert capsys.readouterr().out == 'Sample: {"id":0}\n'
    assert datetime.now()
