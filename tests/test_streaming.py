"""Freshness of datasources, and streams against the same work done on tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine
from millrace.lang.parser import LanguageError
from millrace.streaming.refresh import freshness, ingest, windowed

EVENTS = "id long, ts timestamp, kind string"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1, hour, minute)


def test_freshness_tells_lag_and_emptiness(spark):
    e = Engine(spark)
    e.register_frame("a", spark.createDataFrame([(1, at(5)), (2, None)], "id long, ts timestamp"))
    e.register_frame("b", spark.createDataFrame([(1, at(4))], "id long, ts timestamp"))
    e.register_frame("c", spark.createDataFrame([], "id long, ts timestamp"))
    e.run("key x.id int; property x.id.seen datetime;" + "".join(f"datasource {n} (id: x.id, ts: ?x.seen) grain (x.id) address {n};" for n in "abc"))
    stale = lambda within: {r.datasource: r.stale for r in freshness(e, "x.seen", within).collect()}
    assert stale("30 minutes") == {"a": False, "b": True, "c": True}
    assert stale("60 minutes") == {"a": False, "b": False, "c": True}
    with pytest.raises(LanguageError):
        freshness(e, "x.unknown")


def test_nothing_is_stale_among_empty_tables(spark):
    e = Engine(spark)
    e.register_frame("a", spark.createDataFrame([], "id long, ts timestamp"))
    e.run("key x.id int; property x.id.seen datetime; datasource a (id: x.id, ts: ?x.seen) grain (x.id) address a;")
    assert [r.stale for r in freshness(e, "x.seen").collect()] == [False]


def test_ingest_takes_each_file_once(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    for start in (0, 10):
        spark.range(start, start + 10).write.mode("append").parquet(folder)
        ingest(spark, folder, "taken_in", state, "id long")
        ingest(spark, folder, "taken_in", state, "id long")
    assert sorted(r.id for r in spark.table("taken_in").collect()) == list(range(20))


def test_windows_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(i, at(i % 6, i % 50), "ab"[i // 6 % 2]) for i in range(60)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(folder)
    shape = lambda df: windowed(df, "ts", "1 hour", "2 hours", ["kind"], n=F.count("*"), top=F.max("id"))
    q = shape(spark.readStream.schema(EVENTS).parquet(folder)).writeStream.outputMode("complete").format("memory").queryName("by_hour").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, shape(spark.read.parquet(folder)).collect()))
    assert len(want) == 12 and sorted(map(tuple, spark.table("by_hour").collect())) == want
