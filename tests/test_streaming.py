from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from threshmill.operators.gate import share_gate
from threshmill.streaming import streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def events(spark, tmp_path):
    spark.read.parquet(EVENTS).repartition(2).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in")).withColumn("at", F.col("ts").cast("timestamp"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    return rows, spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("at", F.col("ts").cast("timestamp"))


def test_windows_equal_batch(spark, events, tmp_path):
    batch, stream = events
    got = streams.run_once(streams.windowed_counts(stream, "at", "event_type", late="60 days"), "w1", str(tmp_path / "c"), "complete")
    want = batch.groupBy(F.window("at", "1 hour").alias("w"), "event_type").count().select(F.col("w.start").alias("start"), "event_type", F.col("count").alias("n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_gate_equals_batch(spark, tmp_path):
    rows = [(f"{15 + i % 2}-0000", ["a.org", "b.org", "cdc.gov", "c.org"][i * i % 7 % 4], i) for i in range(80)]
    df = spark.createDataFrame(rows, "soc string, domain string, seq long")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = streams.read_log(spark, str(tmp_path / "in"), "soc string, domain string, seq long")
    got = streams.run_once(streams.gated(stream, "soc", "domain", "seq"), "g1", str(tmp_path / "c"))
    want = share_gate(df, "soc", "domain", "seq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_merge_is_repeatable(spark, tmp_path):
    write = streams.merge_into(str(tmp_path / "m"), "k", "seq")
    one, two = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "k int, seq int, v string"), spark.createDataFrame([(1, 3, "c")], "k int, seq int, v string")
    for batch, n in ((one, 0), (two, 1), (two, 1)):
        write(batch, n)
    assert sorted((r.k, r.v) for r in streams.merged(spark, str(tmp_path / "m"), "k", "seq").collect()) == [(1, "c"), (2, "b")]
