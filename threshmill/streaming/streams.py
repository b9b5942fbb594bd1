"""Structured Streaming forms. Operators R1-R4, and event-time extensions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threshmill.operators.gate import ShareGate


def read_log(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts with a watermark; late rows beyond it are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def error_alarm(logs: DataFrame, ts: str, source: str, mark: str, size: str = "3 minutes", slide: str = "1 minute", least: int = 5) -> DataFrame:
    """R2: windows in which more than `least` sources logged the mark."""
    hits = logs.where(F.col("message").contains(mark)).withWatermark(ts, "1 minute")
    return hits.groupBy(F.window(ts, size, slide).alias("w")).agg(F.size(F.collect_set(source)).alias("n")).where(F.col("n") > least).select(F.col("w.start").alias("start"), "n")


def gated(items: DataFrame, key: str, domain: str, seq: str) -> DataFrame:
    """The share gate with memory of what it accepted; rows of a micro-batch go in order of seq."""
    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = ShareGate(str(k[0])[:2])
        if state.exists:
            total, names, counts = state.get
            gate.total, gate.of_domain = total, dict(zip(names, counts, strict=True))
        part = pd.concat(list(batches)).sort_values(seq)
        part["accepted"] = [gate.accept(d) for d in part[domain]]
        held = gate.of_domain or {}
        state.update((gate.total, list(held), list(held.values())))
        yield part[[key, seq, "accepted"]]

    return items.select(key, domain, seq).groupBy(key).applyInPandasWithState(step, f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, accepted boolean", "total long, names array<string>, counts array<long>", "append", GroupStateTimeout.NoTimeout)


def merge_into(path: str, key: str, seq: str):
    """A foreachBatch sink; each batch is written once under its number, so a repeated batch changes nothing. `merged` reads it."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def merged(spark: SparkSession, path: str, key: str, seq: str) -> DataFrame:
    """The last row of each key over all batches."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("batch", seq)).alias("r")).select(key, "r.*")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All available input into a table in memory: for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All available input into files, then read: each row once, however often the run is restarted."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, write, checkpoint: str) -> None:
    """All available input through a foreachBatch sink."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
