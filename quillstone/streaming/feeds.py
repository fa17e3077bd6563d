"""Structured Streaming: change feeds, sessions and windowed counts."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.changefeed import DELETE_OP, plain, replay, valid_changes
from quillstone.operators.sessions import Slots
from quillstone.session import remove

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_changes(changes: DataFrame, state_path: str, checkpoint: str):
    """Keeps the replay state of a streamed change feed in numbered Parquet folders; each batch goes on from the last one.

    A batch that is run again writes its own number again, so results don't change. Returns the started query.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        prior = spark.read.parquet(f"{state_path}/{number - 1}") if number else None
        feed = valid_changes(batch).select("product_id", "seq", "log_pos", plain(F.col("op")).alias("op"))
        replay(feed, "product_id", F.col("op") != DELETE_OP, prior=prior).write.mode("overwrite").parquet(f"{state_path}/{number}")
        if number > 1:  # a batch that is run again needs the state before its own, and none before that
            remove(spark, f"{state_path}/{number - 2}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def carried_code() -> Iterator[None]:
    """While it is open, functions travel with their code: the process that sets up state doesn't get shipped files."""
    package = sys.modules["quillstone"]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


class SessionProcessor(StatefulProcessor):
    """Folds the turns of a session as they come; state is kept for each session and expires if asked to."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", "turns long, seen array<string>, excluded array<string>", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turns, seen, excluded = self.state.get() if self.state.exists() else (0, [], [])
        slots = Slots(seen, excluded)
        for frame in rows:
            for text in frame.sort_values("turn")["text"]:
                slots.take(text)
                turns += 1
        self.state.update((turns, slots.seen, slots.excluded))
        yield pd.DataFrame([(key[0], turns, slots.seen, slots.excluded)], columns=["session_id", "turns", "seen", "excluded"])

    def close(self) -> None:
        pass


def stream_sessions(turns: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(session_id, turns, seen, excluded) after each batch of a streamed turns(session_id, turn, text); needs the RocksDB state store."""
    return turns.groupBy("session_id").transformWithStateInPandas(SessionProcessor(ttl_ms), "session_id string, turns long, seen array<string>, excluded array<string>", "Update", "ProcessingTime" if ttl_ms else "None")


def windowed_counts(events: DataFrame, time: str, group: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, group, n, total) of tumbling windows. In a stream, rows later than the watermark may be dropped; a table has no late rows."""
    marked = _timed(events, time).withWatermark(time, late) if events.isStreaming else events
    counts = marked.groupBy(F.window(time, window).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").cast(events.schema[time].dataType).alias("start"), group, "n", "total")


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Event times as instants, which watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark of a stream, or once at all in a table."""
    return _timed(events, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def run_to_memory(stream: DataFrame, spark: SparkSession, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now and returns its result; for tests and reports of bounded size."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def run_to_table(stream: DataFrame, mode: str, at: str) -> DataFrame:
    """Runs a stream over what is there now, and returns what it wrote to the folder at: the last batch of a complete result,
    all batches of one that is appended to."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(f"{at}/out")
