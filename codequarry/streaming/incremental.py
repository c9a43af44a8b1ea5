"""Incremental analysis of a stream of files (Z1), cancellable runs (Z8, Z9), and event-time windows as an extension."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cache import FactCache
from ..extract.driver import extract_files


def update_facts(files: DataFrame, cache: FactCache, extract: Callable[[DataFrame], DataFrame] = extract_files) -> DataFrame:
    """Z1 in batch: facts of all files; only those whose content the cache doesn't know are extracted, and then added to it."""
    _, missing = cache.lookup(files)
    cache.add(extract(missing))
    return cache.lookup(files)[0]


def stream_facts(files: DataFrame, cache: FactCache, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = extract_files) -> StreamingQuery:
    """Z1 as a stream of ``files`` rows. A micro-batch that is replayed after a failure finds its facts in the cache and adds none."""

    def upsert(batch: DataFrame, _: int) -> None:
        latest = batch.dropDuplicates(["repo_key", "path", "content_hash"])
        cache.add(extract(cache.lookup(latest)[1]))

    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@contextmanager
def cancellable(spark: SparkSession, timeout_s: float | None = None) -> Iterator[str]:
    """What runs inside can be stopped by ``spark.interruptTag`` with the tag that is given, and is after ``timeout_s``."""
    tag = f"run-{uuid.uuid4().hex}"
    spark.addTag(tag)
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag)) if timeout_s else None
    try:
        if timer:
            timer.start()
        yield tag
    finally:
        if timer:
            timer.cancel()
        spark.removeTag(tag)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums of ``events`` by type in tumbling windows, with a watermark for late rows."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: sessions of each user that end after a ``gap`` without events."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
