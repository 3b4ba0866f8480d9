"""Streaming: incremental indexing of a feed of files, and event-time helpers for feeds of events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from quarry.sources.store import Store

INTERVAL, PAUSE_AFTER = "60 seconds", 3


class Backoff:
    """Lets a step fail: after ``pause_after`` failures in a row it stops, and between them waits twice as long each time."""

    def __init__(self, step: Callable[[DataFrame, int], None], pause_after: int = PAUSE_AFTER, interval_s: float = 1.0) -> None:
        self.step, self.pause_after, self.interval_s = step, pause_after, interval_s
        self.failures = 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        while True:
            try:
                self.step(batch, number)
                self.failures = 0
                return
            except Exception:
                self.failures += 1
                if self.failures >= self.pause_after:
                    raise
                time.sleep(self.interval_s * 2 ** (self.failures - 1))


def incremental_index(store: Store, chunk: Callable[[DataFrame], DataFrame], feed: str | None = None) -> Callable[[DataFrame, int], None]:
    """A step that replaces the chunks of a batch of files(path, text) in the store; the latest version of a path counts.

    ``feed`` names the stream, and its checkpoint, in the store: the manifest that a batch makes records the batch's
    number, so one that is handed over again after a crash is known and left out, and a build goes on where it stopped.
    """

    def step(batch: DataFrame, number: int) -> None:
        if done(store, feed, number) or batch.isEmpty():
            return
        w = Window.partitionBy("path").orderBy(F.col("modified_ms").desc(), F.col("text"))
        latest = batch.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
        marks = {feed: number} if feed else None
        with store.lock():
            new = chunk(latest.filter("text IS NOT NULL"))
            if store.manifest() is None:
                store.publish(store.write(new), marks=marks)
            else:
                store.replace_files(new, latest.select(F.col("path").alias("file")), marks=marks)

    return step


def appended(store: Store, feed: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A step that adds a batch's rows to the store, once whatever happens: rows and the batch's number are one commit."""

    def step(batch: DataFrame, number: int) -> None:
        if done(store, feed, number):
            return
        with store.lock():
            if store.manifest() is None:
                store.publish(store.write(rows(batch)), marks={feed: number})
            else:
                store.add(rows(batch), marks={feed: number})

    return step


def done(store: Store, feed: str | None, number: int) -> bool:
    """Whether the store has a batch of a feed already."""
    return feed is not None and (store.manifest() or {}).get("marks", {}).get(feed, -1) >= number


def watch(feed: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = INTERVAL) -> StreamingQuery:
    """Run step on every batch of a streaming feed; ticks that overlap are one batch. Without interval all there is now, then it ends."""
    writer = feed.writeStream.foreachBatch(Backoff(step)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def file_feed(spark: SparkSession, path: str, schema: str = "path string, text string, modified_ms long", per_batch: int = 1000) -> DataFrame:
    """A stream of Parquet files of rows (path, text, modified_ms)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


class Progress(StreamingQueryListener):
    """Hands rows, rate and time of every batch to a callback."""

    def __init__(self, report: Callable[[dict], None]) -> None:
        self.report = report

    def onQueryStarted(self, event) -> None:
        self.report({"phase": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report({"phase": "batch", "batch": p.batchId, "rows": p.numInputRows, "rows_per_s": p.processedRowsPerSecond, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        self.report({"phase": "idle"})

    def onQueryTerminated(self, event) -> None:
        self.report({"phase": "ended", "error": event.exception})


# Event time; each works on a stream (with a watermark) and on a table alike.


def windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str | None = None, by: list[str] | None = None, ts: str = "ts", value: str = "value") -> DataFrame:
    """start, by, n, total, users of tumbling or sliding windows."""
    e = events.withWatermark(ts, late) if late else events
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return e.groupBy(span.alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *(by or []), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None, by: str = "user_id", ts: str = "ts") -> DataFrame:
    """by, start, end, n of sessions that end after a gap."""
    e = events.withWatermark(ts, late) if late else events
    s = e.groupBy(F.col(by), F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def latest_state(events: DataFrame, by: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last row of each key of a table; a partial maximum, no sort of a key's rows."""
    rest = [c for c in events.columns if c not in (by, ts, tie)]
    best = events.groupBy(by).agg(F.max(F.struct(ts, tie, *rest)).alias("m"))
    return best.select(by, "m.*")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 day", ts: str = "ts") -> DataFrame:
    """The first of equal rows within the watermark, for streams."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
