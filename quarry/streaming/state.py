"""State by key on a stream: the latest row of every key, kept between batches, with timers that let idle keys go.

State lives in Spark's store on the executors (RocksDB, with a change log in the query's checkpoint), so a key's state
survives restarts and lost executors, and no batch looks at keys that it has no rows of.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's runner of a stream has no files that were added to Spark

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which state by key with timers needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Latest(StatefulProcessor):
    """The greatest (at, tie) of each key with its body; ``idle_ms`` of event time after it the key is forgotten."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, tie long, body string")

    def _out(self, key: tuple, row: tuple, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [row[0]], "tie": [row[1]], "body": [row[2]], "expired": [expired]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.last.get() if self.last.exists() else None
        best = tuple(known) if known is not None else None
        for frame in rows:
            at = frame.sort_values(["at", "tie", "body"]).iloc[-1]
            row = (int(at["at"]), int(at["tie"]), str(at["body"]))
            best = row if best is None or row > best else best
        if known is not None and best == tuple(known):
            return
        if self.idle_ms is not None:
            if known is not None:
                self.handle.deleteTimer(known[0] // 1000 + self.idle_ms)
            self.handle.registerTimer(best[0] // 1000 + self.idle_ms)
        self.last.update(best)
        yield self._out(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            row = tuple(self.last.get())
            self.last.clear()
            yield self._out(key, row, True)

    def close(self) -> None:
        pass


def latest(events: DataFrame, by: str = "user_id", ts: str = "ts", tie: str = "event_id", late: str = "1 day", idle_ms: int | None = None) -> DataFrame:
    """A stream of changes of each key's latest row: by, ts, tie (whole numbers), the other columns, expired.

    A batch gives one row for each key whose latest row has changed in it. With idle_ms a key is forgotten, and told as
    expired, once the watermark has passed its latest row by that; rows that come later than ``late`` are left out. Start
    the query inside state_store().
    """
    rest = [c for c in events.columns if c not in (by, ts, tie)]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    body = F.to_json(F.struct(*rest), _TIME) if rest else F.lit("{}")
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = rows.select(F.col(by).alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(tie).cast("long").alias("tie"), body.alias("body"))
    out = rows.groupBy("key").transformWithStateInPandas(Latest(idle_ms), f"key {kinds[by]}, at long, tie long, body string, expired boolean", "Update", "eventTime")
    parsed = F.from_json("body", ", ".join(f"`{c}` {kinds[c]}" for c in rest), _TIME) if rest else None
    own = [F.col("parsed").getField(c).alias(c) for c in rest]
    out = out.withColumn("parsed", parsed) if rest else out
    return out.select(F.col("key").alias(by), F.timestamp_micros("at").cast(kinds[ts]).alias(ts), F.col("tie").cast(kinds[tie]).alias(tie), *own, "expired")
