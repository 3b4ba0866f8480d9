"""Streams that are stopped and started again: state goes on, and every row counts once."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.sources.store import Store
from quarry.streaming import state, watch

EVENTS = "user_id long, ts timestamp, event_id long, kind string, value double"


def put(spark, path, rows):
    spark.createDataFrame(rows, "user_id long, s long, event_id long, kind string, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id", "kind", "value").coalesce(1).write.mode("append").parquet(path)


def test_state_goes_on_after_a_restart(spark, tmp_path):
    """Batches over three runs of a query against one checkpoint; keys that are idle for 100 s of event time are forgotten."""
    feed, got, rng = str(tmp_path / "feed"), [], random.Random(3)
    want, seen = {}, []

    def run():
        changes = state.latest(spark.readStream.schema(EVENTS).parquet(feed), late="10 seconds", idle_ms=100_000)
        with state.state_store(spark):
            q = changes.writeStream.outputMode("update").foreachBatch(lambda b, n: got.extend((r, n) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    number = 0
    for start in (1000, 1040, 1060):
        rows = []
        for _ in range(30):
            number += 1
            rows.append((rng.randrange(5), start + rng.randrange(8), number, rng.choice("xyz"), number / 7))
        seen += rows
        put(spark, feed, rows)
        run()
        for r in seen:
            if r[0] not in want or (r[1], r[2]) > (want[r[0]][1], want[r[0]][2]):
                want[r[0]] = r
        last = {}
        for r, _ in got:
            last[r.user_id] = (r.user_id, int(r.ts.timestamp()), r.event_id, r.kind, r.value)
        assert last == want
    assert not any(r.expired for r, _ in got)
    put(spark, feed, [(9, 5000, 10_000, "x", 0.0)])  # so late that all others have been idle
    run()
    put(spark, feed, [(0, 5001, 10_001, "y", 1.0)])  # known no more, so it starts anew
    run()
    gone = {r.user_id for r, _ in got if r.expired}
    assert gone == set(want) and not any(r.user_id == 9 and r.expired for r, _ in got)
    assert (got[-1][0].user_id, got[-1][0].event_id, got[-1][0].expired) == (0, 10_001, False)


ROWS = "id string, content string, file string, start int, end int"


@pytest.mark.parametrize("crash", ["before", "after"])
def test_each_row_once_after_a_crash(spark, tmp_path, crash):
    """A step that dies before or after its commit is run again by the next query; what it wrote counts once."""
    feed, s, left = str(tmp_path / "feed"), Store(spark, str(tmp_path / "t")), [2]
    for i in range(3):
        spark.createDataFrame([(f"{i}-{k}", f"text {k}", f"f{k}", 1, 1) for k in range(5)], ROWS).coalesce(1).write.mode("append").parquet(feed)
    step = watch.appended(s, "feed")

    def dying(batch, number):
        if crash == "after":
            step(batch, number)
        if number == 1 and left[0]:
            left[0] -= 1
            raise OSError("gone")
        step(batch, number)

    def run():
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(feed)
        q = stream.writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="gone"):
            run()
    run()
    assert sorted(r.id for r in s.read().collect()) == sorted(f"{i}-{k}" for i in range(3) for k in range(5))
    assert s.manifest()["marks"] == {"feed": 2} and s.manifest()["version"] == 3


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    """Batches that the manifest knows aren't chunked again."""
    s, asked = Store(spark, str(tmp_path / "t")), []

    def chunk(f):
        asked.append(sorted(r.path for r in f.collect()))
        return f.select(F.col("path").alias("id"), F.col("text").alias("content"), F.col("path").alias("file"), F.lit(1).alias("start"), F.lit(1).alias("end"))

    step = watch.incremental_index(s, chunk, "build")
    batches = [spark.createDataFrame([(f"{n}{k}", "t", 1) for k in "ab"], "path string, text string, modified_ms long") for n in range(3)]
    for n in (0, 1):
        step(batches[n], n)
    for n in range(3):  # from the start, as after a lost checkpoint
        step(batches[n], n)
    assert asked == [["0a", "0b"], ["1a", "1b"], ["2a", "2b"]] and s.read().count() == 6
