import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quire.streaming.entries import Entries, entries_stream, live_entries, status_changes, status_feed

KINDS = "cache_key string, value string, ttl_s long, at_s long, event_id long"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def fed(spark, folder, marks, out, build, kinds):
    """Runs the stream over the files that are there and ends; what it has told so far."""
    read = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).json(folder).withColumn("at", F.timestamp_seconds("at_s"))
    build(read).writeStream.option("checkpointLocation", marks).format("parquet").option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def put(spark, rows, kinds, folder):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").json(folder)


def test_entries_as_in_batch_after_a_restart(rocks, tmp_path):
    spark, (folder, marks, out) = rocks, (str(tmp_path / n) for n in ("in", "marks", "out"))
    r = random.Random(1)
    writes = [(f"k{r.randrange(8)}", f"v{n}", r.choice([None, 30, 200, 1000]), 1000 + 7 * n + r.randrange(5), n) for n in range(60)]
    late = [("k1", "old", 5, 900, -1)]  # older than what is there
    for some in (writes[:20], writes[20:40] + late):
        put(spark, some, KINDS, folder)
    fed(spark, folder, marks, out, entries_stream, KINDS)
    put(spark, writes[40:], KINDS, folder)
    put(spark, [("clock", "x", None, 9000, 100)], KINDS, folder)
    put(spark, [("clock", "y", None, 9001, 101)], KINDS, folder)
    told = fed(spark, folder, marks, out, entries_stream, KINDS)  # from the checkpoint
    now = 8940  # the watermark
    batch = live_entries(spark.createDataFrame([*writes, *late, ("clock", "y", None, 9001, 101)], KINDS).withColumn("at", F.timestamp_seconds("at_s")), now)
    sets = {(x["cache_key"], x["value"]) for x in told.filter("change = 'set'").collect()}
    purged = {(x["cache_key"], x["value"]) for x in told.filter("change = 'purged'").collect()}
    last = {}
    for k, v, ttl, at, n in sorted(writes, key=lambda w: (w[3], w[4])):
        last[k] = (v, ttl)
    live = {(x["cache_key"], x["value"]) for x in batch.collect()}
    assert live == {(k, v) for k, (v, ttl) in last.items() if ttl is None} | {("clock", "y")} and live <= sets
    assert {(k, v) for k, (v, ttl) in last.items() if ttl is not None} <= purged and not purged & live
    assert ("k1", "old") not in sets


def test_status_feed_as_in_batch_after_a_restart(rocks, tmp_path):
    spark, (folder, marks, out) = rocks, (str(tmp_path / n) for n in ("in", "marks", "out"))
    kinds = "doc_uuid string, status string, at_s long, event_id long"
    r = random.Random(2)
    seen = [(f"d{r.randrange(5)}", r.choice(["PENDING", "EXTRACTING", "COMPLETED"]), 100 + n // 2, n) for n in range(80)]
    put(spark, seen[:30], kinds, folder)
    fed(spark, folder, marks, out, status_feed, kinds)
    put(spark, seen[30:], kinds, folder)
    put(spark, seen[:10], kinds, folder)  # told before
    got = fed(spark, folder, marks, out, status_feed, kinds)
    want = status_changes(spark.createDataFrame(seen, kinds).withColumn("at", F.timestamp_seconds("at_s")))
    key = lambda df: sorted((x["doc_uuid"], x["at"], str(x["before"]), x["status"]) for x in df.collect())
    assert key(got) == key(want)


def test_a_new_key_takes_few_calls_to_its_state():
    calls, held = [], []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, *a)) or ([] if name == "listTimers" else self)

        def get(self):
            calls.append(("get",))
            return held[-1] if held else None

        def update(self, value):
            calls.append(("update", value))
            held.append(value)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    entries = Entries()
    entries.init(Handle())
    calls.clear()
    row = Row("value", "event_id", "written_ms", "expires_ms")
    told = list(entries.handleInputRows(("k",), iter([row("b", 2, 10, 50), row("a", 1, 10, 90), row("c", 3, 9, None)]), Times()))
    assert [tuple(r) for r in told] == [("k", "b", 50, "set")] and [c[0] for c in calls] == ["get", "update", "registerTimer"]
    assert not list(entries.handleInputRows(("k",), iter([row("b", 2, 10, 50)]), Times()))
    calls.clear()
    assert [tuple(r) for r in entries.handleInputRows(("k",), iter([row("d", 4, 11, None)]), Times())] == [("k", "d", None, "set")]
    assert [c[0] for c in calls] == ["get", "listTimers", "update"]
