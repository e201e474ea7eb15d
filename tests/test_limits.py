import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import limits
from quire.streaming.limits import EXPORT, SEARCH, Limit, judged_spread


def plain(rows, limit):
    """Keys, times and event ids folded in order."""
    out, by_key = {}, {}
    for k, t, e in sorted(rows, key=lambda r: (r[1], r[2])):
        by_key.setdefault(k, []).append((t, e))
    for k, some in by_key.items():
        for (t, e), ok in zip(some, limit.fold([t for t, _ in some])[0], strict=True):
            out[k, t, e] = ok
    return out


def busy_rows(seed, n=900, span=4000):
    r = random.Random(seed)
    rows = [("busy" if r.random() < 0.5 else None if r.random() < 0.1 else f"k{r.randrange(60)}", int(span * r.random() ** r.choice([1, 2])), i) for i in range(n)]
    return rows + [("twins", 5, 10_000 + i) for i in range(25)] + [("one", 7, 20_000)]


@pytest.mark.parametrize("limit", [SEARCH, EXPORT, Limit(3, 3600), Limit(1, 30, rearm=True), Limit(4, 9, rearm=True)], ids=str)
def test_spread_equals_the_fold(spark, limit):
    rows = busy_rows(limit.seconds)
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, at_s long, event_id long, n string").repartition(7)
    got = judged_spread(df, limit)
    assert got.columns == [*df.columns, "allowed"]
    assert {(r["key"], r["at_s"], r["event_id"]): r["allowed"] for r in got.collect()} == plain(rows, limit)


def test_a_key_without_pauses_spreads(spark):
    """Half of all rows have one key and no pause that would end a window early."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("busy", 3 * i, i) for i in range(3000)] + [(f"k{i % 900}", i, 5000 + i) for i in range(3000)]
        df = spark.createDataFrame(rows, "key string, at_s long, event_id long")
        assert {(r["key"], r["at_s"], r["event_id"]): r["allowed"] for r in judged_spread(df, SEARCH).collect()} == plain(rows, SEARCH)
        assert judged_spread(df.filter("false"), SEARCH).count() == 0
        assert df.repartitionByRange("key", "at_s").filter("key = 'busy'").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_tasks_grow_with_the_requests(spark, monkeypatch):
    """No join broadcasts requests or leaves them to as few tasks as their bytes would need."""
    monkeypatch.setattr(limits, "TASK_ROWS", 100)
    rows = busy_rows(3)
    got = judged_spread(spark.createDataFrame(rows, "key string, at_s long, event_id long"), SEARCH)
    plan = got._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and f"{-(-len(rows) // 100)}, REPARTITION_BY_NUM" in plan.replace("), ", ", ")
    assert {(r["key"], r["at_s"], r["event_id"]): r["allowed"] for r in got.collect()} == plain(rows, SEARCH)
