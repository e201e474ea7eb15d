import json

import pytest
from pyspark.sql import functions as F

from quire.sources import feeds


@pytest.fixture
def folder(tmp_path):
    def put(name, value):
        path = tmp_path / "feed" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value if isinstance(value, str) else json.dumps(value))

    listed = lambda *rows: {"data": [{"id": i, "pricing": {"prompt": p, "completion": c}} for i, p, c in rows]}
    put("2024-01-01.json", listed(("Maker/A", "0.1", "0.2"), ("maker/b", "1", "bad")))
    put("2024-01-02.json", listed(("maker/a", "0.3", "0.4")))
    put("2024-01-03.json", "no json")
    put("2024-01-04.json", "")
    put("_SUCCESS", "x")
    return str(tmp_path / "feed"), put, listed


def rows(df):
    return sorted((r["snapshot"], r["model"], float(r["prompt"]), r["completion"] and float(r["completion"])) for r in df.collect())


def test_batch_and_stream_give_the_same_rows(spark, folder, tmp_path):
    path, put, listed = folder
    spark.dataSource.register(feeds.SnapshotSource)
    batch = lambda: rows(feeds.prices(spark.read.format("snapshots").option("filesPerTask", "1").load(path)))

    def stream():
        read = spark.readStream.format("snapshots").load(path)
        out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
        feeds.prices(read).writeStream.option("checkpointLocation", marks).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(out))

    first = batch()
    assert first == [("2024-01-01.json", "maker/a", 0.1, 0.2), ("2024-01-01.json", "maker/b", 1.0, None), ("2024-01-02.json", "maker/a", 0.3, 0.4)] == stream()
    put("2024-01-05.json", listed(("maker/b", "7", "8")))
    assert stream() == batch() == [*first, ("2024-01-05.json", "maker/b", 7.0, 8.0)]  # the restarted stream reads the new one alone
    last = feeds.newest(feeds.prices(spark.read.format("snapshots").load(path)), "model")
    assert {r["model"]: (r["snapshot"], float(r["prompt"])) for r in last.collect()} == {"maker/a": ("2024-01-02.json", 0.3), "maker/b": ("2024-01-05.json", 7.0)}
    assert spark.read.format("snapshots").load(path + "/none").count() == 0


def test_rates_and_logs(spark, folder):
    path, put, _ = folder
    spark.dataSource.register(feeds.SnapshotSource)
    put("rates/1.json", {"rates": {"EUR": 0.9, "XXX": 0}})
    got = feeds.rates(spark.read.format("snapshots").load(path + "/rates"))
    assert [tuple(r) for r in got.collect()] == [("1.json", "EUR", 0.9)]
    live = F.create_map(F.lit("EUR"), F.lit(0.9))
    assert tuple(spark.range(1).select(feeds.rate_of(F.lit("EUR"), live), feeds.rate_of(F.lit("GBP"), live), feeds.rate_of(F.lit("???"))).first()) == (0.9, 0.79, None)
    entries = [
        {"timestamp": "2024-01-01T00:00:02Z", "severity": "ERROR", "textPayload": "boom"},
        {"timestamp": "2024-01-01T00:00:01Z", "httpRequest": {"requestUrl": "https://x.org/a?b=1", "status": 200, "latency": "0.1s"}},
        {"timestamp": "2024-01-01T00:00:03Z", "textPayload": "", "jsonPayload": {"message": "said"}},
        {"timestamp": "x", "protoPayload": {"resourceName": "thing"}},
    ]
    put("logs/1.json", entries)
    found = feeds.log_entries(spark.read.format("snapshots").load(path + "/logs"))
    assert [(r["severity"], r["message"]) for r in feeds.newest_entries(found, 3).collect()] == [("DEFAULT", "HTTP GET /a?b=1 - Status: 200 - Latency: 0.1s"), ("ERROR", "boom"), ("DEFAULT", "said")]
    assert found.filter("at is null").first()["message"] == "thing"
