"""Settings, invalidation, back-off and cascade, re-embedding, stale files and triggered jobs."""

import pytest
from pyspark.sql import functions as F

from quire.operators import ingest, upkeep

SETTINGS = "selected_model string, currency string, monthly_budget_usd string, openrouter_api_key string"


def test_settings(spark):
    now = spark.createDataFrame([("auto", "auto", "10", "old")], SETTINGS)
    asked = spark.createDataFrame(
        [(1, "openrouter/free", "USD", "5", "new"), (2, "openrouter/auto", "SAR", "7.5", upkeep.MASKED), (3, "other", "USD", "1", "x"), (4, "auto", "EUR", "1", "x"), (5, "auto", "USD", "-1", "x"), (6, "auto", "USD", "ten", "x"), (7, None, None, None, None)],
        f"n int, {SETTINGS}",
    )
    problems = [r[0] for r in asked.orderBy("n").select(upkeep.settings_problem(F.col("selected_model"), F.col("currency"), F.col("monthly_budget_usd"))).collect()]
    assert problems == [None, None, "model", "currency", "budget", "budget", "model"]
    assert [tuple(r) for r in upkeep.saved_settings(now, asked, "n").collect()] == [("openrouter/auto", "SAR", "7.5", "new")]
    assert [tuple(r) for r in upkeep.saved_settings(now, asked.filter("n > 2"), "n").collect()] == [("auto", "auto", "10", "old")]


def test_invalidation(spark):
    entries = spark.createDataFrame([("rag_search_cache:a", 1), ("lock:a", 2)], "cache_key string, v int")
    answers = spark.createDataFrame([("q",)], "question string")
    change = lambda *rows: spark.createDataFrame(list(rows), "status string, deleted boolean")
    for rows, kept in (([("COMPLETED", False)], (1, 0)), ([("PENDING", True)], (1, 0)), ([("FAILED", None)], (2, 1)), ([], (2, 1))):
        assert tuple(x.count() for x in upkeep.invalidated(entries, answers, change(*rows))) == kept


def test_backoff_and_cascade():
    waits, calls = [], []

    def limited(text):
        calls.append(text)
        if len(calls) < 4:
            raise ValueError("429 Too Many" if len(calls) != 2 else "quota: please retry in 2.5s")
        return text.upper()

    assert upkeep.with_backoff(limited, "x", sleep=waits.append) == "X" and waits == [5, 4.0, 10]
    with pytest.raises(ValueError, match="broken"):
        upkeep.with_backoff(lambda _: (_ for _ in ()).throw(ValueError("broken")), "x", sleep=waits.append)
    waits.clear()

    def busy(_):
        raise ValueError("rate limit")

    with pytest.raises(ValueError, match="rate limit"):
        upkeep.with_backoff(busy, "x", sleep=waits.append)
    assert waits == [5, 10, 20, 40]

    def gone(_):
        raise ValueError("404 model not found")

    assert upkeep.cascade({"a": gone, "b": busy, "c": str.upper}, sleep=waits.append)(["x", "y"]) == ["X", "Y"]
    with pytest.raises(ValueError, match="other"):
        upkeep.cascade({"a": _other, "b": str.upper})(["x"])


def _other(_):
    raise ValueError("other")


def test_reembedding(spark):
    docs = spark.createDataFrame([("a", "English", "new text", 0), ("b", "English", "same", 3), ("c", "English", "", 2)], "doc_uuid string, language string, raw_markdown string, page_count int")
    docs = docs.withColumns({"status": F.lit("FAILED"), "expires_at": F.lit(None).cast("timestamp")})
    old = ingest.embedded(ingest.chunked(docs.withColumn("raw_markdown", F.lit("old"))))
    after, rows = ingest.reembedded(docs, old, spark.createDataFrame([("a",), ("c",), ("c",)], "doc_uuid string"), F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r["doc_uuid"], r["content"]) for r in rows.collect()) == [("a", "new text"), ("b", "old")]
    assert {r["doc_uuid"]: (r["status"], r["page_count"]) for r in after.collect()} == {"a": ("COMPLETED", 1), "b": ("FAILED", 3), "c": ("COMPLETED", 2)}


def test_stale_files(spark, tmp_path):
    import os

    for name, age in (("tmpx1", 100_000), ("tmp2", 10), ("pdf_export_3", 90_000), ("keep", 90_000)):
        path = tmp_path / name
        path.write_text("x")
        os.utime(path, (1_700_000_000 - age,) * 2)
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "modificationTime", "length")
    found = upkeep.stale_files(listed, F.timestamp_seconds(F.lit(1_700_000_000)))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["pdf_export_3", "tmpx1"]


def test_triggered_job(spark, tmp_path):
    runs = []
    query = upkeep.every(spark, lambda s: runs.append(s.range(3).count()), 1, str(tmp_path / "ticks"))
    try:
        for _ in range(60):
            if len(runs) >= 2:
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert len(runs) >= 2 and set(runs) == {3}


def test_current_settings(spark):
    stored = spark.createDataFrame([(2, 5, "m2", "USD"), (1, None, "m1", None)], "id int, monthly_budget_micro long, selected_model string, currency string")
    assert tuple(upkeep.current_settings(stored, "id").first()) == (10_000_000, "m1", "auto")
    assert tuple(upkeep.current_settings(stored.filter("id > 5"), "id").first()) == (10_000_000, "auto", "auto")


def test_long_texts_are_cut_at_borders_in_the_last_fifth():
    assert ingest.split_long("abc", 3) == ["abc"] and ingest.split_long("abcdefg", 3) == ["abc", "def", "g"]
    assert ingest.split_long("aaaaaaaa\n# bbbbbbbb", 10) == ["aaaaaaaa\n#", "bbbbbbbb"]  # the border must end within the window
    assert ingest.split_long("aaaaaaaa\n\nbbbbb\n## cc", 10) == ["aaaaaaaa", "bbbbb\n## c", "c"]
    assert ingest.split_long("a\n\naaaaaaaaa", 10) == ["a\n\naaaaaaa", "aa"]  # too early
    assert ingest.split_long("aaaaaaaaaa" + " " * 30, 10) == ["aaaaaaaaaa"] and ingest.split_long(" " * 30, 10) == [""]
    long = "word " * 300_000
    assert "".join(ingest.split_long(long, 1000)).replace(" ", "") == long.replace(" ", "")
