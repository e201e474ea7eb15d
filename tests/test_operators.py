import random
import sqlite3
import time
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quire.operators import access, changes, exports, ingest, retrieval, spend
from quire.streaming.limits import Limit, judged, judged_stream


def ranked(spark, ids):
    return spark.createDataFrame([(x, n) for n, x in enumerate(ids, 1)], "id string, place int")


def test_fusion(spark):
    found = retrieval.fused(ranked(spark, ["doc1_chunk0", "doc1_chunk1"]), ranked(spark, ["doc1_chunk1", "doc2_chunk0"]), 2, "id").collect()
    assert [r["id"] for r in found] == ["doc1_chunk1", "doc1_chunk0"] and abs(found[0]["score"] - (1 / 62 + 1 / 61)) < 1e-12


def test_visibility_and_totals(spark):
    rows = [("1", "A", 20000, 100, 50, "COMPLETED", 2), ("2", "B", 50000, 200, 100, "FAILED", 1), ("3", None, 10000, 50, 20, "COMPLETED", 3)]
    docs = spark.createDataFrame(rows, "doc_uuid string, uploaded_by_id string, cost_micro long, input_tokens long, output_tokens long, status string, page_count int")
    assert spend.totals(access.scoped(docs, "A")).first().asDict() == {"cost_micro": 30000, "input_tokens": 150, "output_tokens": 70, "tokens": 220, "pages": 5}
    assert [access.scoped(docs, u, s).count() for u, s in (("A", False), (None, False), (None, True))] == [2, 1, 3]
    assert spend.totals(docs.filter("doc_uuid = 'none'")).first()["cost_micro"] == 0


def test_reaper(spark):
    now = 1781870400
    rows = [("a", "EXTRACTING", 0, now - 360), ("b", "PENDING", 3, now - 360), ("c", "EXTRACTING", 0, now - 120), ("d", "COMPLETED", 0, now - 999)]
    docs = spark.createDataFrame(rows, "id string, status string, retry_count int, s long").withColumn("updated_at", F.timestamp_seconds("s"))
    found = {r["id"]: (r["next_status"], r["next_retry"]) for r in changes.reaped(docs, access.stale(F.timestamp_seconds(F.lit(now)))).collect()}
    assert found == {"a": ("PENDING", 1), "b": ("FAILED", 3), "c": ("EXTRACTING", 0), "d": ("COMPLETED", 0)}


def test_retention(spark):
    docs = spark.createDataFrame([(1, "h1", True), (2, "h2", True), (3, "h2", True), (4, "h3", True), (5, "h3", False)], "doc_id long, file_hash string, expired boolean")
    found = changes.last_of_hash(docs, F.col("expired")).collect()
    assert len(found) == 4 and sorted(r["doc_id"] for r in found if r["delete_file"]) == [1, 3]


def test_networks(spark):
    df = spark.createDataFrame([("10.0.0.1, 35.199.3.4",), ("130.211.4.1",), ("130.211.3.9",), ("garbage",), (None,), ("35.199.1.999",)], "x string")
    assert [r[0] for r in df.select(access.in_networks("x", ["35.199.0.0/16", "130.211.0.0/22"])).collect()] == [True, False, True, False, False, False]


def test_partial_update_and_insert(spark):
    table = spark.createDataFrame([("a", "t", 1, 5), ("b", "u", 2, 5)], "k string, title string, n int, updated long")
    new = spark.createDataFrame([("a", None, 9)], "k string, title string, n int")
    rows = {r["k"]: tuple(r) for r in changes.updated(table, new, "k", F.lit(7).cast("long"), "updated").collect()}
    assert rows == {"a": ("a", "t", 9, 7), "b": ("b", "u", 2, 5)}
    more = spark.createDataFrame([("c", "malicious")], "k string, malicious_key string")
    assert changes.inserted(table, more).columns == table.columns and changes.inserted(table, more).count() == 3


def test_uploads(spark):
    docs = spark.createDataFrame([(1, "h1", "COMPLETED", "me", 0), (2, "h2", "COMPLETED", "other", 0), (3, "h3", "FAILED", "me", 3), (4, "h4", "PENDING", None, 0), (5, "h6", "FAILED", "x", 1)], "doc_id long, file_hash string, status string, uploaded_by_id string, retry_count int").withColumn("created_s", F.col("doc_id"))
    uploads = spark.createDataFrame([(1, n, h, "me", ok) for n, (h, ok) in enumerate([("h1", True), ("h2", True), ("h3", True), ("h4", True), ("h5", True), ("h5", True), ("h6", True), ("h7", False)])], "batch int, seq int, file_hash string, actor string, fine boolean")
    found = {r["seq"]: r["decision"] for r in changes.upload_decisions(uploads, docs, F.col("fine")).collect()}
    assert [found[n] for n in range(8)] == ["cached", "clone", "exhausted", "busy", "fresh", "duplicate", "retry", "invalid"]


def test_uploads_of_a_common_file(spark):
    """A third of the rows share one hash: known rows come down to one for the hash and one for each owner."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'h' || id END AS file_hash", "CASE WHEN id = 2999 - 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status", "'u' || id % 50 AS uploaded_by_id", "0 AS retry_count", "id AS created_s")
    uploads = spark.range(3000).selectExpr("id % 7 AS batch", "id AS seq", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'new' || id END AS file_hash", "'u' || id % 100 AS actor", "true AS fine")
    found = changes.upload_decisions(uploads, docs, F.col("fine"))
    assert found.count() == 3000
    hot = {r["seq"]: r for r in found.filter("file_hash = 'hot'").collect()}
    firsts = {b: min(s for s in hot if s % 7 == b) for b in range(7)}
    for s, r in hot.items():
        assert r["decision"] == ("duplicate" if s != firsts[s % 7] else "cached" if s % 100 < 50 else "clone")


def chunks(spark):
    docs = spark.createDataFrame([("d1", 1, "Tafsir Book", "Author", "English", "text one. attributes of things", "h", 1), ("d2", 2, "Tafsir Book", None, "English", "second text", "h2", 1)], "doc_uuid string, doc_id long, title string, author string, language string, raw_markdown string, file_hash string, page_count int")
    return docs, ingest.chunked(docs)


def test_exports(spark, tmp_path):
    docs, rows = chunks(spark)
    pairs = exports.training_pairs(rows, docs, 5).collect()
    assert len(pairs) == 2 and len(pairs[0]["messages"]) == 3 and pairs[0]["metadata"]["title"] == "Tafsir Book" and pairs[0]["prompt"].startswith("Context from 'Tafsir Book' by Author (Page 1):\n\n")
    with pytest.raises(ValueError, match="more than 1 files"):
        exports.zipped(exports.bundle(docs), most=1)
    names = zipfile.ZipFile(BytesIO(exports.zipped(exports.bundle(docs)))).namelist()
    assert "documents/001_tafsir-book.md" in names and "documents/002_tafsir-book.md" in names and "Language/English/tafsir-book_2.md" in names
    path = str(tmp_path / "x.sqlite")
    exports.sqlite_file(docs, rows, path)
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*) FROM chunks_fts WHERE chunks_fts MATCH 'attribute'").fetchone() == (1,)
        assert con.execute("SELECT count(*) FROM documents").fetchone() == (2,)


def test_embedding_reuse_calls_provider_once_a_text(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "known")], "chunk_id string, content string")
    known = spark.createDataFrame([("known", [7.0])], "content string, embedding array<double>")
    provider = lambda c: F.array(F.length(c).cast("double"))
    found = {r["chunk_id"]: r["embedding"] for r in ingest.embedded_reusing(rows, known, provider=provider).collect()}
    assert found == {"a": [1.0], "b": [1.0], "c": [1.0], "d": [7.0]}


def test_pieces_and_refinement(spark):
    text = "intro\n\n" + "word " * 100 + "\n## Part\n" + "more " * 100
    both = "a" * 82 + "\n# x\n" + "b" * 5 + "\n\n" + "c" * 60  # a later break of another kind wins
    assert ingest.split_long(both, 100) == [both[:92].strip(), both[92:].strip()] and ingest.split_long(" x ", 10) == [" x "]
    assert ingest.split_long(text, 600)[1].startswith("## Part") and "".join(ingest.split_long("x" * 25, 10)) == "x" * 25
    docs = spark.createDataFrame([("d", text), ("e", "short")], "doc_uuid string, raw_markdown string")
    shout = ingest.rejoined(ingest.generated(ingest.pieces(docs, most=600), lambda texts: [t.upper() for t in texts])).collect()
    assert {r["doc_uuid"]: r["refined_markdown"] for r in shout}["e"] == "SHORT"

    def broken(texts):
        raise RuntimeError("quota")

    assert all(r["failed"] and r["answer"] == r["content"] for r in ingest.generated(ingest.pieces(docs, most=600), broken).collect())


def test_context_block_and_cache(spark):
    docs, rows = chunks(spark)
    docs = docs.withColumns({c: F.lit("") for c in ("publisher", "publication_year", "license_type", "doi")})
    text = retrieval.with_documents(rows.drop("language"), docs).orderBy("doc_uuid").select(retrieval.block(F.lit(1))).first()[0]
    assert text == "--- BLOCK 1 [Source: Tafsir Book (Lang: English, Author: Author, Page: 1)] ---\ntext one. attributes of things"
    cached = spark.createDataFrame([("c", ["d2", "gone", "d1"])], "id string, sources array<string>")
    assert [x["title"] for x in retrieval.hydrated(cached, docs).first()["cited"]] == ["Tafsir Book", "Unknown", "Tafsir Book"]


def test_bm25_orders_by_rarity(spark):
    df = spark.createDataFrame([(1, "common common rare"), (2, "common words here"), (3, "nothing")], "id long, content string")
    assert [r["id"] for r in retrieval.bm25(df, ["common", "RARE"], "id", "content", 5).collect()] == [1, 2]


def test_limits(spark):
    assert Limit(2, 60).fold([0, 1, 2, 61])[0] == [True, True, False, True]
    assert Limit(2, 60, rearm=True).fold([0, 50, 100, 111])[0] == [True, True, False, True]
    random.seed(1)
    rows = [(random.choice("ab"), random.randint(0, 900), n) for n in range(200)]
    df = spark.createDataFrame(rows, "key string, at_s long, event_id long")
    for limit in (Limit(3, 60), Limit(3, 60, rearm=True)):
        got = {r["event_id"]: r["allowed"] for r in judged(df, limit).collect()}
        for key in "ab":
            own = sorted((t, n) for k, t, n in rows if k == key)
            assert [got[n] for _, n in own] == limit.fold([t for t, _ in own])[0]


def test_limit_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1), ("a", 10, 2), ("a", 20, 3), ("b", 5, 4)], "key string, at_s long, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = judged_stream(stream, Limit(2, 60)).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    until = time.time() + 90
    while run.isActive and time.time() < until:
        time.sleep(0.2)
    run.stop()
    assert {r["event_id"]: r["allowed"] for r in spark.table("limited").collect()} == {1: True, 2: True, 3: False, 4: True}
