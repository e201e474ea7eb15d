"""Registered queries over all of their rows and whole texts."""

from pyspark.sql import functions as F

from quire.functions.vector import cosine_distance
from quire.operators import ingest, retrieval, spend
from quire.plans import lifecycle, queries, rows_only  # noqa: F401
from quire.plans.model import STATUSES, model
from quire.plans.registry import QUERIES
from quire.sources.files import csv_markdown

SMALL = "/root/testdata/sf0.001"


def test_status_counts_hold_all_documents(spark):
    found = {r["status"]: r["n"] for r in QUERIES["ag2_status_counts"](spark, SMALL).collect()}
    docs = model(spark, SMALL, "docs")
    assert found["EXTRACTING"] == docs.filter("status = 'EXTRACTING'").count() > 0 and sum(found.values()) == docs.count()
    none = spend.status_counts(docs.filter("status <> 'PENDING'"), STATUSES).filter("status = 'PENDING'").first()
    assert none["n"] == 0


def test_hybrid_serves_all_queries(spark):
    rows = spark.createDataFrame([("a", "d", 0, "One fish", [1.0, 0.0]), ("b", "d", 1, "two fish", [0.0, 1.0]), ("c", "e", 0, "red", [1.0, 1.0])], "chunk_id string, doc_uuid string, chunk_index int, content string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "FISH"), (2, [0.0, 1.0], "red"), (3, [0.0, 1.0], ""), (4, [1.0, 0.0], None)], "query_id long, query_vector array<double>, query_text string")
    hits = retrieval.keyword_hits_each(asked, rows, 2, ["doc_uuid", "chunk_index"]).collect()
    assert sorted((r["query_id"], r["chunk_id"], r["place"]) for r in hits) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]
    found = {}
    for r in retrieval.hybrid(rows, asked, 1, candidates=2).collect():
        found.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    assert found == {1: [("a", round(2 / 61, 9))], 2: [("c", round(1 / 62 + 1 / 61, 9))], 3: [("b", round(1 / 61, 9))], 4: [("a", round(1 / 61, 9))]}


def test_hybrid_query_asks_all_items_divisible_by_50(spark):
    asked = {r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").filter("item_id % 50 = 0").select("item_id").collect()}
    found = QUERIES["r3_hybrid_search"](spark, SMALL).collect()
    assert {r["query_id"] for r in found} == asked and len(found) == 5 * len(asked)


def test_cosine_distance_of_all_ids_divisible_by_50(spark):
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id").collect()]
    found = QUERIES["r1_cosine_distance"](spark, SMALL)
    assert found.count() == len(ids) * sum(i % 50 == 0 for i in ids) and {r[0] for r in found.select("query_id").distinct().collect()} == {i for i in ids if i % 50 == 0}


def test_whole_texts_are_guarded_chosen_and_routed(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    guarded = {r["doc_id"]: r["guarded"] for r in QUERIES["t18_csv_guard"](spark, SMALL).collect()}
    assert all((guarded[i] or "").endswith(t) for i, t in texts.items())
    assert {r["doc_id"]: r["content"] for r in QUERIES["t20_content"](spark, SMALL).collect()} == texts
    routed = {int(r["doc_uuid"]): len(r["raw_markdown"] or "") for r in QUERIES["src8_file_router"](spark, SMALL).select("doc_uuid", "raw_markdown").collect()}
    assert all(n >= 0.9 * len(texts[i].strip()) for i, n in routed.items()) and max(routed.values()) > 1000
    assert len(csv_markdown(("a,b\n" + "x" * 200_000 + ",2\n").encode())) > 200_000


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_months_of_several_years_are_booked_as_the_sql_has_them(spark, tmp_path):
    year = 366 * 48  # a document each half hour from 2024 on
    folder = _documents(spark, tmp_path, [(i, "x", "en", "s", 400) for i in (0, year, year + 1, 40 * 48)])
    found = [tuple(r) for r in QUERIES["ag8_spend_by_month"](spark, folder).orderBy("month").collect()]
    assert found == [(2024, 1, 3 * 425, 300, 75), (2024, 2, 425, 100, 25)]
    assert {r["year"] for r in spend.by_month(model(spark, folder, "docs")).collect()} == {2024, 2025}


def test_training_lines_have_no_limit(spark, tmp_path):
    folder = _documents(spark, tmp_path, [(i, "One line.", "en", "s", 9) for i in range(5)])
    lines = QUERIES["snk13_training_lines"](spark, folder)
    assert lines.count() == 5 and "GlobalLimit" not in lines._jdf.queryExecution().toString()


def test_only_every_third_text_is_guarded(spark, tmp_path):
    folder = _documents(spark, tmp_path, [(0, "+1", "en", "s", 2), (1, "+1", "en", "s", 2), (3, None, "en", "s", 0)])
    assert {r["doc_id"]: r["guarded"] for r in QUERIES["t18_csv_guard"](spark, folder).collect()} == {0: "' =+1", 1: "+1", 3: None}


def test_texts_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(3000).selectExpr("cast(id as string) AS doc_uuid", "'English' AS language", "'text' AS raw_markdown", "'text' AS content").coalesce(1)
    batch = F.pandas_udf(lambda texts: texts.map(lambda _: [float(len(texts))]), "array<double>")
    try:
        for step in (ingest.chunked, ingest.pieces, ingest.generated, ingest.embedded):
            spark.conf.set(name, "10000")
            step(docs, **({"provider": batch} if step is ingest.embedded else {}))
            assert spark.conf.get(name) == "1000"
        spark.conf.set(name, "10000")
        assert ingest.embedded(docs, provider=batch).agg(F.max(F.col("embedding")[0])).first()[0] == 1000
    finally:
        spark.conf.set(name, before)


def test_distances_of_blocks_equal_the_expression(spark):
    vectors = [[1.0, 0.0], [3.0, 4.0], [0.0, 0.0], [1.0, None], [1.0], [], None, [float("nan"), 1.0], [1e200, 1e200], [-3.0, -4.0], [1e-170, 1e-170], [float("inf"), 1.0], [2.0, 6.0]]
    ties = [[float(a), float(b)] for a in range(1, 30) for b in (0, 7, 24)]  # some distances are at the middle of two roundings
    rows = spark.createDataFrame(list(enumerate([*vectors, *ties, *vectors])), "vec_id long, embedding array<double>").union(spark.createDataFrame([(None, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>"))
    some = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    plain = rows.crossJoin(some).select("query_id", "vec_id", F.round(cosine_distance(F.col("query_vector"), F.col("embedding")), 6).alias("distance"))
    found = retrieval.distances(some, rows, "vec_id")
    told = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
    assert found.columns == plain.columns and told(found) == told(plain)
    assert retrieval.distances(some.filter("false"), rows, "vec_id").count() == retrieval.distances(some, rows.filter("false"), "vec_id").count() == 0
