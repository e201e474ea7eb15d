"""Registered queries over stored indexes (vectors, words, substrings) and per owner."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vector import hashed_embedding
from quire.operators import access, ingest, retrieval
from quire.operators.substring_index import SubstringIndex
from quire.operators.text_index import TextIndex
from quire.operators.vector_index import VectorIndex, recall_of
from quire.plans.model import NOW, model, raw
from quire.plans.registry import query
from quire.sources.tables import shared_folder, table

_COS = "1 - list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[]))"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = raw(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows, rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("sr5_index_all_lists", f"SELECT query_id, vec_id, place FROM (SELECT q.vec_id AS query_id, e.vec_id, cast(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) as int) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 10")
def sr5_all(spark, d):
    """The stored index with all its lists looked into, which is the exact search: every row is indexed."""
    rows, asked = _vectors(spark, d)
    index = VectorIndex.build(rows, _folder(spark, "vectors"), "vec_id")
    return index.search(asked, 10, probes=len(index.centres)).select("query_id", "vec_id", "place")


@query("sr5_index_recall", "SELECT cast(sum(least(10, (SELECT count(*) FROM embeddings))) as bigint) AS n_exact, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def sr5_recall(spark, d):
    """Recall of the ten nearest with the fitted number of lists, for all ids divisible by 50 against the exact search over all rows: whether it reaches 0.9."""
    rows, asked = _vectors(spark, d)
    index = VectorIndex.build(rows, _folder(spark, "vectors"), "vec_id")
    found = recall_of(index.search(asked, 10), retrieval.nearest(asked, rows, 10, "vec_id"), "vec_id")
    return found.agg(F.sum("n_exact").alias("n_exact"), (F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("reached"))


#: Vectors as rows of seven owners, a fifth of them without an end, the others ending within days of now.
_OWNED = f"SELECT vec_id, embedding, 'u' || cast(vec_id % 7 as string) AS user_id, CASE WHEN vec_id % 5 <> 0 THEN cast({NOW} + (vec_id % 11 - 5) * 86400 as bigint) END AS expires_at FROM embeddings"


def _owned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.sql(_OWNED.replace("FROM embeddings", "FROM {t}"), t=raw(spark, d, "embeddings"))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "user_id", F.col("embedding").alias("query_vector"))
    return rows.filter("vec_id % 50 <> 0"), asked


_NEAR = f"""WITH owned AS ({_OWNED}), near AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS}, e.vec_id) AS place
    FROM owned e JOIN owned q ON e.user_id = q.user_id WHERE q.vec_id % 50 = 0 AND e.vec_id % 50 <> 0 AND (e.expires_at IS NULL OR e.expires_at > {NOW}))"""


@query("r6_semantic_cache_of_owner", f"{_NEAR} SELECT query_id, vec_id FROM near WHERE place = 1 AND s <= 0.6")
def r6(spark, d):
    """The nearest live cached answer of the same owner, if near enough, for all ids divisible by 50."""
    rows, asked = _owned(spark, d)
    return retrieval.semantic_hits(asked, rows, F.lit(NOW), 0.6, "vec_id").select("query_id", "vec_id")


@query("r7_recall_of_owner", f"{_NEAR} SELECT query_id, string_agg('- memory ' || cast(vec_id as string), chr(10) ORDER BY place) AS block FROM near WHERE place <= 5 GROUP BY query_id")
def r7(spark, d):
    """The five nearest live memories of the same owner as a block of bullets, for all ids divisible by 50."""
    rows, asked = _owned(spark, d)
    rows = rows.withColumn("memory_text", F.concat(F.lit("memory "), F.col("vec_id").cast("string")))
    return retrieval.recalled(asked, rows, F.lit(NOW), 5, key="vec_id").select("query_id", "block")


def _titled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and as queries the titles of those whose id is divisible by 50."""
    docs = model(spark, d, "docs").select("doc_id", "title", F.col("raw_markdown").alias("content"))
    return docs.select("doc_id", "content"), docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query_text"))


@query(
    "r13_index_bm25",
    r"""WITH w AS MATERIALIZED (SELECT doc_id, unnest(regexp_split_to_array(lower(raw_markdown), '[^\p{L}\p{N}]+')) AS word FROM docs),
    t AS MATERIALIZED (SELECT doc_id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL), s AS (SELECT doc_id, sum(tf) AS size FROM t GROUP BY doc_id),
    f AS (SELECT word, count(*) AS df FROM t GROUP BY word), c AS (SELECT avg(size) AS mean, (SELECT count(*) FROM docs) AS n FROM s),
    q AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+')) AS word FROM docs WHERE doc_id % 50 = 0),
    r AS (SELECT query_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN t USING (word) JOIN f USING (word) JOIN s ON t.doc_id = s.doc_id, c GROUP BY query_id, t.doc_id)
    SELECT query_id, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""",
)
def r13(spark, d):
    """BM25 over the stored index for many queries at once, by whole words."""
    docs, asked = _titled(spark, d)
    found = TextIndex.build(docs, _folder(spark, "words"), "doc_id").search(asked, 20)
    # places are by whole scores; equal ones at six digits go by id
    best = retrieval.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    found = found.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(best)).filter("place <= 10")
    return found.select("query_id", "doc_id", "score")


@query("r13_index_stems")
def r13_stems(spark, d):
    """The same over Porter's stems, as the exported full-text table has them, for rows that have all of a query's words."""
    docs, asked = _titled(spark, d)
    return TextIndex.build(docs, _folder(spark, "stems"), "doc_id", kind="stems").search(asked, 10, every=True).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_JOINED = r"' ' || trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@query(
    "r13_index_phrases",
    f"""WITH t AS (SELECT doc_id, title, {_JOINED.format("raw_markdown")} AS x FROM docs), q AS (SELECT doc_id AS query_id, {_JOINED.format("title")} AS p FROM docs WHERE doc_id % 50 = 0)
    SELECT query_id, doc_id FROM q JOIN t ON contains(x, p) WHERE trim(p) <> ''""",
)
def r13_phrases(spark, d):
    """Documents that hold the words of a title in a row."""
    docs, asked = _titled(spark, d)
    return TextIndex.build(docs, _folder(spark, "words"), "doc_id").phrases(asked).select("query_id", "doc_id")


@query("flt2_index_substring", "SELECT q.doc_id AS query_id, d.doc_id FROM docs d JOIN docs q ON contains(lower(d.raw_markdown), lower(q.title)) WHERE q.doc_id % 50 = 0 AND q.title <> ''")
def flt2(spark, d):
    """Documents that hold a title anywhere in any case, by the index of character grams."""
    docs, asked = _titled(spark, d)
    return SubstringIndex.build(docs, _folder(spark, "grams"), "doc_id").search(asked)


@query(
    "r9_answerable",
    f"""WITH h AS (SELECT b.item_id AS query_id, count(*) AS n FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.item_id % 50 = 0 AND b.text <> '' GROUP BY b.item_id)
    SELECT item_id AS query_id, coalesce(n, 0) AS n_hits, CASE WHEN n IS NULL THEN '{retrieval.NO_CONTEXT}' END AS problem FROM benchmark LEFT JOIN h ON item_id = query_id WHERE item_id % 50 = 0""",
)
def r9(spark, d):
    """Which items divisible by 50 have a document that holds them; the others are refused."""
    docs = raw(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    asked = raw(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieval.answerable(asked, SubstringIndex.build(docs, _folder(spark, "grams"), "doc_id").search(asked))


def indexed_hybrid(chunks: DataFrame, asked: DataFrame, k: int, vectors: VectorIndex, substrings: SubstringIndex, words: TextIndex, candidates: int = 10) -> DataFrame:
    """For each query the best k chunks: nearest by the vector index, first that hold the whole text by the substring
    index, and, as texts longer than a chunk are in none, best by words; fused in this order."""
    dense = vectors.search(asked.select("query_id", "query_vector"), candidates)
    texts = asked.select("query_id", "query_text")
    order = retrieval.Window.partitionBy("query_id").orderBy("doc_uuid", "chunk_index", "chunk_id")
    held = substrings.search(texts).join(chunks.select("chunk_id", "doc_uuid", "chunk_index"), "chunk_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= candidates)
    return retrieval.fused_lists([dense, held, words.search(texts, candidates)], k, "chunk_id")


@query("r3_indexed_search")
def r3(spark, d):
    """Hybrid search over stored indexes of the chunks of visible documents, for all items divisible by 50, with context blocks."""
    docs = access.scoped(model(spark, d, "docs").filter("status = 'COMPLETED'"), "u1")
    asked = raw(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), hashed_embedding("text").alias("query_vector"), F.col("text").alias("query_text"))
    chunks = table(ingest.chunked(docs).drop("language"), "chunks")
    folder = _folder(spark, "indexes")
    vectors = VectorIndex.build(chunks, f"{folder}/vectors", "chunk_id", embed=ingest.embedded)
    best = indexed_hybrid(chunks, asked, 5, vectors, SubstringIndex.build(chunks, f"{folder}/grams", "chunk_id"), TextIndex.build(chunks, f"{folder}/words", "chunk_id"))
    shown = retrieval.with_documents(chunks.join(best, "chunk_id"), docs)  # a few rows a query
    place = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return shown.withColumn("block", retrieval.block(place)).select("query_id", "chunk_id", "doc_uuid", "score", "block", retrieval.deep_link("doc_uuid", "anchor_id", "page_number").alias("deep_link"))
