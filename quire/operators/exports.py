"""Exports: training pairs, CSV, Markdown bundles with manifests, SQLite."""

from __future__ import annotations

import io
import sqlite3
import zipfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import csv_guard, excerpt, filled, slug
from quire.sources.tables import table

# The wording of training pairs.
SYSTEM = "You are a knowledgeable archival research assistant specializing in historical, literary, and classical religious documents."
QUESTION = "Question: Explain the key context, teachings, and significance of this excerpt."


def training_pairs(rows: DataFrame, docs: DataFrame, each: int = 10, most: int | None = 5000) -> DataFrame:
    """Prompt, completion, messages, metadata and place of chunks: up to ``each`` a document and ``most`` in all, in order; None: all, unsorted."""
    chosen = rows.filter(F.trim("content") != "").withColumn("turn", F.row_number().over(Window.partitionBy("doc_uuid").orderBy("chunk_index"))).filter(F.col("turn") <= each)
    known = docs.select("doc_uuid", "doc_id", filled("title", "Untitled").alias("title"), filled("author", "Unknown").alias("author"), F.col("language").alias("doc_language"))
    chosen = chosen.join(known, "doc_uuid")
    if most is not None:
        chosen = chosen.orderBy("doc_id", "chunk_index").limit(most)
    page, chapter = F.coalesce("page_number", F.lit(1)), filled("chapter_title")
    where = F.concat(F.lit(" (Page "), page.cast("string"), F.when(chapter != "", F.concat(F.lit(", "), chapter)).otherwise(""), F.lit("):\n\n"))
    prompt = F.concat(F.lit("Context from '"), "title", F.lit("' by "), "author", where, "content", F.lit(f"\n\n{QUESTION}"))
    completion = F.concat(F.lit("Based on '"), "title", F.lit("', the text conveys:\n\n"), "content")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return chosen.select(
        prompt.alias("prompt"),
        completion.alias("completion"),
        F.array(message("system", F.lit(SYSTEM)), message("user", prompt), message("assistant", completion)).alias("messages"),
        F.struct("doc_uuid", "title", "author", F.col("doc_language").alias("language"), page.alias("page_number"), chapter.alias("chapter_title"), filled("anchor_id", "").alias("anchor_id")).alias("metadata"),
        "chunk_index",
    )


def csv_rows(docs: DataFrame) -> DataFrame:
    """The 16 columns of the CSV export; text is guarded against formulas."""
    text = {"title": "Untitled", "author": "Unknown", "language": "en", "document_type": "PDF", "publisher": "", "publication_year": "", "doi": "", "license_type": "", "file_hash": ""}
    return docs.select(
        F.col("doc_uuid"),
        *(csv_guard(filled(c, d)).alias(c) for c, d in text.items()),
        F.coalesce(F.nullif("page_count", F.lit(0)), F.lit(1)).alias("page_count"),
        (F.col("cost_micro") / 1e6).alias("cost_usd"),
        F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
        F.coalesce("output_tokens", F.lit(0)).alias("output_tokens"),
        F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        csv_guard(excerpt("raw_markdown")).alias("excerpt"),
    )


def numbered(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """``ordinal`` from 1 in the order, by range partitions, written once: counts of the partitions before, then ranks within."""
    parts = docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    ranked = table(parts.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(order))), "ranked")
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(before), "part").withColumn("ordinal", F.col("rank") + F.col("before")).drop("part", "rank", "before")


def front_matter(columns: list[str]) -> Column:
    quote = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('\\"'))
    lines = [F.concat(F.lit(f'{c}: "'), quote(c), F.lit('"')) for c in columns]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def bundle(docs: DataFrame) -> DataFrame:
    """``path, content`` of a Markdown bundle: each document numbered, and by language and author with suffixes for equal names."""
    rows = numbered(docs).withColumn("name", F.concat(slug(filled("title", "untitled")), F.lit(".md")))
    rows = rows.withColumn("content", F.concat(front_matter(["doc_uuid", "title", "author", "language"]), F.coalesce("raw_markdown", F.lit(""))))
    first = rows.select("ordinal", F.concat(F.lit("documents/"), F.format_string("%03d_", "ordinal"), "name").alias("path"), "content")
    kinds = rows.select("ordinal", "content", "name", F.explode(F.array(F.concat(F.lit("Language/"), filled("language", "Unknown")), F.concat(F.lit("Author/"), filled("author", "Unknown")))).alias("folder"))
    turn = F.row_number().over(Window.partitionBy("folder", "name").orderBy("ordinal"))
    suffix = F.when(turn > 1, F.concat(F.lit("_"), turn.cast("string"), F.lit(".md"))).otherwise(".md")
    copies = kinds.select("ordinal", F.concat("folder", F.lit("/"), F.regexp_replace("name", r"\.md$", ""), suffix).alias("path"), "content")
    return first.unionByName(copies)


def manifest(docs: DataFrame) -> DataFrame:
    """Documents, cost and pages of a bundle in one row."""
    return docs.agg(F.count("*").alias("document_count"), F.sum("cost_micro").alias("total_cost_micro"), F.sum("page_count").alias("total_pages"))


def zipped(files: DataFrame, most: int = 1000) -> bytes:
    """A ZIP of at most ``most`` small files, for a download; more are refused: larger bundles are written as a table of files."""
    n = files.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} files: write the bundle as a table instead")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.orderBy("path").toLocalIterator():
            z.writestr(row["path"], row["content"])
    return out.getvalue()


def sqlite_file(docs: DataFrame, rows: DataFrame, path: str, most: int = 1000) -> None:
    """A SQLite file of at most ``most`` documents with their chunks and a full-text index, for a download."""
    chosen = docs.orderBy("doc_id").limit(most)
    con = sqlite3.connect(path)
    con.executescript(
        "CREATE TABLE documents (doc_uuid TEXT PRIMARY KEY, title TEXT, author TEXT, language TEXT, file_hash TEXT, page_count INT);"
        "CREATE TABLE chunks (chunk_id TEXT PRIMARY KEY, doc_uuid TEXT, chunk_index INT, content TEXT, page_number INT);"
        "CREATE VIRTUAL TABLE chunks_fts USING fts5(chunk_id UNINDEXED, content, title, author, tokenize = 'porter unicode61');"
    )
    columns = ["doc_uuid", filled("title", "Untitled").alias("title"), filled("author", "Unknown").alias("author"), filled("language", "Unknown").alias("language"), "file_hash", "page_count"]
    con.executemany("INSERT INTO documents VALUES (?,?,?,?,?,?)", (tuple(r) for r in chosen.select(*columns).toLocalIterator()))
    parts = rows.filter(F.trim("content") != "").join(F.broadcast(chosen.select("doc_uuid", "title", "author")), "doc_uuid")
    for r in parts.select("chunk_id", "doc_uuid", "chunk_index", "content", "page_number", "title", "author").toLocalIterator():
        con.execute("INSERT INTO chunks VALUES (?,?,?,?,?)", tuple(r)[:5])
        con.execute("INSERT INTO chunks_fts VALUES (?,?,?,?)", (r["chunk_id"], r["content"], r["title"], r["author"]))
    con.commit()
    con.close()
