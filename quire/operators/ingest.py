"""From documents to chunks and their vectors, and back-fill of what is missing."""

from __future__ import annotations

import re
from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import chunk_anchor, chunk_chapter, chunk_page, chunk_size, chunks, first_filled, word_count
from quire.functions.vector import hashed_embedding
from quire.sources.tables import text_batches

#: What marks a piece border of an over-long text, a heading of three levels or a blank line.
BREAK = re.compile(r"\n(?=(#{1,3} |\n))")
SOLID = re.compile(r"\S")


def chunked(docs: DataFrame, text: str = "raw_markdown", most: Column | None = None) -> DataFrame:
    """A row per chunk of each document with page, chapter, anchor and word count."""
    size = chunk_size("language") if most is None else most
    rows = text_batches(docs).select("doc_uuid", "language", F.posexplode(chunks(text, size)).alias("chunk_index", "content"))
    rows = rows.withColumns({"page_number": chunk_page("content"), "chapter_title": chunk_chapter("content"), "token_count": word_count("content")})
    return rows.withColumn("anchor_id", chunk_anchor(F.col("page_number"), F.col("chapter_title"))).withColumn("chunk_id", F.concat("doc_uuid", F.lit("_"), F.col("chunk_index").cast("string")))


def embedded(rows: DataFrame, text: str = "content", provider=hashed_embedding) -> DataFrame:
    """``embedding`` of each row's text; the provider is any Arrow function of a text column."""
    return text_batches(rows).withColumn("embedding", provider(text))


def embedded_reusing(rows: DataFrame, known: DataFrame, text: str = "content", provider=hashed_embedding) -> DataFrame:
    """Vectors of texts already known are reused; each new text is embedded once."""
    digest = F.sha2(F.trim(text), 256)
    store = known.select(F.sha2(F.trim(text), 256).alias("digest"), "embedding").groupBy("digest").agg(F.first("embedding").alias("kept"))
    rows = rows.withColumn("digest", digest)
    fresh = rows.join(store, "digest", "left_anti").groupBy("digest").agg(F.first(text).alias(text))
    made = embedded(fresh, text, provider).select("digest", F.col("embedding").alias("made"))
    return rows.join(store, "digest", "left").join(made, "digest", "left").withColumn("embedding", F.coalesce("kept", "made")).drop("digest", "kept", "made")


def unchunked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Completed documents without a chunk."""
    return docs.filter("status = 'COMPLETED'").join(rows.select("doc_uuid"), "doc_uuid", "left_anti")


def completed(docs: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """After chunking: pages (their own or the number of chunks), completed, kept for 30 days."""
    counts = rows.groupBy("doc_uuid").agg(F.count("*").cast("int").alias("n_chunks"))
    out = docs.join(counts, "doc_uuid", "left")
    pages = F.coalesce(F.nullif("page_count", F.lit(0)), "n_chunks", F.lit(0))
    return out.withColumns({"page_count": pages, "status": F.lit("COMPLETED"), "expires_at": now + F.expr("interval 30 days")}).drop("n_chunks")


def reembedded(docs: DataFrame, rows: DataFrame, edited: DataFrame, now: Column, provider=hashed_embedding) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after edits: those of ``edited`` (``doc_uuid``) are chunked and embedded anew from
    their refined, else raw text, all their old chunks go, and they are complete again. Others stay untouched."""
    again = docs.join(edited.select("doc_uuid").distinct(), "doc_uuid", "left_semi")
    text = content_of("refined_markdown", "raw_markdown") if "refined_markdown" in docs.columns else content_of("raw_markdown")
    fresh = embedded(chunked(again.withColumn("text_to_chunk", text), "text_to_chunk"), provider=provider)
    kept = rows.join(again.select("doc_uuid"), "doc_uuid", "left_anti")
    done = completed(again, fresh, now).select(docs.columns)
    others = docs.join(again.select("doc_uuid"), "doc_uuid", "left_anti")
    return others.unionByName(done), kept.unionByName(fresh.select(rows.columns))


def content_of(*columns: str) -> Column:
    """Refined, cleaned or raw text, whichever is first there."""
    return first_filled(*columns)


def split_long(text: str, most: int = 600_000) -> list[str]:
    """Pieces of at most ``most`` characters, cut at the last border of any kind in the final fifth, else hard.

    A text that fits stays as it is; pieces are stripped, and only a last one that is empty drops out.
    """
    if len(text) <= most:
        return [text]
    borders = [(m.end(1), m.start()) for m in BREAK.finditer(text)]  # a later border ends later
    edges, at, end, filled = [0], 0, len(text), len(text.rstrip())
    while end - at > most:
        last = bisect_right(borders, (at + most, len(text))) - 1
        border = borders[last][1] if last >= 0 else -1
        edges.append(border if border >= at + max(1, int(most * 0.8)) else at + most)
        begin = SOLID.search(text, edges[-1])
        at, end = (begin.start(), filled) if begin else (len(text), len(text))
    return [p for n, (a, b) in enumerate(pairwise([*edges, len(text)])) if (p := text[a:b].strip()) or n < len(edges) - 1]


def pieces(docs: DataFrame, text: str = "raw_markdown", most: int = 600_000) -> DataFrame:
    """Over-long texts as numbered pieces for a model; short ones pass by the split, in the JVM."""

    def cut_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_long(t, most))

    cut = F.pandas_udf(cut_all, "array<string>")
    cut_text = F.when(F.length(text) > most, cut(F.when(F.length(text) > most, F.col(text)).otherwise(F.lit("")))).otherwise(F.array(F.col(text)))
    return text_batches(docs).select("doc_uuid", F.posexplode(cut_text).alias("piece", "content"))


def generated(rows: DataFrame, provider=None, text: str = "content", calls: int = 4) -> DataFrame:
    """``answer`` of a model for each row, by ``provider(list of texts) -> list of texts``, asked for one text at a time.

    A task makes up to ``calls`` calls at once. Without a provider the text itself comes back. A call that fails
    keeps its text and says so in ``failed``; other rows are not touched by it. Null texts are not asked.
    """

    def one(asked: str | None) -> tuple[str | None, bool]:
        if provider is None or asked is None:
            return asked, False
        try:
            return provider([asked])[0], False
        except Exception:  # a model's failure is data, not the job's
            return asked, True

    def run(batches):
        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                found = list(pool.map(one, batch[text].tolist()))
                batch["answer"], batch["failed"] = [a for a, _ in found], [f for _, f in found]
                yield batch

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return text_batches(rows).mapInPandas(run, f"{schema}, answer string, failed boolean")


def rejoined(rows: DataFrame) -> DataFrame:
    """Answers of a document's pieces, in order, with rules between."""
    ordered = F.array_sort(F.collect_list(F.struct("piece", "answer")))
    return rows.groupBy("doc_uuid").agg(F.array_join(F.transform(ordered, lambda x: x["answer"]), "\n\n---\n\n").alias("refined_markdown"))
