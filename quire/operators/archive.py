"""A Markdown archive of documents: numbered files with front matter, copies by language and author, a manifest and a master text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.markup import slugged
from quire.functions.text import filled, first_filled
from quire.operators.exports import numbered

# What stands for a document without text, and the opening of the master text.
EMPTY = "*Empty Document Content*"
OPENING = (
    "# Master Digital Archival Source Book\n\nThis master document contains all aggregated booklet knowledge in a single high-density layout. "
    "It uses strict structural indicators to help archival systems easily parse each separate source content boundaries.\n\n\n"
)
MATTER = {"title": "title", "author": "author", "language": "language", "document_type": "document_type", "source_hash": "file_hash"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def archived(docs: DataFrame, exported_at: str, order: str = "doc_id") -> DataFrame:
    """One row per document: ``ordinal``, ``export_path``, ``base``, ``content`` (front matter and text), ``body`` and its ``entry`` of the manifest.

    Refined text comes before raw text. A title without letters gives way to the file's name, and that to
    the number. Docs: the model's columns, ``refined_markdown`` where there is one.
    """
    texts = [c for c in ("refined_markdown", "raw_markdown") if c in docs.columns]
    rows = numbered(docs, order)
    name = F.coalesce(F.nullif(slugged(first_filled("title", "original_filename")), F.lit("")), F.concat(F.lit("document_"), F.col("doc_id").cast("string")))
    rows = rows.withColumns({"base": F.concat(F.format_string("%03d_", "ordinal"), name), "body": filled(first_filled(*texts), EMPTY), "kind": filled("document_type", "PDF")})
    lines = [F.concat(F.lit(f'{k}: "'), _text(c), F.lit('"')) for k, c in MATTER.items()]
    front = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines, F.lit(f'exported_at: "{exported_at}"')), F.lit("\n---\n\n"))
    path = F.concat(F.lit("documents/"), F.col("base"), F.lit(".md"))
    entry = F.struct(
        F.col("doc_id").alias("id"), F.col("original_filename").alias("filename"), "title", "author", "language", F.col("kind").alias("type"), F.coalesce("page_count", F.lit(0)).alias("page_count"),
        (F.coalesce("cost_micro", F.lit(0)) / 1e6).alias("cost_usd"), F.col("file_hash").alias("hash"), path.alias("export_path"),
    )
    return rows.select("ordinal", path.alias("export_path"), "base", F.concat(front, F.col("body")).alias("content"), "body", "title", "author", "language", "kind", "file_hash", entry.alias("entry"))


def files(archive: DataFrame, views: bool = True) -> DataFrame:
    """``ordinal, path, content``: each document, and with ``views`` again by its language and its author."""
    folder = lambda top, c: F.concat(F.lit(top), F.coalesce(F.nullif(slugged(filled(c, "unknown")), F.lit("")), F.lit("unknown")), F.lit("/"), F.col("base"), F.lit(".md"))
    paths = [F.col("export_path"), *([folder("Language/", "language"), folder("Author/", "author")] if views else [])]
    return archive.select("ordinal", F.explode(F.array(*paths)).alias("path"), "content")


def master(archive: DataFrame) -> DataFrame:
    """``ordinal, section`` of the master text, between marks that name the source."""
    n, said = F.col("ordinal").cast("string"), {c: _text(c) for c in ("title", "author", "language", "kind", "file_hash")}
    start = F.concat(F.lit("<!-- SOURCE_START_"), n, F.lit(": "), said["title"], F.lit(" by "), said["author"], F.lit(" ("), said["language"], F.lit(") [Type: "), said["kind"], F.lit(", Hash: "), said["file_hash"], F.lit("] -->"))
    head = F.concat(F.lit("\n\n# SOURCE: "), said["title"], F.lit("\n\n**Author:** "), said["author"], F.lit("  \n**Language:** "), said["language"], F.lit("  \n**Document Type:** "), said["kind"], F.lit("\n\n"))
    return archive.select("ordinal", F.concat(start, head, F.col("body"), F.lit("\n\n<!-- SOURCE_END_"), n, F.lit(" -->\n\n---\n\n")).alias("section"))


def write_archive(archive: DataFrame, folder: str, exported_at: str, views: bool = True) -> None:
    """The archive as ``folder`` (see ``sources.bundle``): each task writes its range of documents, the commit a manifest of counts."""
    from quire.sources.bundle import BundleSource

    spark = archive.sparkSession
    spark.dataSource.register(BundleSource)
    told = files(archive, views).join(master(archive).join(archive.select("ordinal", "export_path", F.to_json("entry").alias("entry"), F.col("entry.page_count").alias("pages"), F.col("entry.cost_usd").alias("cost")), "ordinal").withColumnRenamed("export_path", "main").withColumnRenamed("ordinal", "of"), (F.col("ordinal") == F.col("of")) & (F.col("path") == F.col("main")), "left")
    ordered = told.select("ordinal", "path", "content", "section", "entry", "pages", "cost").repartitionByRange("ordinal").sortWithinPartitions("ordinal", "path")
    ordered.write.format("bundle").mode("append").option("folder", folder).option("opening", OPENING).option("exported_at", exported_at).save()
