"""Model answers kept by the digest of what was asked, and documents refined piece by piece with them.

A piece is asked once: answers lie in a folder of Parquet by digest and are read before any call. Each
piece has its own outcome, so a piece that fails leaves the others; it keeps its raw text and is
asked again by the next run. Calls of a task run side by side, a bounded number at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.text import is_preference
from quire.functions.vector import hashed_embedding
from quire.operators.ingest import generated, pieces
from quire.sources.tables import joined_spread, table

#: Lengths beyond which refined text and its metadata count as there; pairs that a document keeps.
REFINED_CHARS, METADATA_CHARS, PAIRS = 20, 5, 20


@dataclass(frozen=True)
class AnswerStore:
    """Answers by digest; ``tag`` names the model and the prompt, so that another one's answers are not taken for its own."""

    folder: str
    tag: str = ""

    def digest(self, text: str | Column) -> Column:
        return F.sha2(F.concat(F.lit(self.tag + "\n"), text if isinstance(text, Column) else F.col(text)), 256)

    def read(self, spark: SparkSession) -> DataFrame:
        """``digest, answer``; of a digest that two runs asked at once the least answer."""
        spark.createDataFrame([], "digest string, answer string").write.mode("append").parquet(self.folder)  # a folder to read, even if none was written
        return spark.read.schema("digest string, answer string").parquet(self.folder).groupBy("digest").agg(F.min("answer").alias("answer"))

    def add(self, answers: DataFrame) -> None:
        answers.select("digest", "answer").write.mode("append").parquet(self.folder)


def answered(rows: DataFrame, store: AnswerStore, provider, text: str = "content", calls: int = 4) -> DataFrame:
    """``rows`` with ``answer`` and ``failed``: from the store, else from the provider, asked once for equal texts.

    Where the provider fails the answer is the text and ``failed`` is true; blank and null texts are not
    asked. A text that a third of all rows share is asked once and joined to them in parts.
    """
    spark = rows.sparkSession
    keyed = table(rows.withColumn("digest", F.when(F.trim(text) != "", store.digest(text))), "asked")
    known = store.read(spark)
    distinct = keyed.filter("digest is not null").groupBy("digest").agg(F.first(text).alias("content"))
    fresh = distinct.join(known.select("digest"), "digest", "left_anti")
    new = table(generated(fresh, provider, calls=calls).select("digest", F.col("answer"), "failed"), "answers")
    store.add(new.filter("not failed"))
    told = known.select("digest", "answer", F.lit(False).alias("failed")).join(new.select("digest"), "digest", "left_anti").unionByName(new)
    joined = joined_spread(keyed, told, "digest")
    return joined.withColumns({"answer": F.coalesce("answer", text), "failed": F.coalesce("failed", F.lit(False))}).drop("digest")


def refined(docs: DataFrame, store: AnswerStore, provider, most: int = 600_000, text: str = "raw_markdown", split: bool = True) -> DataFrame:
    """``doc_uuid, refined_markdown, yaml_metadata, pairs, failed_pieces`` of all documents.

    Those with refined text and metadata keep them. The others' pieces are answered; an answer's front
    matter is parted from its text (``split``), that of the first piece counts, and the first PAIRS questions
    of all pieces stay. Blank pieces drop out, raw text stands for failed ones.
    """
    has = F.lit(False)
    if {"refined_markdown", "yaml_metadata"} <= set(docs.columns):
        has = F.coalesce((F.length("refined_markdown") > REFINED_CHARS) & (F.length("yaml_metadata") > METADATA_CHARS), F.lit(False))
    pair_kind = "array<struct<question:string,answer:string>>"
    asked = answered(pieces(docs.filter(~has), text, most), store, provider)
    parts = markup.split_front_matter("answer") if split else F.struct(F.col("answer").alias("text"), F.lit("").alias("yaml"), F.array().cast(pair_kind).alias("pairs"))
    raw = F.struct(F.col("answer").alias("text"), F.lit("").alias("yaml"), F.array().cast(pair_kind).alias("pairs"))
    told = asked.withColumn("x", F.when(F.col("failed"), raw).otherwise(parts.cast(f"struct<text:string,yaml:string,pairs:{pair_kind}>")))
    ordered = F.array_sort(F.collect_list(F.struct("piece", "x")))  # the pieces of one document
    whole = told.groupBy("doc_uuid").agg(ordered.alias("all"), F.sum(F.col("failed").cast("int")).cast("int").alias("failed_pieces"))
    made = whole.select(
        "doc_uuid",
        F.array_join(F.filter(F.transform("all", lambda p: p["x"]["text"]), lambda t: F.trim(t) != ""), "\n\n---\n\n").alias("refined_markdown"),
        F.col("all")[0]["x"]["yaml"].alias("yaml_metadata"),
        F.slice(F.flatten(F.transform("all", lambda p: F.coalesce(p["x"]["pairs"], F.array().cast(pair_kind)))), 1, PAIRS).alias("pairs"),
        "failed_pieces",
    )
    if not {"refined_markdown", "yaml_metadata"} <= set(docs.columns):
        return made
    kept = docs.filter(has).select("doc_uuid", "refined_markdown", "yaml_metadata", F.array().cast(pair_kind).alias("pairs"), F.lit(0).alias("failed_pieces"))
    return kept.unionByName(made)


def preferences(said: DataFrame, store: AnswerStore, provider, users: DataFrame, embed=hashed_embedding, text: str = "text") -> DataFrame:
    """``user_id, memory_text, embedding`` of what known users said that signals a preference, distilled by a model.

    Quotes and a last full stop come off the answer; one that is empty or NONE is no memory. Where the model fails the
    user's own words without a last full stop are kept. A user keeps equal memories once.
    """
    trimmed = said.withColumn("content", F.trim(text)).filter(is_preference("content")).join(users.select("user_id").distinct(), "user_id", "left_semi")
    told = answered(trimmed.select("user_id", "content"), store, provider)
    distilled = F.rtrim(F.btrim(F.trim("answer"), F.lit("\"'")), F.lit("."))
    memory = F.when(F.col("failed"), F.rtrim("content", F.lit("."))).otherwise(distilled)
    kept = told.select("user_id", memory.alias("memory_text")).filter((F.col("memory_text") != "") & (F.upper("memory_text") != "NONE")).distinct()
    return kept.withColumn("embedding", embed("memory_text"))
