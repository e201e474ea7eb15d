"""A corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

Toxic documents go, then exact copies, then all but one document of each group of near copies, then
documents that hold a benchmark item; what is left is packed into sequences of 2048 ids. Every stage
judges all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import names_apart, table
from quire.llm.decontam import drop_contaminated
from quire.llm.exact_dedup import drop_copies
from quire.llm.ngram_join import drop_near_copies
from quire.llm.packing import cut_pieces, pack
from quire.llm.tokens import word_bpe
from quire.llm.toxicity import THRESHOLD, fit, labelled, scored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold by models of all labelled rows among them, over counts of them all.

    Null and empty texts are scored as texts without words; without labels of both classes nothing goes.
    Repeated rows, null ids and further columns stay as they are; no documents give no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(labelled(docs, labels))
    (score,) = names_apart(docs, "score")
    return scored(docs, model, as_col=score).filter(F.col(score) < THRESHOLD).drop(score)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest, then the one of the least id; null counts as empty.

    Of rows that agree in id and text, one stays; null ids come last; no documents give no rows.
    """
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 over five-word shingles, the one of the least id.

    Texts without words are linked to none; null ids come last; no documents give no rows.
    """
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark within its edit budget; an empty benchmark lets all stay.

    Null and empty texts hold none; repeated rows stand or fall together; no documents give no rows.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048; a null or empty text is its end id alone.

    Columns are those of ``op5_packing``; each row is packed for itself, repeated or with a null id; no documents give no rows.
    """
    pieces = cut_pieces(docs, word_bpe())
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No stage but the second can be said in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
