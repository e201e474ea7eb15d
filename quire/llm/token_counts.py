"""Token counts from an exact length histogram.

Documents are encoded once and only their lengths go on: a map-side count by length, then
suffix sums over the distinct lengths in two levels (within blocks of lengths, and over the
few blocks), so no task reads the whole histogram of a large corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import table
from quire.llm.tokens import encoder

#: Lengths that one task sums; blocks themselves are summed in a second, far smaller step.
BLOCK = 4096


def token_lengths(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of each row: ids of the whole text and the id that ends it (null and empty texts: 1)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            counts = [len(encode(t)) // 4 + 1 for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """One row per distinct encoded length, which is also a context limit.

    ``docs``: documents of that length; ``docs_longer`` and ``tokens_longer``: suffix sums beyond
    it; ``truncated_total``: ids left when each document is cut at it; ``quantile``: the share
    of documents of at most that length. An empty table gives no rows.
    """
    counts = table(token_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.count("*").alias("docs")), "lengths")
    blocks = counts.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    totals = blocks.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    totals = totals.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs_all"),
        F.sum("t").over(whole).alias("tokens_all"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    longer = lambda c, after: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(after)
    sums = blocks.join(totals, "block").select(
        "n_tokens",
        "docs",
        longer("docs", "docs_after").alias("docs_longer"),
        longer("tokens", "tokens_after").alias("tokens_longer"),
        "docs_all",
        "tokens_all",
    )
    return sums.select(
        "n_tokens",
        "docs",
        "docs_longer",
        "tokens_longer",
        (F.col("tokens_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        (1 - F.col("docs_longer") / F.col("docs_all")).alias("quantile"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit``, ``total``: ids left at any limits, also between the lengths of the histogram."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(n,) for n in limits], "context_limit long")
    pairs = histogram.join(F.broadcast(wanted))
    return pairs.groupBy("context_limit").agg(F.sum(F.col("docs") * F.least("n_tokens", "context_limit")).alias("total"))


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return histogram.filter(F.col("quantile") >= share - 1e-12).agg(F.min("n_tokens").alias("n_tokens"))
