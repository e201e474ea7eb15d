"""Spend, ledgers, budgets and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(docs: DataFrame) -> DataFrame:
    """Cost, tokens, and pages of completed documents, in one pass."""
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return docs.agg(
        sum_of("cost_micro").alias("cost_micro"),
        sum_of("input_tokens").alias("input_tokens"),
        sum_of("output_tokens").alias("output_tokens"),
        sum_of(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        sum_of(F.when(F.col("status") == "COMPLETED", F.col("page_count"))).alias("pages"),
    )


def status_counts(docs: DataFrame, statuses: list[str]) -> DataFrame:
    """A row per known status, zeros included."""
    counted = docs.groupBy("status").agg(F.count("*").alias("n"))
    every = docs.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return F.broadcast(every).join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def month_to_date(docs: DataFrame, first_s: int) -> DataFrame:
    return docs.filter(F.col("created_s") >= first_s).agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("cost_micro"))


def booked(ledger: DataFrame, additions: DataFrame) -> DataFrame:
    """A ledger by month with further sums added: union and one aggregation."""
    both = ledger.unionByName(additions)
    return both.groupBy("year", "month").agg(*(F.sum(c).alias(c) for c in ledger.columns if c not in ("year", "month")))


def by_month(docs: DataFrame) -> DataFrame:
    """Additions to a ledger, booked to the month of creation."""
    when = F.timestamp_seconds("created_s")
    sums = [F.sum(c).alias(c) for c in ("cost_micro", "input_tokens", "output_tokens")]
    return docs.groupBy(F.year(when).alias("year"), F.month(when).alias("month")).agg(*sums)


def budget(live_sum: DataFrame, ledger_sum: DataFrame, cap_micro: int) -> DataFrame:
    """One row: spent, whether the cap is reached, and percent of it (cut off, at most 100, 0 without a cap)."""
    spent = F.col("live") + F.col("booked")
    both = live_sum.select(F.col("cost_micro").alias("live")).crossJoin(F.broadcast(ledger_sum.select(F.col("cost_micro").alias("booked"))))
    share = F.when(F.lit(cap_micro) <= 0, 0).otherwise(F.least(F.lit(100), F.floor(spent * 100 / F.lit(max(cap_micro, 1)))))
    return both.select(spent.alias("spent_micro"), (spent >= cap_micro).alias("exceeded"), share.cast("int").alias("percent"))


def counted(left: DataFrame, right: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows of ``right`` for each key of ``left``, zeros included."""
    counts = right.groupBy(key).agg(F.count("*").alias(name))
    return left.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
