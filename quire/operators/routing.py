"""Which model a request goes to: names resolved against a price list, and the automatic choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.tables import small_by_count, table

# What is stripped from names, the automatic choice, and the router's free model.
VENDOR, AUTO, FREE = "google/", "auto", "openrouter/free"


def cheapest(prices: DataFrame) -> DataFrame:
    """One row: ``any_model`` and ``vision_model``, the models of least price (of equals the first name) among all and among those that see."""
    priced = prices.withColumn("price", F.col("price").cast("string").try_cast("decimal(28,12)")).filter("price is not null")
    best = lambda some: F.min_by(F.when(some, F.col("model")), F.when(some, F.struct("price", "model")))
    return priced.agg(best(F.lit(True)).alias("any_model"), best(F.coalesce("vision", F.lit(False))).alias("vision_model"))


def routed_models(requests: DataFrame, prices: DataFrame, default: str = AUTO) -> DataFrame:
    """``requests`` with ``final_model`` and ``router`` (whether it goes through the router).

    Requests: ``model`` (null: ``default``), ``vision``, ``has_key``. The vendor's prefix comes off. A name without a maker that
    no price list knows is stale and gives way to the cheapest model; ``auto`` is the cheapest that sees
    for pictures, the router's free model where there is a key, else the cheapest. Names with a maker go through the router.
    """
    asked = F.coalesce(F.nullif("model", F.lit("")), F.lit(default))
    name = F.when(asked.startswith(VENDOR), F.replace(asked, F.lit(VENDOR), F.lit(""))).otherwise(asked)
    known = small_by_count(table(prices.select(F.col("model").alias("_name")).distinct().withColumn("_known", F.lit(True)), "known"))
    rows = requests.withColumn("_name", name).join(known, "_name", "left")
    rows = rows.join(F.broadcast(cheapest(prices)))  # one row
    maker, auto = F.contains("_name", F.lit("/")), F.col("_name") == AUTO
    picture, key = F.coalesce("vision", F.lit(False)), F.coalesce("has_key", F.lit(False))
    chosen = F.when(picture, F.col("vision_model")).when(key, F.lit(FREE)).otherwise(F.col("any_model"))
    stale = ~maker & ~auto & F.col("_known").isNull()
    final = F.when(auto, chosen).when(stale, F.col("any_model")).otherwise(F.col("_name"))
    return rows.withColumns({"final_model": final, "router": maker | (auto & ~picture & key)}).drop("_name", "_known", "any_model", "vision_model")
