"""Settings, caches, stale files, calls of outside models, and jobs that run at intervals."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.text import CASCADE_TERMS, RATE_LIMIT_TERMS, RETRY_FIELD, RETRY_SAID

# Fixed values.
MODELS = [
    "auto", "openrouter/free", "openrouter/auto", "google/gemini-2.5-flash", "google/gemini-2.5-flash-lite", "google/gemini-3.5-flash", "google/gemini-3.1-flash-lite",
    "google/gemini-3.1-flash", "meta-llama/llama-3-8b-instruct:free", "google/gemma-2-9b-it:free", "qwen/qwen-2-7b-instruct:free",
]
CURRENCIES = ["auto", "USD", "IDR", "SAR"]
MASKED = "•" * 16
CACHE_PREFIX = "rag_search_cache:"
#: Neutral prefixes of temporary files; a caller names those of its own programs.
TEMPORARY = ["tmp", "pdf_export_"]
DAY = 86_400


#: What holds where nothing is stored.
DEFAULTS = {"monthly_budget_micro": 10_000_000, "selected_model": "auto", "currency": "auto"}


def current_settings(stored: DataFrame, order: str) -> DataFrame:
    """The one row of settings: the first stored one, and defaults for what it leaves open or where there is none."""
    first = stored.agg(*(F.min_by(c, order).alias(c) for c in DEFAULTS))  # one row, null where nothing is stored
    return first.select(*(F.coalesce(c, F.lit(v).cast(first.schema[c].dataType)).alias(c) for c, v in DEFAULTS.items()))


def settings_problem(model: Column, currency: Column, budget: Column) -> Column:
    """Why asked settings are refused: the model, the currency or the budget; null if they are fine."""
    amount = budget.try_cast("decimal(20,6)")
    return (
        F.when(~F.coalesce(model.isin(MODELS), F.lit(False)), "model")
        .when(~F.coalesce(currency.isin(CURRENCIES), F.lit(False)), "currency")
        .when(F.coalesce(amount < 0, F.lit(True)), "budget")
    )


def saved_settings(current: DataFrame, asked: DataFrame, order: str) -> DataFrame:
    """The one row of settings after all requests in order: the last that is not refused replaces it.

    Both have ``selected_model, currency, monthly_budget_usd, openrouter_api_key``; a key that is the mask
    leaves the key as it was, so the last key that is none counts. Only one row for each task is shuffled.
    """
    fine = asked.filter(settings_problem(F.col("selected_model"), F.col("currency"), F.col("monthly_budget_usd")).isNull())
    named = lambda c: F.max_by(c, order).alias(f"new_{c}")
    key = F.max_by("openrouter_api_key", F.when(F.col("openrouter_api_key") != MASKED, F.col(order))).alias("new_key")
    last = fine.agg(*(named(c) for c in ("selected_model", "currency", "monthly_budget_usd")), key)
    kept = lambda new, c: F.coalesce(new, c).alias(c)
    both = last.join(current.limit(1), how="left")  # one row each
    return both.select(*(kept(f"new_{c}", c) for c in ("selected_model", "currency", "monthly_budget_usd")), kept("new_key", "openrouter_api_key"))


def invalidated(entries: DataFrame, answers: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Key-value entries and cached answers after changes: if any document was completed or deleted, all
    answers go, and all entries under the search cache's prefix. ``changed``: ``status``, ``deleted``."""
    stale = changed.agg(F.coalesce(F.bool_or((F.col("status") == "COMPLETED") | F.coalesce("deleted", F.lit(False))), F.lit(False)).alias("stale"))
    flagged = lambda rows: rows.join(F.broadcast(stale))  # noqa: E731  one row
    left = flagged(entries).filter(~(F.col("stale") & F.col("cache_key").startswith(CACHE_PREFIX))).drop("stale")
    return left, flagged(answers).filter(~F.col("stale")).drop("stale")


def stale_files(files: DataFrame, now: Column, prefixes: list[str] = TEMPORARY, seconds: int = DAY) -> DataFrame:
    """Of listed files (``path``, ``modificationTime``, as a scan of binary files gives) those with one of the prefixes that are older."""
    name = F.element_at(F.split("path", "/"), -1)
    known = F.lit(False)
    for prefix in prefixes:
        known = known | name.startswith(prefix)
    return files.filter(known & (F.unix_timestamp(now) - F.unix_timestamp("modificationTime") > seconds))


def wait_for(message: str) -> float | None:
    """Seconds that an error message asks to wait."""
    found = re.search(RETRY_SAID, message) or re.search(RETRY_FIELD, message)
    return float(found[1]) if found else None


def _holds(error: Exception, terms: list[str]) -> bool:
    return any(t in str(error).lower() for t in terms)


def _outcome(call: Callable, args: tuple) -> tuple[object, Exception | None]:
    try:
        return call(*args), None
    except Exception as error:
        return None, error


def with_backoff(call: Callable, *args, tries: int = 5, first: float = 5, sleep: Callable[[float], None] = time.sleep):
    """The call's result; on a rate limit again, after the time that the error names and 1.5 seconds, else after 5, 10, 20, ... seconds."""
    planned = (first * 2**n for n in count())  # only waits that no error replaces are used up
    value, error = _outcome(call, args)
    for _ in range(tries - 1):
        if error is None or not _holds(error, RATE_LIMIT_TERMS):
            break
        named = wait_for(str(error))
        sleep(next(planned) if named is None else named + 1.5)
        value, error = _outcome(call, args)
    if error is not None:
        raise error
    return value


def cascade(models: dict[str, Callable[[str], str]], sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A provider for ``ingest.generated``: each text goes to the first model, with back-off, and on an error
    that another model may not have (unknown, retired, over its limit) to the next; the last error is raised."""

    def one(text: str) -> str:
        last: Exception | None = None
        for model in models.values():
            try:
                return with_backoff(model, text, sleep=sleep)
            except Exception as error:
                last = error
                if not _holds(error, CASCADE_TERMS):
                    break
        raise last or ValueError("no model")

    return lambda texts: [one(t) for t in texts]


def every(spark: SparkSession, job: Callable[[SparkSession], None], seconds: int, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs a batch job at intervals (stale documents every 300 seconds, retention every 3600), as a triggered stream.

    The ticks are a rate source's batches; a failed run is repeated by restarting the query from its
    checkpoint. With ``once`` it runs for the ticks that are due and ends.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("advanceMillisPerBatch", 1000 * seconds).load()
    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda _, n: job(spark))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
