"""Changes as new states of a table: inserts, partial updates, upserts, deletes and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Known columns only, the rest null."""
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in rows.columns]
    return table.unionByName(rows.select(*[c for c in rows.columns if c in table.columns], *missing).select(table.columns))


def updated(table: DataFrame, changes: DataFrame, key: str, now: Column | None = None, touched: str | None = None) -> DataFrame:
    """Values that are not null replace those of the row with that key; ``touched`` is set to now unless given."""
    columns = [c for c in changes.columns if c != key and c in table.columns]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in columns), F.lit(True).alias("is_changed"))
    out = table.join(new, key, "left")
    values = {c: F.coalesce(f"new_{c}", c) for c in columns}
    if touched:
        given = F.col(f"new_{touched}") if touched in columns else F.lit(None)
        values[touched] = F.when(F.col("is_changed"), F.coalesce(given, now)).otherwise(F.col(touched))
    return out.withColumns(values).select(table.columns)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: the last row of each key. An aggregation, so hot keys combine before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("last"))
    return best.select(key, *(F.col("last")[c].alias(c) for c in rest)).select(rows.columns)


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def replaced(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in ``fresh`` give way to its rows."""
    return without(table, fresh, key).unionByName(fresh)


def copied(table: DataFrame, key: str, source: str, target: str) -> DataFrame:
    return table.unionByName(table.filter(F.col(key) == source).withColumn(key, F.lit(target)))


def claimed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the asked documents, those that were pending, now extracting."""
    return docs.join(ids, "doc_uuid", "left_semi").filter("status = 'PENDING'").withColumn("status", F.lit("EXTRACTING"))


def reaped(docs: DataFrame, is_stale: Column, most: int = 3) -> DataFrame:
    """Stale rows go back to pending while retries are left, else fail."""
    again = F.col("retry_count") < most
    return docs.withColumns({
        "next_status": F.when(~is_stale, F.col("status")).when(again, "PENDING").otherwise("FAILED"),
        "next_retry": F.when(is_stale & again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
    })


def last_of_hash(docs: DataFrame, gone: Column, hash_col: str = "file_hash", order: str = "doc_id") -> DataFrame:
    """Rows to delete; ``delete_file`` on the last row of a file that no kept row refers to."""
    refs = docs.groupBy(hash_col).agg(F.count("*").alias("refs"), F.count_if(gone).alias("going"), F.max(F.when(gone, F.col(order))).alias("last"))
    rows = docs.filter(gone).join(refs, hash_col)
    return rows.withColumn("delete_file", (F.col("refs") == F.col("going")) & (F.col(order) == F.col("last"))).drop("refs", "going", "last")


def transition(status: Column, command: Column, retry: Column, most: int = 3) -> Column:
    """Next status on a command: retry, restart, cancel; null where it is not allowed."""
    return (
        F.when((command == "retry") & (status == "FAILED") & (retry < most), "PENDING")
        .when((command == "restart") & status.isin("FAILED", "COMPLETED"), "PENDING")
        .when((command == "cancel") & ~status.isin("FAILED", "COMPLETED"), "FAILED")
    )


def upload_decisions(uploads: DataFrame, docs: DataFrame, allowed: Column, most: int = 3) -> DataFrame:
    """What becomes of each upload, by its file's hash: the uploader's own document comes first, then a
    completed one, then any; within an upload batch the first of equal files counts.

    Known documents come down to one for each hash and one for each hash and owner, with map-side
    combining, before uploads meet them: a common file makes no more rows than there are uploads."""
    rows = uploads.withColumn("ok", allowed)
    firsts = rows.filter("ok").groupBy("batch", "file_hash").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(firsts, ["batch", "file_hash"], "left")
    seen = lambda rank: F.min(F.struct(rank.alias("rank"), "created_s", "doc_id", "status", "uploaded_by_id", "retry_count"))
    any_one = docs.groupBy("file_hash").agg(seen(F.when(F.col("status") == "COMPLETED", 1).otherwise(2)).alias("any_one"))
    own = docs.groupBy(F.col("file_hash").alias("own_hash"), F.col("uploaded_by_id").alias("owner")).agg(seen(F.lit(0)).alias("own"))
    rows = rows.join(any_one, "file_hash", "left").join(own, (F.col("file_hash") == F.col("own_hash")) & F.col("actor").eqNullSafe(F.col("owner")), "left")
    rows = rows.withColumn("best", F.coalesce("own", "any_one")).drop("own", "own_hash", "owner", "any_one")
    best = F.col("best")
    decision = (
        F.when(~F.col("ok"), "invalid")
        .when(F.col("seq") > F.col("first_seq"), "duplicate")
        .when(best["status"].isNull(), "fresh")
        .when((best["status"] == "COMPLETED") & best["uploaded_by_id"].eqNullSafe(F.col("actor")), "cached")
        .when(best["status"] == "COMPLETED", "clone")
        .when(best["status"] != "FAILED", "busy")
        .when(best["retry_count"] < most, "retry")
        .otherwise("exhausted")
    )
    return rows.withColumn("decision", decision).withColumn("doc_id", F.when(best["status"].isNotNull(), best["doc_id"])).drop("best", "ok", "first_seq")


#: The states of a document in order.
NEXT = {"PENDING": "EXTRACTING", "EXTRACTING": "REFINING", "REFINING": "EMBEDDING", "EMBEDDING": "COMPLETED"}


def advanced(status: Column, failed: Column, over_budget: Column) -> Column:
    """The next state of a document in work: failed on an error, and before extraction and refinement also on a spent budget."""
    steps = F.create_map(*(F.lit(x) for pair in NEXT.items() for x in pair))
    stopped = failed | (over_budget & status.isin("PENDING", "EXTRACTING"))
    return F.when(status.isin("COMPLETED", "FAILED"), status).when(stopped, "FAILED").otherwise(steps[status])


def ingest_decisions(found: DataFrame, docs: DataFrame, over_budget: bool = False, force: bool = False) -> DataFrame:
    """What becomes of each scanned file: known by hash and name is skipped, by hash alone cloned (unless forced), else pending or refused."""
    named = docs.select("file_hash", "original_filename", F.lit(True).alias("same")).distinct()
    hashed = docs.filter("status = 'COMPLETED'").select("file_hash", F.lit(True).alias("copy")).distinct()
    rows = found.join(named, ["file_hash", "original_filename"], "left").join(hashed, "file_hash", "left")
    known = F.lit(not force)
    decision = F.when(known & F.col("same"), "skip").when(known & F.col("copy"), "clone").otherwise("refused" if over_budget else "pending")
    return rows.withColumn("decision", decision).drop("same", "copy")
