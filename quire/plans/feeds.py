"""Registered queries over feeds as folders of snapshots, which Spark writes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.model import model, raw
from quire.plans.registry import query
from quire.sources import feeds
from quire.sources.tables import shared_folder
from quire.streaming import entries


def _written(snapshots: DataFrame, name: str) -> DataFrame:
    """``snapshot, value`` as files, a folder a snapshot, read back by the source."""
    spark = snapshots.sparkSession
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"
    snapshots.select("snapshot", "value").repartition("snapshot").write.partitionBy("snapshot").text(path)
    spark.dataSource.register(feeds.SnapshotSource)
    return spark.read.format("snapshots").load(path)


@query(
    "src14_price_snapshots",
    """WITH p AS (SELECT 'm' || cast(p_partkey as string) AS model, p_size AS day, p_retailprice AS price FROM part UNION ALL SELECT 'm' || cast(p_partkey as string), 99, p_retailprice * 2 FROM part WHERE p_partkey % 3 = 0)
    SELECT model, cast(round(arg_max(price, day) * 100) as bigint) AS cents, max(day) AS day FROM p GROUP BY model""",
)
def src14(spark: SparkSession, d: str) -> DataFrame:
    """The last price of each part, from a price list for each size and a later one that doubles some."""
    parts = raw(spark, d, "part").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", "p_size", "p_retailprice")
    days = parts.select("id", F.col("p_size").alias("day"), "p_retailprice").unionByName(parts.filter("p_partkey % 3 = 0").select("id", F.lit(99).alias("day"), (F.col("p_retailprice") * 2).alias("p_retailprice")))
    one = F.struct("id", F.struct(F.col("p_retailprice").cast("decimal(20,2)").cast("string").alias("prompt"), F.lit("0").alias("completion")).alias("pricing"))
    listed = days.groupBy(F.format_string("d%03d", "day").alias("snapshot")).agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("value"))
    last = feeds.newest(feeds.prices(_written(listed, "prices")), "model")
    return last.select("model", F.round(F.col("prompt") * 100).cast("long").alias("cents"), F.regexp_extract("snapshot", r"d(\d+)", 1).cast("int").alias("day"))


@query(
    "src16_log_snapshots",
    """SELECT at_s, CASE event_id % 3 WHEN 0 THEN 'HTTP GET /' || action || '?id=' || cast(event_id as string) || ' - Status: 200 - Latency: 1s' WHEN 1 THEN 'text ' || cast(event_id as string) ELSE 'json ' || cast(event_id as string) END AS message
    FROM audit ORDER BY 1 DESC, 2 DESC LIMIT 100""",
)
def src16(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred entries of service logs, a snapshot for each day of events."""
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 3
    entry = F.struct(
        F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.when(kind == 1, F.concat(F.lit("text "), n)).alias("textPayload"),
        F.when(kind == 2, F.struct(F.concat(F.lit("json "), n).alias("message"))).alias("jsonPayload"),
        F.when(kind == 0, F.struct(F.lit("GET").alias("requestMethod"), F.concat(F.lit("https://x.org/"), "action", F.lit("?id="), n).alias("requestUrl"), F.lit("200").alias("status"), F.lit("1s").alias("latency"))).alias("httpRequest"),
    )
    rows = model(spark, d, "audit").withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(8)))  # a day is several files, so none grows with a busy day alone
    day = F.concat(F.date_format(F.timestamp_seconds("at_s"), "yyyy-MM-dd"), F.lit("-"), F.col("part").cast("string"))
    days = rows.groupBy(day.alias("snapshot")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    found = feeds.newest_entries(feeds.log_entries(_written(days, "logs")))
    return found.select(F.unix_timestamp("at").alias("at_s"), "message")


_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _streamed(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """What a stream over all events tells, run until it has read them; the session's state store is as before afterwards."""
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"
    given = raw(spark, d, "events")
    given.write.parquet(f"{path}/in")  # a stream reads folders
    events = spark.readStream.schema(given.schema).parquet(f"{path}/in")
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        told = build(events)
        told.writeStream.option("checkpointLocation", f"{path}/marks").format("parquet").option("path", f"{path}/told").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(told.schema).parquet(f"{path}/told")


@query(
    "p11_status_feed",
    """SELECT user_id AS doc_id, "before", status, at_ms FROM (SELECT user_id, event_type AS status, epoch_us(ts) // 1000 AS at_ms, lag(event_type) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS "before" FROM events) WHERE status IS DISTINCT FROM "before" """,
)
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Changes of status as a stream tells them: events as what was seen of a document."""
    told = _streamed(spark, d, "status", lambda e: entries.status_feed(e.select(F.col("user_id").cast("string").alias("doc_uuid"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"), "event_id")))
    return told.select(F.col("doc_uuid").cast("long").alias("doc_id"), "before", "status", F.unix_millis("at").alias("at_ms"))


@query(
    "snk7_snk9_entries_stream",
    """WITH w AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN user_id % 3 > 0 THEN epoch_us(ts) // 1000 + (user_id % 10) * 86400000 END AS until FROM events),
    l AS (SELECT user_id, max(event_id) FILTER (WHERE r = 1) AS event_id, max(until) FILTER (WHERE r = 1) AS until FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) AS r FROM w) GROUP BY user_id)
    SELECT user_id, event_id, 'set' AS change FROM l UNION ALL SELECT user_id, event_id, 'purged' FROM l WHERE until <= (SELECT max(ms) FROM w) - 60000""",
)
def snk7(spark: SparkSession, d: str) -> DataFrame:
    """Key-value writes with a time to live as a stream: what takes effect, and what is purged when its time is over."""
    ttl = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 10 * 86_400)
    told = _streamed(
        spark, d, "entries", lambda e: entries.entries_stream(e.select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").cast("string").alias("value"), ttl.alias("ttl_s"), F.col("ts").cast("timestamp").alias("at"), "event_id"))
    )
    return told.select(F.col("cache_key").cast("long").alias("user_id"), F.col("value").cast("long").alias("event_id"), "change")
