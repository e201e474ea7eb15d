"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset on a local master, as in tests, a temporary folder is set for the session;
    a cluster without one is refused, since executors would write where nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, path: str, codec: str = "snappy", by: tuple[str, ...] = (), mode: str = "error") -> None:
    """``df`` written as Parquet. What it shuffled goes when it is written, not when the driver happens to collect its garbage."""
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", df.sparkSession.conf
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.mode(mode).option("compression", codec).partitionBy(*by).parquet(path)
    finally:
        conf.set(name, before)


def table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again, which cuts its lineage.

    A lost executor costs no more than the tasks it ran: what was written stays readable for all.
    Files stay until the folder is cleaned, as checkpoints do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/{name}"
    stored(df, path, codec)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of texts that an Arrow batch holds at most: the JVM and Python both hold whole batches.
TEXT_ROWS = 1000


def text_batches(df: DataFrame, most: int = TEXT_ROWS) -> DataFrame:
    """``df``, in whose session Arrow batches hold at most ``most`` rows from now on (fewer if the session says so)."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    held = int(conf.get(name))
    if held <= 0 or held > most:
        conf.set(name, str(most))
    return df


def small_by_count(df: DataFrame, most: int = 300_000) -> DataFrame:
    """``df`` marked for a broadcast if it is counted to have few rows; a table read from files, so counting is cheap."""
    return F.broadcast(df) if df.count() <= most else df


def joined_spread(rows: DataFrame, known: DataFrame, key: str, parts: int = 32) -> DataFrame:
    """A left join with a table of unique keys, in which a key may hold any share of the rows (a table read from files).

    Keys of over a thousandth of the rows, at most a thousand, are named to all tasks; their rows are dealt to
    ``parts``, each of which has its copy of what is known of the key. Null keys stay without.
    """
    rows, n = rows.withColumn("_n", F.monotonically_increasing_id()), rows.count()
    hot = table(rows.groupBy(key).count().filter(F.col(key).isNotNull() & (F.col("count") * 1000 > n)).select(key, F.lit(True).alias("_hot")), "hot")
    named = lambda df: df.join(F.broadcast(hot), key, "left")
    dealt = named(rows).withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64("_n"), F.lit(parts)).cast("int")).otherwise(0))
    copies = named(known).withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("_hot", "_n").join(copies.drop("_hot"), [key, "_part"], "left").drop("_part")
