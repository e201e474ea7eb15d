"""The engine's tables over the bundled test tables, in Spark and, for comparison, in DuckDB.

One projection per table in SQL that both engines read alike; only the hash function differs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["PENDING", "EXTRACTING", "REFINING", "EMBEDDING", "COMPLETED", "FAILED"]
#: 2024-02-01, the "now" of the queries, in seconds.
NOW = 1706745600

_TABLES = {
    "docs": (
        "documents",
        """cast(doc_id as string) AS doc_uuid, doc_id, source || '_' || cast(doc_id as string) || '.txt' AS original_filename,
        {sha}(text{bits}) AS file_hash, left(text, 40) AS title, source AS author,
        CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE 'Unknown' END AS language, lang,
        CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'CSV' WHEN 2 THEN 'TXT' ELSE 'JSON' END AS document_type,
        CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE 'House ' || cast(doc_id % 5 as string) END AS publisher,
        CASE WHEN doc_id % 6 = 0 THEN '' ELSE cast(1990 + doc_id % 30 as string) END AS publication_year,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE '10.1000/' || cast(doc_id as string) END AS doi,
        CASE WHEN doc_id % 7 = 0 THEN 'CC BY' ELSE 'Unknown' END AS license_type,
        cast(1 + floor(n_chars / 3000) as int) AS page_count,
        CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'u' || cast(doc_id % 7 as string) END AS uploaded_by_id,
        CASE WHEN doc_id % 20 < 14 THEN 'COMPLETED' WHEN doc_id % 20 = 14 THEN 'PENDING' WHEN doc_id % 20 = 15 THEN 'EXTRACTING'
             WHEN doc_id % 20 = 16 THEN 'REFINING' WHEN doc_id % 20 = 17 THEN 'EMBEDDING' ELSE 'FAILED' END AS status,
        cast(floor(n_chars / 4) as bigint) AS input_tokens, cast(floor(n_chars / 16) as bigint) AS output_tokens,
        cast(floor(n_chars / 4) * 2 + floor(n_chars / 16) * 9 as bigint) AS cost_micro,
        cast(doc_id % 5 as int) AS retry_count, text AS raw_markdown, n_chars,
        cast(1704067200 + doc_id * 1800 as bigint) AS created_s,
        cast(1704067200 + doc_id * 1800 + (doc_id % 9) * 60 as bigint) AS updated_s,
        cast(1704067200 + doc_id * 1800 + 1728000 as bigint) AS expires_s""",
    ),
    "users": (
        "(SELECT DISTINCT doc_id % 7 AS k FROM documents)",
        "'u' || cast(k as string) AS user_id, 'name' || cast(k as string) AS username, k = 3 AS is_staff",
    ),
    "audit": (
        "events",
        """event_id, event_type AS action, 'u' || cast(user_id % 7 as string) AS user_id, user_id AS raw_user,
        cast(event_id % 1200 as string) AS doc_uuid, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'event ' || cast(event_id as string) END AS details,
        props AS metadata, '10.0.' || cast(event_id % 4 as string) || '.' || cast(event_id % 250 as string) AS ip_address,
        cast({epoch} as bigint) AS at_s, value""",
    ),
    "memories": ("conversations", "conv_id, turn, 'u' || cast(conv_id % 7 as string) AS user_id, role, text AS memory_text"),
    "ledger": (
        "(SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, o_totalprice AS p FROM orders)",
        "cast(y as int) AS year, cast(m as int) AS month, cast(round(p * 100) as bigint) AS cents",
    ),
}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = _TABLES[name]
    columns = columns.format(sha="sha2", bits=", 256", epoch="unix_timestamp(ts)")
    inner = re.search(r"FROM (\w+)\)$", source)
    table = inner[1] if inner else source
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if inner:
        df = spark.sql(f"SELECT * FROM {source.replace(inner[1] + ')', '{t})')}", t=df)
    return df.selectExpr(*_split(columns))


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _split(columns: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[start:i])
            start = i + 1
    return [*parts, columns[start:]]


def duckdb(sql: str) -> str:
    """The oracle with the model's tables that it names in front."""
    used = [n for n in _TABLES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = [f"{n} AS (SELECT {_TABLES[n][1].format(sha='sha256', bits='', epoch='floor(epoch(ts))')} FROM {_TABLES[n][0]})" for n in used]
    body, more = sql.strip(), ""
    if body.startswith("WITH RECURSIVE "):
        body, more = "WITH " + body[len("WITH RECURSIVE ") :], "RECURSIVE "
    return f"WITH {more}{', '.join(heads)}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"


def at(seconds: str):
    return F.timestamp_seconds(F.col(seconds))
