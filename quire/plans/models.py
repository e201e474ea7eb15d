"""Registered queries of calls to models: refinement with stored answers, preference memories, limits on busy keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions.metadata import described
from quire.operators.archive import EMPTY, archived, files, master
from quire.operators.refinement import AnswerStore, preferences, refined
from quire.operators.retrieval import prices_matched
from quire.operators.routing import routed_models
from quire.operators.upkeep import current_settings
from quire.plans.model import model, raw
from quire.plans.queries import _WINDOWED
from quire.plans.registry import query
from quire.sources.tables import joined_spread, shared_folder, table
from quire.streaming.limits import EXPORT, SEARCH, Limit, judged_spread


def _store(spark, tag: str) -> AnswerStore:
    return AnswerStore(f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/answers", tag)


def _bracketed(texts: list[str]) -> list[str]:
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("this model fails on some lengths")
    return [f"[{t}]" for t in texts]


def _down(texts: list[str]) -> list[str]:
    raise ValueError("no model answers")


@query(
    "p3_refined_once",
    """SELECT doc_uuid, CASE WHEN doc_id % 5 = 0 THEN 'refined before, kept as it is ' || doc_uuid WHEN length(raw_markdown) % 7 = 0 OR trim(raw_markdown) = '' THEN raw_markdown ELSE '[' || raw_markdown || ']' END AS refined_markdown,
    cast(doc_id % 5 <> 0 AND length(raw_markdown) % 7 = 0 AND trim(raw_markdown) <> '' as int) AS failed_pieces FROM docs""",
)
def p3(spark, d):
    """Documents refined twice: the second time no model answers, and what the first run stored is there; every fifth document was refined before."""
    before = F.col("doc_id") % 5 == 0
    docs = model(spark, d, "docs").withColumns(
        {"refined_markdown": F.when(before, F.concat(F.lit("refined before, kept as it is "), F.col("doc_uuid"))), "yaml_metadata": F.when(before, F.lit("title: kept"))}
    )
    store = _store(spark, "editor")
    table(refined(docs, store, _bracketed, split=False), "first_run")
    return refined(docs, store, _down, split=False).select("doc_uuid", "refined_markdown", "failed_pieces")


def _distilled(texts: list[str]) -> list[str]:
    if any(len(t) % 5 == 0 for t in texts):
        raise ValueError("this model fails on some lengths")
    return ["none." if len(t) % 5 == 1 else f"'User says: {len(t)} letters.'" for t in texts]


@query(
    "p17_preference_memories",
    """WITH said AS (SELECT user_id, 'Please use ' || trim(memory_text) AS t FROM memories WHERE role = 'user' AND user_id <> 'u6'),
    told AS (SELECT user_id, CASE length(t) % 5 WHEN 0 THEN rtrim(t, '.') WHEN 1 THEN NULL ELSE 'User says: ' || cast(length(t) as string) || ' letters' END AS memory_text FROM said)
    SELECT DISTINCT user_id, memory_text, cast(768 as int) AS n FROM told WHERE memory_text <> ''""",
)
def p17(spark, d):
    """What users say as stated preferences, distilled by a model that fails on some and finds none in others, embedded."""
    said = model(spark, d, "memories").filter("role = 'user'").select("user_id", F.concat(F.lit("Please use "), F.trim("memory_text")).alias("text"))
    users = model(spark, d, "users").filter("user_id <> 'u6'")
    return preferences(said, _store(spark, "distil"), _distilled, users).select("user_id", "memory_text", F.size("embedding").alias("n"))


def _spread(spark, d, limit: Limit):
    """All events of a key that holds half of them, and of the users."""
    rows = raw(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp("ts").alias("at_s"), "event_id")
    return judged_spread(rows, limit).select("event_id", "allowed")


@query("p12_spread_hour_limit", _WINDOWED.format(s=3600 * 24, m=5, rearm="false"))
def p12(spark, d):
    return _spread(spark, d, Limit(5, 3600 * 24))


@query("p13_spread_search_limit", _WINDOWED.format(s=3600 * 20, m=3, rearm="true"))
def p13(spark, d):
    return _spread(spark, d, Limit(3, 3600 * 20, rearm=SEARCH.rearm))


@query("p14_spread_export_limit", _WINDOWED.format(s=3600 * 12, m=1, rearm="false"))
def p14(spark, d):
    return _spread(spark, d, Limit(EXPORT.most, 3600 * 12))


_AT = "2024-02-01T00:00:00+00:00"
_SLUG = r"trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_')"
_ARCHIVED = f"""made AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'refined ' || doc_uuid ELSE coalesce(nullif(raw_markdown, ''), '{EMPTY}') END AS body FROM docs WHERE status = 'COMPLETED'),
    named AS (SELECT *, printf('%03d_', ordinal) || coalesce(nullif({_SLUG.format("coalesce(nullif(title, ''), original_filename)")}, ''), 'document_' || doc_uuid) AS base,
      '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'author: "' || author || '"' || chr(10) || 'language: "' || language || '"' || chr(10) || 'document_type: "' || document_type || '"' || chr(10)
      || 'source_hash: "' || file_hash || '"' || chr(10) || 'exported_at: "{_AT}"' || chr(10) || '---' || chr(10) || chr(10) || body AS content FROM made)"""


def _archive(spark, d):
    docs = model(spark, d, "docs").filter("status = 'COMPLETED'")
    return archived(docs.withColumn("refined_markdown", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("refined "), F.col("doc_uuid")))), _AT)


@query(
    "snk12_archive_files",
    f"""WITH {_ARCHIVED} SELECT unnest(['documents/' || base || '.md', 'Language/' || {_SLUG.format("language")} || '/' || base || '.md', 'Author/' || {_SLUG.format("author")} || '/' || base || '.md']) AS path, sha256(content) AS hash FROM named""",
)
def snk12(spark, d):
    """Every file of the archive of completed documents, refined text before raw text."""
    return files(_archive(spark, d)).select("path", F.sha2("content", 256).alias("hash"))


@query(
    "snk12_archive_manifest",
    f"""WITH {_ARCHIVED} SELECT doc_id AS id, original_filename AS filename, title, author, language, document_type AS type, page_count, cost_micro / 1e6 AS cost_usd, file_hash AS hash, 'documents/' || base || '.md' AS export_path FROM named""",
)
def snk12_manifest(spark, d):
    """The manifest's entries."""
    return _archive(spark, d).select("entry.*")


@query(
    "snk12_archive_master",
    f"""WITH {_ARCHIVED} SELECT ordinal, sha256('<!-- SOURCE_START_' || ordinal || ': ' || title || ' by ' || author || ' (' || language || ') [Type: ' || document_type || ', Hash: ' || file_hash || '] -->' || chr(10) || chr(10)
    || '# SOURCE: ' || title || chr(10) || chr(10) || '**Author:** ' || author || '  ' || chr(10) || '**Language:** ' || language || '  ' || chr(10) || '**Document Type:** ' || document_type || chr(10) || chr(10) || body || chr(10) || chr(10)
    || '<!-- SOURCE_END_' || ordinal || ' -->' || chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS hash FROM named""",
)
def snk12_master(spark, d):
    """The sections of the master text."""
    return master(_archive(spark, d)).select("ordinal", F.sha2("section", 256).alias("hash"))


_PARSED = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN title WHEN 1 THEN 'Unknown' WHEN 2 THEN NULL ELSE repeat(title || '-', 9) END AS title,
    CASE doc_id % 5 WHEN 0 THEN author WHEN 1 THEN 'n/a' WHEN 2 THEN 'Divinely revealed' WHEN 3 THEN '' ELSE 'By ' || author END AS author, CASE WHEN doc_id % 3 = 0 THEN language END AS language,
    CASE doc_id % 4 WHEN 0 THEN 'c. ' || publication_year || ' AD' WHEN 1 THEN 'none' ELSE publication_year END AS publication_year, CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/' || doi || ' ' WHEN 1 THEN doi END AS doi,
    CASE WHEN doc_id % 2 = 0 THEN publisher END AS publisher, CASE WHEN doc_id % 2 = 0 THEN license_type ELSE 'undefined' END AS license_type, CASE WHEN doc_id % 2 = 0 THEN '' ELSE document_type END AS document_type,
    CASE WHEN doc_id % 6 = 0 THEN 'sahih_' ELSE 'a-b_' END || original_filename AS filename FROM {docs}"""


@query(
    "t14_described",
    f"""WITH p AS ({_PARSED.format(docs="docs")}), k AS (SELECT doc_id, filename, {", ".join(f"CASE WHEN lower(trim({c})) IN ('unknown', 'n/a', 'none', 'null', 'undefined', '') THEN NULL ELSE {c} END AS {c}" for c in ("title", "author", "language", "publication_year", "doi", "publisher", "license_type"))}, document_type FROM p)
    SELECT doc_id, coalesce(left(title, 255), trim(replace(replace(regexp_replace(filename, '[.][^.]*$', ''), '_', ' '), '-', ' '))) AS title,
      CASE WHEN contains(filename, 'sahih') AND (author IS NULL OR contains(lower(author), 'divinely')) THEN 'Sahih International' ELSE coalesce(author, 'Anonymous') END AS author, coalesce(language, 'English') AS language,
      coalesce(nullif(regexp_extract(publication_year, '[0-9]{{4}}'), ''), 'old') AS publication_year, coalesce(trim(replace(doi, 'https://doi.org/', '')), 'old') AS doi, coalesce(publisher, 'old') AS publisher, coalesce(license_type, 'old') AS license_type, coalesce(nullif(document_type, ''), 'old') AS document_type FROM k""",
)
def t14(spark, d):
    """Metadata after a parse that names some fields, denies others and leaves the rest open."""
    rows = spark.sql(_PARSED.format(docs="{t}"), t=model(spark, d, "docs"))
    names = ["title", "author", "language", "publication_year", "doi", "publisher", "license_type", "document_type"]
    parsed = {n: F.col(n) for n in names} | {"semantic_signature": F.lit(None).cast("string")}
    found = described(parsed, dict.fromkeys([*names, "semantic_signature"], F.lit("old")), F.col("filename"))
    return rows.select("doc_id", *(found[n].alias(n) for n in names))


_ASKED = "CASE doc_id % 6 WHEN 0 THEN 'google/m' || cast(doc_id % 300 as string) WHEN 1 THEN 'm' || cast(doc_id as string) || 'x' WHEN 2 THEN 'maker/model' WHEN 3 THEN 'auto' WHEN 4 THEN NULL ELSE 'm' || cast(doc_id % 300 as string) END"


@query(
    "m5_routed_models",
    f"""WITH prices AS (SELECT 'm' || cast(p_partkey as string) AS model, p_retailprice AS price, p_size % 2 = 0 AS vision FROM part),
    best AS (SELECT (SELECT model FROM prices ORDER BY price, model LIMIT 1) AS any_model, (SELECT model FROM prices WHERE vision ORDER BY price, model LIMIT 1) AS vision_model),
    asked AS (SELECT doc_id, coalesce(replace({_ASKED}, 'google/', ''), 'auto') AS name, doc_id % 4 = 0 AS vision, doc_id % 5 = 0 AS has_key FROM documents)
    SELECT doc_id, CASE WHEN name = 'auto' THEN CASE WHEN vision THEN vision_model WHEN has_key THEN 'openrouter/free' ELSE any_model END WHEN contains(name, '/') OR name IN (SELECT model FROM prices) THEN name ELSE any_model END AS final_model,
      contains(name, '/') OR (name = 'auto' AND NOT vision AND has_key) AS router FROM asked, best""",
)
def m5(spark, d):
    """Requests of known, stale, foreign, automatic and missing models against parts as a price list."""
    prices = raw(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 2 == 0).alias("vision"))
    asked = raw(spark, d, "documents").selectExpr("doc_id", f"{_ASKED} AS model", "doc_id % 4 = 0 AS vision", "doc_id % 5 = 0 AS has_key")
    return routed_models(asked, prices).select("doc_id", "final_model", "router")


_CATALOG = "SELECT cast(row_number() OVER (ORDER BY t) - 1 as int) AS pos, CASE WHEN length(t) % 2 = 0 THEN 'maker/' ELSE '' END || t AS model, cast(length(t) as string) AS prompt, '0' AS completion FROM (SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS t FROM {part})"
_NAMED = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'maker/' || t WHEN 1 THEN t WHEN 2 THEN t || '-2025' ELSE 'no-' || cast(p_partkey % 5 as string) END AS model FROM (SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS t FROM {part})"


@query(
    "jn8_catalog_match",
    f"""WITH c AS ({_CATALOG.format(part="part")}), m AS ({_NAMED.format(part="part")}), n AS (SELECT DISTINCT model FROM m),
    l AS (SELECT n.model, pos, c.model AS price_model, CASE WHEN n.model = c.model THEN 1 WHEN n.model = split_part(c.model, '/', -1) THEN 2
      WHEN contains(n.model, c.model) OR contains(c.model, n.model) OR contains(c.model, split_part(n.model, '/', -1)) THEN 3 END AS level FROM n, c),
    b AS (SELECT model, first(level ORDER BY level, pos) AS level, first(price_model ORDER BY level, pos) AS price_model FROM l WHERE level IS NOT NULL GROUP BY model)
    SELECT p_partkey, level, price_model FROM m LEFT JOIN b USING (model)""",
)
def jn8(spark, d):
    """Names of every part's type, whole, without a maker, with a suffix or unknown, against a catalog of all types."""
    part = raw(spark, d, "part")
    named = spark.sql(_NAMED.format(part="{t}"), t=part)
    found = table(prices_matched(named.select("model").distinct(), spark.sql(_CATALOG.format(part="{t}"), t=part)), "matched")
    return joined_spread(table(named, "named"), found.select("model", "level", "price_model"), "model").select("p_partkey", "level", "price_model")


@query(
    "src18_stored_settings",
    """SELECT 'stored' AS kind, cast(r_regionkey * 1000 + 5 as bigint) AS monthly_budget_micro, lower(r_name) AS selected_model, 'auto' AS currency FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
    UNION ALL SELECT 'none', 10000000, 'auto', 'auto'""",
)
def src18(spark, d):
    """The one row of settings where some are stored (the first counts), and the defaults where none are."""
    stored = raw(spark, d, "region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") * 1000 + 5).cast("long").alias("monthly_budget_micro"), F.lower("r_name").alias("selected_model"), F.lit(None).cast("string").alias("currency"))
    kinds = lambda some, kind: current_settings(some, "id").select(F.lit(kind).alias("kind"), "monthly_budget_micro", "selected_model", "currency")
    return kinds(stored, "stored").unionByName(kinds(stored.filter("id < 0"), "none"))


def _edited(texts: list[str]) -> list[str]:
    return [f'---\ntitle: T{len(t)}\nauthor: A\n---\nBody {len(t)}\n\n```json\n[{{"question": "q{len(t)}", "answer": "a"}}, {{"question": "r", "answer": "b"}}]\n```' for t in texts]


@query(
    "m6_editorial_answers",
    """SELECT doc_uuid, 'Body ' || length(raw_markdown) AS refined_markdown, 'title: T' || length(raw_markdown) || chr(10) || 'author: A' AS yaml_metadata, 'q' || length(raw_markdown) AS first_question, cast(2 as int) AS n_pairs
    FROM docs WHERE trim(raw_markdown) <> ''""",
)
def m6(spark, d):
    """An editor's answers parted into text, metadata and questions."""
    docs = model(spark, d, "docs").filter(F.trim("raw_markdown") != "").select("doc_uuid", "raw_markdown")
    found = refined(docs, _store(spark, "editor"), _edited)
    return found.select("doc_uuid", "refined_markdown", "yaml_metadata", F.col("pairs")[0]["question"].alias("first_question"), F.size("pairs").alias("n_pairs"))
