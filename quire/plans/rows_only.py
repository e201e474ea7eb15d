"""Registered queries whose operators leave built-in expressions, with SQL where it can express them; unit tests hold the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as T
from quire.functions.vector import hashed_embedding
from quire.operators import access, exports, ingest, retrieval
from quire.plans.model import model, raw
from quire.plans.queries import _CHUNKS, chunk_table
from quire.plans.registry import query
from quire.sources import files
from quire.sources.tables import table
from quire.streaming.limits import activity


#: A text's embedding in parts of eight values, not yet of length 1: signed numbers of SHA-256 of the text and a counter.
_SIGNED = r"""digests AS (SELECT content, unnest(range(96)) AS k FROM (SELECT DISTINCT content FROM chunks)),
    numbers AS (SELECT content, k, list_transform(range(8), lambda i: ('0x' || substr(sha256(encode(content) || from_hex(printf('%08x', k))), i * 8 + 1, 8))::bigint) AS v FROM digests),
    signed AS (SELECT content, k, list_transform(v, lambda x: (x - CASE WHEN x >= 2147483648 THEN 4294967296 ELSE 0 END) / 2147483648.0::double) AS v FROM numbers)"""
_HASHED = rf"""{_SIGNED},
    firsts AS (SELECT content, any_value(v[1]) FILTER (WHERE k = 0) / sqrt(sum(list_sum(list_transform(v, lambda x: x * x)))) AS first FROM signed GROUP BY content),
    told AS (SELECT doc_uuid || '_' || cast(chunk_index as string) AS chunk_id, round(first, 6) AS first FROM chunks JOIN firsts USING (content))"""


@query("r3_hybrid_search")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: chunks of visible documents, embedded, searched by vector and whole text for all items divisible by 50, fused, with context blocks."""
    docs = access.scoped(model(spark, d, "docs").filter("status = 'COMPLETED'"), "u1")
    asked = raw(spark, d, "benchmark").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), hashed_embedding("text").alias("query_vector"), F.col("text").alias("query_text"))
    chunks = table(ingest.embedded(ingest.chunked(docs)).drop("language"), "chunks")  # both searches and the last join read them
    best = retrieval.hybrid(chunks, asked, 5)
    best = retrieval.with_documents(best.drop("embedding"), docs)
    place = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return best.withColumn("block", retrieval.block(place)).select("query_id", "chunk_id", "doc_uuid", "score", "block", retrieval.deep_link("doc_uuid", "anchor_id", "page_number").alias("deep_link"))


@query("r2_m3_embedding", f"WITH {_CHUNKS}, {_HASHED} SELECT chunk_id, cast(768 as int) AS n, first FROM told")
def r2(spark, d):
    rows = ingest.embedded(chunk_table(spark, d))
    return rows.select("chunk_id", F.size("embedding").alias("n"), F.round(F.element_at("embedding", 1), 6).alias("first"))


@query("jn6_embedding_reuse", f"WITH {_CHUNKS}, {_HASHED} SELECT chunk_id, first FROM told")
def jn6(spark, d):
    rows = chunk_table(spark, d).select("chunk_id", "content")
    known = ingest.embedded(rows.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0))
    return ingest.embedded_reusing(rows, known).select("chunk_id", F.round(F.element_at("embedding", 1), 6).alias("first"))


@query(
    "r7_memory_recall",
    f"""WITH chunks AS (SELECT text AS content FROM benchmark UNION ALL SELECT memory_text FROM memories WHERE role = 'user'), {_SIGNED},
    vectors AS MATERIALIZED (SELECT content, flatten(list(v ORDER BY k)) AS x FROM signed GROUP BY content),
    asked AS (SELECT item_id AS query_id, x AS y FROM benchmark JOIN vectors ON text = content), held AS (SELECT conv_id || '-' || turn AS memory_id, x FROM memories JOIN vectors ON memory_text = content WHERE role = 'user')
    SELECT query_id, memory_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(x, y), 12) DESC, memory_id) as int) AS place FROM asked, held QUALIFY place <= 5""",
)
def r7(spark, d):
    rows = model(spark, d, "memories").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("memory_id"), "memory_text")
    asked = raw(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), hashed_embedding("text").alias("query_vector"))
    return retrieval.nearest(asked, ingest.embedded(rows, "memory_text"), 5, "memory_id").select("query_id", "memory_id", "place")


@query(
    "r12_self_heal",
    f"""WITH {_CHUNKS} SELECT chunks.doc_uuid || '_' || cast(chunk_index as string) AS chunk_id, cast(768 as int) AS n
    FROM chunks JOIN docs USING (doc_uuid) WHERE status = 'COMPLETED'
    AND (chunks.doc_id % 3 = 0 OR chunks.doc_uuid NOT IN (SELECT doc_uuid FROM chunks WHERE doc_id % 3 <> 0))""",
)
def r12(spark, d):
    docs = model(spark, d, "docs")
    missing = ingest.unchunked(docs, ingest.chunked(docs.filter("doc_id % 3 <> 0")))
    return ingest.embedded(ingest.chunked(missing)).select("chunk_id", F.size("embedding").alias("n"))


#: The last place of a border in the window, from 1; 0 where there is none.
_LAST = "CASE WHEN strpos(reverse({0}), reverse({1})) > 0 THEN length({0}) - strpos(reverse({0}), reverse({1})) - length({1}) + 2 ELSE 0 END"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(
    "t5_p3_m1_refine",
    f"""WITH RECURSIVE cut AS (
      SELECT doc_uuid, 0 AS piece, cast(NULL as string) AS content, CASE WHEN length(raw_markdown) > 5000 THEN raw_markdown END AS rest FROM docs
      UNION ALL
      SELECT doc_uuid, piece + 1, {_TRIM.format("CASE WHEN length(rest) > 5000 THEN left(rest, place) ELSE rest END")},
        CASE WHEN length(rest) > 5000 THEN {_TRIM.format("substr(rest, place + 1)")} END
      FROM (SELECT *, CASE WHEN last_border > 0 THEN 4000 + last_border - 1 ELSE 5000 END AS place FROM
        (SELECT *, greatest({", ".join(_LAST.format("window_", f"(chr(10) || '{m}')") for m in ("## ", "# ", "### "))}, {_LAST.format("window_", "(chr(10) || chr(10))")}) AS last_border
         FROM (SELECT *, substr(rest, 4001, 1000) AS window_ FROM cut WHERE rest <> '')))),
    pieces AS (SELECT doc_uuid, piece, content FROM cut WHERE piece > 0 UNION ALL SELECT doc_uuid, 0, raw_markdown FROM docs WHERE length(raw_markdown) <= 5000)
    SELECT doc_uuid, string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY piece) AS refined_markdown FROM pieces GROUP BY doc_uuid""",
)
def t5(spark, d):
    parts = ingest.pieces(model(spark, d, "docs"), most=5000)
    return ingest.rejoined(ingest.generated(parts))


@query("t6_slug", r"SELECT doc_uuid, trim(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-_') AS slug FROM docs")
def t6(spark, d):
    return model(spark, d, "docs").select("doc_uuid", markup.slugged("title").alias("slug"))


@query("t8_sanitize")
def t8(spark, d):
    return raw(spark, d, "pages").select("page_id", markup.sanitized("html").alias("html"))


@query("t9_rtl")
def t9(spark, d):
    return raw(spark, d, "pages").select("page_id", markup.rtl_tagged("html").alias("html"))


@query("t10_render")
def t10(spark, d):
    return raw(spark, d, "documents").select("doc_id", markup.rendered("text").alias("html"))


@query("t11_front_matter", r"SELECT doc_uuid, regexp_replace(raw_markdown, '^\s+|\s+$', '', 'g') AS text, regexp_replace('title: ' || title, '\s+$', '') AS yaml, cast(0 as int) AS pairs FROM docs")
def t11(spark, d):
    text = F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\n---\n"), F.col("raw_markdown"))
    return model(spark, d, "docs").select("doc_uuid", markup.split_front_matter(text).alias("x")).select("doc_uuid", "x.text", "x.yaml", F.size("x.pairs").alias("pairs"))


@query(
    "t12_yaml_repair",
    r"""WITH texts AS (SELECT doc_uuid, 'title: ' || title || chr(10) || 'author: ' || chr(39) || author || chr(39) AS t FROM docs),
    cut AS (SELECT doc_uuid, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM texts),
    parts AS (SELECT *, regexp_extract(x, '^(\s*[\w-]+):[ \t]+(\S.*?)\s*$', 1) AS k, regexp_extract(x, '^(\s*[\w-]+):[ \t]+(\S.*?)\s*$', 2) AS v FROM cut)
    SELECT doc_uuid, string_agg(CASE WHEN k <> '' AND NOT regexp_matches(v, '^".*"$|^[\[{|>]')
      THEN k || ': "' || replace(regexp_replace(v, '^\x27(.*)\x27$', '\1'), '"', '\"') || '"' ELSE x END, chr(10) ORDER BY n) AS yaml
    FROM parts GROUP BY doc_uuid""",
)
def t12(spark, d):
    text = F.concat(F.lit("title: "), F.col("title"), F.lit("\nauthor: '"), F.col("author"), F.lit("'"))
    return model(spark, d, "docs").select("doc_uuid", T.quoted_yaml(text).alias("yaml"))


#: Half-even rounding in whole units: the units of ``unit`` in a number, then with so many decimals.
_UNITS = "(({0}) // {1} + CASE WHEN ({0}) % {1} * 2 > {1} OR (({0}) % {1} * 2 = {1} AND ({0}) // {1} % 2 = 1) THEN 1 ELSE 0 END)"
_FIXED = "printf('%d.%0{2}d', cast({0} // {1} as bigint), cast({0} % {1} as bigint))"
_USD = f"'$' || CASE WHEN c > 0 AND c < 100000 THEN {_FIXED.format(_UNITS.format('c', 100), 10000, 4)} ELSE {_FIXED.format(_UNITS.format('c', 10000), 100, 2)} END"
_PLACE = lambda values: f"{values}[doc_id % {len(T.RATES)} + 1]"


@query(
    "t25_money",
    f"""WITH p AS (SELECT doc_uuid, cast(cost_micro as hugeint) AS c, {_PLACE([*T.RATES])} AS currency, {_PLACE([round(r * 10_000) for r in T.RATES.values()])} AS rate, {_PLACE([T.SYMBOLS[c] for c in T.RATES])} AS symbol FROM docs)
    SELECT doc_uuid, CASE WHEN currency = 'USD' THEN {_USD} ELSE symbol || CASE WHEN currency = 'IDR' THEN format('{{:,}}', cast(c * rate // 10000000000 as bigint)) ELSE {_FIXED.format(_UNITS.format("c * rate", 100_000_000), 100, 2)} END
      || ' (~' || {_USD} || ')' END AS shown FROM p""",
)
def t25(spark, d):
    cost = F.col("cost_micro").cast("decimal(18,0)") / F.lit(1000000)
    currency = F.element_at(F.array(*(F.lit(c) for c in T.RATES)), (F.col("doc_id") % len(T.RATES) + 1).cast("int"))
    rate = F.create_map(*(F.lit(x) for pair in T.RATES.items() for x in pair))[currency]
    return model(spark, d, "docs").select("doc_uuid", T.money(cost, currency, rate).alias("shown"))


@query("t32_composed", "SELECT doc_id, length(nfc_normalize(text)) AS n FROM documents")
def t32(spark, d):
    return raw(spark, d, "documents").select("doc_id", F.length(markup.composed("text")).alias("n"))


@query(
    "src8_file_router",
    r"""WITH f AS (SELECT doc_uuid, doc_id, raw_markdown, original_filename || CASE WHEN doc_id % 2 = 0 THEN '.csv' ELSE '' END AS path, CASE WHEN doc_id % 2 = 0 THEN 'a,b' || chr(10) || '"' || replace(raw_markdown, '"', '""') || '",2' || chr(10) ELSE raw_markdown END AS content FROM docs)
    SELECT doc_uuid, path, CASE WHEN doc_id % 2 = 0 THEN 'csv' ELSE 'txt' END AS ext, sha256(content) AS file_hash, cast(1 as int) AS page_count,
      CASE WHEN doc_id % 2 = 0 THEN '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(replace(replace(raw_markdown, '|', '\|'), chr(13) || chr(10), '<br>'), chr(10), '<br>') || ' | 2 |' ELSE raw_markdown END AS raw_markdown FROM f""",
)
def src8(spark, d):
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a,b\n"), F.lit('"'), F.replace("raw_markdown", F.lit('"'), F.lit('""')), F.lit('",2\n'))).otherwise(F.col("raw_markdown"))
    path = F.concat("original_filename", F.when(F.col("doc_id") % 2 == 0, ".csv").otherwise(""))
    return files.markdown(model(spark, d, "docs").select("doc_uuid", path.alias("path"), F.encode(content, "UTF-8").alias("content")))


@query("snk12_bundle")
def snk12(spark, d):
    return exports.bundle(model(spark, d, "docs")).select("path", F.length("content").alias("n"))


@query("activity_windows", "SELECT cast(floor(at_s / 3600) * 3600 as bigint) AS start_s, action, count(*) AS n FROM audit GROUP BY ALL")
def windows(spark, d):
    """Hourly audit activity (beyond the reference); the same function serves a stream."""
    return activity(model(spark, d, "audit").withColumn("at", F.timestamp_seconds("at_s"))).select(F.unix_timestamp("window.start").alias("start_s"), "action", "n")
