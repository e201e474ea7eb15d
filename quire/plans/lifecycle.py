"""Registered queries over feeds, costs, upload and pipeline decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import changes, exports, ingest, spend, upkeep
from quire.plans.model import NOW, model, raw
from quire.plans.queries import _CHUNKS, chunk_table
from quire.plans.registry import query
from quire.sources.files import price_list

@query("src13_document_chunks", f"WITH {_CHUNKS} SELECT cast(chunk_index as bigint) AS chunk_index, content FROM chunks WHERE doc_uuid = '42' ORDER BY chunk_index LIMIT 5")
def src13(spark, d):
    rows = ingest.chunked(model(spark, d, "docs").filter("doc_uuid = '42'"))
    return rows.orderBy("chunk_index").limit(5).select(F.col("chunk_index").cast("long").alias("chunk_index"), "content")


@query(
    "src14_price_list",
    "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, 'maker/' || lower(n_name) AS model, n_nationkey * 1000 AS prompt_nano, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey * 2000 END AS completion_nano FROM nation",
)
def src14(spark, d):
    """A feed of as many models as there are nations, in one JSON text; a price that is no number is null."""
    n = F.col("n_nationkey").cast("decimal(10,0)")
    dollars = lambda micro: (n * F.lit(micro) / 1_000_000).cast("decimal(20,9)").cast("string")
    pricing = F.struct(dollars(1).alias("prompt"), F.when(F.col("n_nationkey") % 5 == 0, "n/a").otherwise(dollars(2)).alias("completion"))
    one = F.struct("n_nationkey", F.concat(F.lit("Maker/"), "n_name").alias("id"), pricing.alias("pricing"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["id"].alias("id"), x["pricing"].alias("pricing")))
    feed = raw(spark, d, "nation").agg(F.to_json(F.struct(listed.alias("data"))).alias("value"))
    nano = lambda c: (F.col(c) * 1_000_000_000).cast("int").alias(f"{c}_nano")
    return price_list(feed).select("pos", "model", nano("prompt"), nano("completion"))


@query("src15_rates", "SELECT lang, CASE lang WHEN 'en' THEN 1.0::double ELSE 0.92::double END AS rate FROM documents GROUP BY lang")
def src15(spark, d):
    rates = F.create_map(*(F.lit(x) for pair in T.RATES.items() for x in pair))
    return raw(spark, d, "documents").select("lang").distinct().select("lang", rates[T.currency_of("lang")].alias("rate"))


@query("snk1_insert", "SELECT doc_uuid, title, publisher FROM docs UNION ALL SELECT cast(item_id + 5000000 as string), left(text, 10), NULL FROM benchmark")
def snk1(spark, d):
    docs = model(spark, d, "docs").select("doc_uuid", "title", "publisher")
    new = raw(spark, d, "benchmark").select((F.col("item_id") + 5000000).cast("string").alias("doc_uuid"), F.left("text", F.lit(10)).alias("title"), F.lit("dropped").alias("malicious_key"))
    return changes.inserted(docs, new)


@query("snk10_clear_memories", "SELECT user_id, count(*) AS n FROM memories WHERE user_id <> 'u1' GROUP BY user_id")
def snk10(spark, d):
    rows = model(spark, d, "memories")
    left = changes.without(rows, spark.createDataFrame([("u1",)], "user_id string"), "user_id")
    return left.groupBy("user_id").agg(F.count("*").alias("n"))


@query("snk13_training_lines", "SELECT doc_uuid, least(count(*), 3) AS n FROM (WITH {0} SELECT doc_uuid FROM chunks) GROUP BY doc_uuid".format(_CHUNKS))
def snk13(spark, d):
    pairs = exports.training_pairs(chunk_table(spark, d), model(spark, d, "docs"), each=3, most=None)
    lines = pairs.select(F.to_json(F.struct("prompt", "completion", "messages", "metadata")).alias("line"))
    return lines.groupBy(F.get_json_object("line", "$.metadata.doc_uuid").alias("doc_uuid")).agg(F.count("*").alias("n"))


@query("snk18_r10_cache_rows", f"SELECT item_id, sha256(text) AS id, {NOW} + 604800 AS expires_s FROM benchmark")
def snk18(spark, d):
    expires = F.timestamp_seconds(F.lit(NOW)) + F.expr("interval 7 days")
    return raw(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("id"), F.unix_timestamp(expires).cast("int").alias("expires_s"))


@query("ag10_ag11_budget_by_owner", "SELECT o AS owner, cast(s as bigint) AS spent_micro, s >= 200000 AS exceeded, cast(least(100, floor(s * 100.0 / 200000)) as int) AS percent FROM (SELECT coalesce(uploaded_by_id, 'system') AS o, sum(cost_micro) AS s FROM docs GROUP BY 1)")
def ag10(spark, d):
    by = model(spark, d, "docs").groupBy(F.coalesce("uploaded_by_id", F.lit("system")).alias("owner")).agg(F.sum("cost_micro").alias("spent_micro"))
    return by.select("owner", "spent_micro", (F.col("spent_micro") >= 200000).alias("exceeded"), F.least(F.lit(100), F.expr("cast(spent_micro * 100 div 200000 as int)")).alias("percent"))


@query("t17_spaced", "SELECT doc_uuid, replace(original_filename, '_', ' ') AS name FROM docs")
def t17(spark, d):
    return model(spark, d, "docs").select("doc_uuid", T.spaced("original_filename").alias("name"))


@query("t27_router_cost", "SELECT doc_uuid, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE cast(input_tokens * 500 + output_tokens * 1500 as bigint) END AS nano FROM docs")
def t27(spark, d):
    name = F.when(F.col("doc_id") % 3 == 0, "maker/model:Free").otherwise("maker/model")
    cost = T.router_cost(name, F.col("input_tokens") * 1000, F.col("output_tokens") * 1000)
    return model(spark, d, "docs").select("doc_uuid", (cost * 1000000).cast("long").alias("nano"))


@query("t28_recost", "SELECT doc_uuid, CASE WHEN cost_micro > 0 AND status = 'COMPLETED' THEN cast(input_tokens * 300 + output_tokens * 2500 as bigint) ELSE cost_micro * 1000 END AS nano FROM docs")
def t28(spark, d):
    again = F.col("input_tokens") * 300 + F.col("output_tokens") * 2500
    return model(spark, d, "docs").select("doc_uuid", F.when((F.col("cost_micro") > 0) & (F.col("status") == "COMPLETED"), again).otherwise(F.col("cost_micro") * 1000).alias("nano"))


@query("t29_timestamps", f"SELECT doc_uuid, CASE WHEN doc_id % 4 = 0 THEN {NOW} ELSE created_s END AS at_s FROM docs")
def t29(spark, d):
    written = F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    given = F.when(F.col("doc_id") % 4 == 0, "not a date").otherwise(written)
    return model(spark, d, "docs").select("doc_uuid", F.unix_timestamp(T.timestamp_or(given, F.timestamp_seconds(F.lit(NOW)))).alias("at_s"))


@query("p1_p2_next_status", "SELECT doc_uuid, CASE WHEN status IN ('COMPLETED', 'FAILED') THEN status WHEN doc_id % 7 = 0 OR (doc_id % 11 = 0 AND status IN ('PENDING', 'EXTRACTING')) THEN 'FAILED' WHEN status = 'PENDING' THEN 'EXTRACTING' WHEN status = 'EXTRACTING' THEN 'REFINING' WHEN status = 'REFINING' THEN 'EMBEDDING' ELSE 'COMPLETED' END AS next FROM docs")
def p1(spark, d):
    docs = model(spark, d, "docs")
    return docs.select("doc_uuid", changes.advanced(F.col("status"), F.col("doc_id") % 7 == 0, F.col("doc_id") % 11 == 0).alias("next"))


@query(
    "p7_ingest_decisions",
    """WITH known AS (SELECT * FROM docs WHERE doc_id % 2 = 0), found AS (SELECT doc_id, file_hash, CASE WHEN doc_id % 3 = 0 THEN original_filename ELSE 'other.txt' END AS name FROM docs)
    SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM known k WHERE k.file_hash = f.file_hash AND k.original_filename = f.name) THEN 'skip'
      WHEN EXISTS (SELECT 1 FROM known k WHERE k.file_hash = f.file_hash AND k.status = 'COMPLETED') THEN 'clone' ELSE 'pending' END AS decision FROM found f""",
)
def p7(spark, d):
    docs = model(spark, d, "docs")
    found = docs.select("doc_id", "file_hash", F.when(F.col("doc_id") % 3 == 0, F.col("original_filename")).otherwise("other.txt").alias("original_filename"))
    return changes.ingest_decisions(found, docs.filter("doc_id % 2 = 0")).select("doc_id", "decision")


@query("p17_distilled_memories", "SELECT conv_id, turn, rtrim(trim(memory_text), '.') AS memory FROM memories WHERE role = 'user' AND lower(memory_text) LIKE '%the%'")
def p17(spark, d):
    rows = model(spark, d, "memories").filter((F.col("role") == "user") & T.any_term("memory_text", ["the"]))
    return rows.select("conv_id", "turn", F.rtrim(F.trim("memory_text"), F.lit(".")).alias("memory"))


@query("p18_delete_with_files", "SELECT doc_uuid, doc_id = last AND refs = going AS delete_file FROM (SELECT *, count(*) OVER w AS refs, count(*) FILTER (WHERE uploaded_by_id = 'u2') OVER w AS going, max(CASE WHEN uploaded_by_id = 'u2' THEN doc_id END) OVER w AS last FROM docs WINDOW w AS (PARTITION BY file_hash)) WHERE uploaded_by_id = 'u2'")
def p18(spark, d):
    gone = F.coalesce(F.col("uploaded_by_id") == "u2", F.lit(False))
    return changes.last_of_hash(model(spark, d, "docs"), gone).select("doc_uuid", "delete_file")


@query("m5_cheapest_model", "SELECT p_brand AS brand, arg_min(p_partkey, {'p': p_retailprice, 'k': p_partkey}) AS model FROM part GROUP BY p_brand")
def m5(spark, d):
    """Parts as models of makers: of each maker the cheapest, the first of equals; prices that are none do not count."""
    priced = raw(spark, d, "part").withColumn("price", F.col("p_retailprice").cast("string").try_cast("decimal(20,12)")).filter("price is not null")
    return priced.groupBy(F.col("p_brand").alias("brand")).agg(F.min_by("p_partkey", F.struct("price", "p_partkey")).alias("model"))


@query("ag8_flush_before_delete", "SELECT cast(sum(cost_micro) as bigint) AS cost_micro FROM docs")
def ag8_flush(spark, d):
    """What deleted documents cost stays in the ledger: booked plus live sums to all."""
    docs = model(spark, d, "docs")
    booked = spend.by_month(docs.filter("doc_id % 4 = 0")).agg(F.sum("cost_micro").alias("b"))
    live = docs.filter("doc_id % 4 <> 0").agg(F.sum("cost_micro").alias("l"))
    return booked.crossJoin(F.broadcast(live)).select((F.col("b") + F.col("l")).alias("cost_micro"))


_ASKED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'google/gemini-2.5-flash' WHEN 2 THEN 'openrouter/free' ELSE 'other/model' END AS selected_model,
    CASE event_id % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'USD' WHEN 2 THEN 'SAR' WHEN 3 THEN 'IDR' ELSE 'EUR' END AS currency,
    CASE event_id % 7 WHEN 0 THEN '-1' WHEN 1 THEN 'ten' ELSE cast(event_id % 100 as string) END AS monthly_budget_usd FROM {0}"""
_PROBLEM = "CASE WHEN selected_model = 'other/model' THEN 'model' WHEN currency = 'EUR' THEN 'currency' WHEN monthly_budget_usd IN ('-1', 'ten') THEN 'budget' END"


@query("snk16_settings", f"WITH asked AS ({_ASKED.format('audit')}) SELECT event_id, {_PROBLEM} AS problem, event_id = (SELECT max(event_id) FROM asked WHERE {_PROBLEM} IS NULL) AS stands FROM asked")
def snk16(spark, d):
    """Each audit event as a request: why it is refused, and which one stands in the end."""
    asked = spark.sql(_ASKED.format("{a}"), a=model(spark, d, "audit"))
    problem = upkeep.settings_problem(F.col("selected_model"), F.col("currency"), F.col("monthly_budget_usd"))
    rows = asked.withColumn("problem", problem)
    keyed = asked.withColumn("openrouter_api_key", F.col("event_id").cast("string"))
    stored = spark.createDataFrame([("auto", "auto", "10", "")], "selected_model string, currency string, monthly_budget_usd string, openrouter_api_key string")
    last = upkeep.saved_settings(stored, keyed, "event_id").select(F.col("openrouter_api_key").cast("long").alias("last_id"))
    return rows.join(F.broadcast(last)).select("event_id", "problem", (F.col("event_id") == F.col("last_id")).alias("stands"))


@query("r11_invalidation", "SELECT doc_uuid, 'kept' AS entry FROM docs WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_uuid, 'all kept' FROM docs")
def r11(spark, d):
    """Search cache entries go once a document is completed, and stay while documents only wait."""
    docs = model(spark, d, "docs")
    entries = docs.select("doc_uuid", F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit(upkeep.CACHE_PREFIX)).otherwise("other:"), "doc_uuid").alias("cache_key"))
    states = docs.select("status", F.lit(False).alias("deleted"))
    gone, _ = upkeep.invalidated(entries, entries, states)
    waiting, _ = upkeep.invalidated(entries, entries, states.filter("status = 'PENDING'"))
    return gone.select("doc_uuid", F.lit("kept").alias("entry")).unionByName(waiting.select("doc_uuid", F.lit("all kept").alias("entry")))


@query("m1_m4_cascade", "SELECT doc_uuid, CASE length(raw_markdown) % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' END AS answer, length(raw_markdown) % 3 = 2 AS failed FROM docs")
def m1(spark, d):
    """Three models by turns: one is retired for some texts, the next is over its limit once, none takes the rest."""

    def provider(texts):
        busy = set()

        def small(text):
            if len(text) % 3:
                raise ValueError("404 model not found")
            return "small"

        def large(text):
            if len(text) % 3 == 2:
                raise ValueError("broken")
            if text not in busy:
                busy.add(text)
                raise ValueError("429: retry in 0.5s")
            return "large"

        return upkeep.cascade({"small": small, "large": large}, sleep=lambda _: None)(texts)

    answers = ingest.generated(model(spark, d, "docs").select("doc_uuid", F.col("raw_markdown").alias("content")), provider)
    return answers.select("doc_uuid", F.when(~F.col("failed"), F.col("answer")).alias("answer"), "failed")


@query(
    "p5_reembed",
    f"""WITH {_CHUNKS} SELECT chunks.doc_uuid, count(*) AS n, sum(length(content) + CASE WHEN chunks.doc_id % 50 = 0 THEN 0 ELSE 1 END) AS chars FROM chunks GROUP BY chunks.doc_uuid""",
)
def p5(spark, d):
    """Every fiftieth document was edited (its stored chunks had a letter more): only its chunks are made anew."""
    docs = model(spark, d, "docs")
    stored = ingest.embedded(ingest.chunked(docs).withColumn("content", F.concat("content", F.lit("+"))))
    wide = docs.withColumn("expires_at", F.timestamp_seconds("expires_s"))
    _, rows = ingest.reembedded(wide, stored, docs.filter("doc_id % 50 = 0"), F.timestamp_seconds(F.lit(NOW)))
    return rows.groupBy("doc_uuid").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("snk17_stale_files", "SELECT doc_uuid FROM docs WHERE doc_id % 4 < 2 AND 1706745600 - created_s > 86400")
def snk17(spark, d):
    """Documents as listed files: temporary names that are older than a day."""
    names = F.when(F.col("doc_id") % 4 == 0, "tmp_").when(F.col("doc_id") % 4 == 1, "pdf_export_").otherwise("report_")
    listed = model(spark, d, "docs").select("doc_uuid", F.concat(F.lit("file:/srv/"), names, "doc_uuid").alias("path"), F.timestamp_seconds("created_s").alias("modificationTime"))
    return upkeep.stale_files(listed, F.timestamp_seconds(F.lit(NOW))).select("doc_uuid")
