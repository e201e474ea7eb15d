"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import shared_folder
from quire.llm.decontam import contaminated
from quire.llm.exact_dedup import exact_dedup
from quire.llm.license_scan import scan_licenses
from quire.llm.mixing import SEED, mix
from quire.llm.ngram_join import ngram_join
from quire.llm.packing import cut_pieces, pack
from quire.llm.spelling import LETTERS, spelling_variants
from quire.llm.suffix_dedup import repeated_passages
from quire.llm.token_counts import length_histogram
from quire.llm.token_store import read_store, write_store
from quire.llm.tokens import word_bpe
from quire.llm.toxicity import THRESHOLD, fit, held_out, labelled, scored
from quire.llm.url_filter import LIMIT, RULES, Vocabulary, filter_urls
from quire.llm.vector_codes import books_digest, compress, with_label_errors


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents")).drop("spans")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "url_verdict.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    labels = _read(spark, sf_dir, "labels")
    model = fit(labelled(docs, labels))
    rows = scored(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = cut_pieces(_read(spark, sf_dir, "documents"), word_bpe())
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_read(spark, sf_dir, "documents"), word_bpe())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}/store"
    write_store(_read(spark, sf_dir, "documents"), folder, word_bpe())
    return read_store(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_read(spark, sf_dir, "documents")).drop("digest")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(_read(spark, sf_dir, "embeddings"))
    rows = with_label_errors(codes)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows, plan = mix(docs)
    told = [(p, plan.sizes[s], plan.targets[s]) for p, flows in plan.flow.items() for s in flows]  # one source a pattern here
    asked = spark.createDataFrame(told, "pattern string, source_size long, target double")
    return rows.join(F.broadcast(asked), "pattern").select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


_BLANK = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"


def _terms(words, weights: dict[tuple[str, ...], float] | None = None) -> str:
    one = "regexp_matches(lower(coalesce(url, '')), '(^|[^\\p{{L}}\\p{{N}}])({0})($|[^\\p{{L}}\\p{{N}}])')::bigint"
    return " + ".join(one.format("|".join(w)) + (f" * {weights[w]}::double" if weights else "") for w in sorted(words))


def _rules(what: int) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    value = lambda r: r[0] if what else r[1] + r[2]
    return "CASE " + " ".join(f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}') THEN '{value((v, d, p))}'" for v, d, p in longest) + " END"


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: The hash of ``<doc_id>:<run>``, byte by byte; letters beyond ASCII are two bytes, the first of them 0xC3.
_CRC = f"""xor(list_reduce(flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::bigint] ELSE [195, unicode(ch)::bigint - 64] END)),
    lambda c, b: xor(c >> 8, {[_crc_step(n) for n in range(256)]}[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"""


def _lloyd(rounds: int) -> str:
    """Full scans in integers: assignments ``a0`` .. over codebooks ``b0`` ..."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(q.x) AS x, min(list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 256 + b.e) AS best
            FROM q JOIN b{r} b USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            out.append(f"""m{r} AS MATERIALIZED (SELECT p, (best % 256)::int AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM q) + 1)) AS i) GROUP BY ALL),
            n{r} AS MATERIALIZED (SELECT p, e, list(((s - (s % n + n) % n) // n)::bigint ORDER BY i) AS x FROM m{r} GROUP BY p, e),
            b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n{r}.x, b{r}.x) AS x FROM b{r} LEFT JOIN n{r} USING (p, e))""")
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    terms = Vocabulary.read()
    return {
        "op1_exact_dedup": f"""
            WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n_points, sha256({_BLANK}) AS text_sha256 FROM documents)
            SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   row_number() OVER w = 1 AS kept, text_sha256, n_points
            FROM rows WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)""",
        "op3_url_filter": f"""
            WITH cut AS (SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, url,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            hits AS (SELECT page_id, host, path, {_rules(0)} AS rule, {_rules(1)} AS told,
                {_terms((w,) for w in terms.strict)} AS strict_hits, {_terms(terms.families())} AS soft_hits, {_terms(terms.families(), terms.families())} AS soft_weight FROM parts)
            SELECT page_id, host, path, rule,
                coalesce(told, CASE WHEN strict_hits >= 1 OR soft_hits >= 2 AND soft_weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
                strict_hits, soft_hits, soft_weight FROM hits""",
        "op11_spelling_variants": f"""
            WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
            counted AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
            hashed AS MATERIALIZED (SELECT run, n, {_CRC} AS h FROM counted),
            spoiled AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, n FROM hashed),
            words AS MATERIALIZED (SELECT word, sum(n)::bigint AS n FROM spoiled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
            places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
            cuts AS MATERIALIZED (SELECT word, n, i, left(word, i::int) || substr(word, i::int + 2) AS rest FROM places),
            pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                UNION SELECT cuts.word, words.word, words.n FROM cuts JOIN words ON rest = words.word UNION SELECT words.word, cuts.word, cuts.n FROM cuts JOIN words ON rest = words.word),
            best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
            told AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
            chain AS (SELECT word, word AS root FROM told UNION ALL SELECT chain.word, told.form FROM chain JOIN told ON chain.root = told.word WHERE told.form IS NOT NULL)
            SELECT told.word, form, chain.root, n, n_near, form_n FROM told JOIN chain ON told.word = chain.word WHERE chain.root IN (SELECT word FROM told WHERE form IS NULL)""",
        "op12_vector_codes": f"""
            WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            q AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * (len(v) // 16) + 1, (p + 1) * (len(v) // 16)) AS x FROM kept, (SELECT unnest(range(16)) AS p)),
            b0 AS MATERIALIZED (SELECT p, (dense_rank() OVER (ORDER BY vec_id) - 1)::int AS e, x FROM q WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
            {_lloyd(2)},
            told AS (SELECT vec_id, string_agg(printf('%02x', (best % 256)::int), '' ORDER BY p) AS code, sum(best // 256)::bigint AS error FROM a2 GROUP BY vec_id)
            SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
                (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM told JOIN kept USING (vec_id)""",
        "op13_source_mixing": rf"""
            WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('{SEED}:' || coalesce(doc_id::varchar, '')) AS turn FROM documents),
            s AS (SELECT source, sum(size)::bigint AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
            r AS (SELECT *, row_number() OVER o AS k, coalesce(sum(2 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_n, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
                1.5::double * sum(n) OVER () AS budget FROM s WINDOW o AS (ORDER BY 2 * n / w, source NULLS LAST)),
            c AS (SELECT k AS least, full_n AS full_all, open_w AS open_all FROM r WHERE w * (budget - full_n) <= 2 * n * open_w ORDER BY k LIMIT 1),
            t AS (SELECT source, n, CASE WHEN k < least THEN (2 * n)::double ELSE w * (budget - full_all) / open_all END AS target FROM r, c),
            f AS (SELECT *, floor(target + 0.5)::bigint AS quota FROM t),
            g AS (SELECT doc_id, size, n, target, quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
            SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE (quota // n * size + least(size, greatest(quota % n - before, 0)))::bigint END AS taken FROM g""",
    }
