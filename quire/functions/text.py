"""Scalar functions over text, as built-in expressions that stay in generated code, but for the chunker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
WS = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Fixed values.
UNKNOWN_WORDS = ["unknown", "n/a", "none", "null", "undefined", ""]
ACTION_ALIASES = {
    "UPLOAD_FRESH": "UPLOAD",
    "PIPELINE_STARTED": "EXTRACTION_START",
    "PIPELINE_COMPLETED": "EXTRACTION_COMPLETED",
    "PIPELINE_FAILED": "EXTRACTION_FAILED",
    "DELETE_DOCUMENT": "DELETE",
    "PURGE_ALL_RECORDS": "PURGE_ALL",
}
UPLOAD_EXTENSIONS = ["pdf", "png", "jpg", "jpeg", "webp", "gif", "tiff", "heic", "heif", "csv", "txt", "md", "markdown", "json", "docx", "doc", "xlsx", "xls"]
UPLOAD_BYTES = 31_457_280
PREFERENCE = r"(?i)\b(i\s+prefer|i\s+like|please\s+use|format\s+it|always\s+use|always\s+write|can\s+you)\b"
RATE_LIMIT_TERMS = ["429", "resource_exhausted", "resourceexhausted", "rate limit", "quota", "limit exceeded", "spend cap", "budget exceeded"]
CASCADE_TERMS = ["not found", "not_found", "invalid", "deprecated", "retired", "permission", "404", "400", "429", "resource_exhausted", "rate limit", "quota"]
RETRY_SAID = r"(?i)retry in (\d+(?:\.\d*)?)s"
RETRY_FIELD = r"""(?i)['"]retryDelay['"]\s*:\s*['"](\d+(?:\.\d*)?)s?['"]"""
SENTENCE_END = r"(?<=[.!?\u061f\u061b;\u06dd\)])"
BLOCK_BREAK = r"\n[ \t]*---[ \t]*\n"
RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "IDR": 16200.0, "SAR": 3.75, "TRY": 32.0}
SYMBOLS = {"USD": "$", "IDR": "Rp ", "SAR": "SR ", "EUR": "€", "GBP": "£", "TRY": "₺"}
LOCALES = [("id", "IDR"), ("ar", "SAR"), ("de", "EUR"), ("fr", "EUR"), ("es", "EUR"), ("it", "EUR"), ("nl", "EUR"), ("pt", "EUR"), ("gb", "GBP"), ("tr", "TRY")]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), f"^{WS}+|{WS}+$", "")


def filled(x: str | Column, default: str = "") -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(_c(x), F.lit("")), F.lit(default))


def first_filled(*xs: str | Column) -> Column:
    """The first text that is neither null nor empty, else empty."""
    return F.coalesce(*(F.nullif(_c(x), F.lit("")) for x in xs), F.lit(""))


def known(x: str | Column) -> Column:
    """The stripped text, null for words that mean nothing is known."""
    text = strip(x)
    return F.when(~F.lower(text).isin(UNKNOWN_WORDS), text)


def any_term(x: str | Column, terms: list[str]) -> Column:
    """Whether the lowered text holds any of the terms; false for null."""
    text = F.lower(F.coalesce(_c(x), F.lit("")))
    return reduce(lambda a, b: a | b, (text.contains(t) for t in terms))


def is_rate_limit(message: str | Column, code: str | Column | None = None) -> Column:
    hit = any_term(message, RATE_LIMIT_TERMS)
    return hit if code is None else hit | F.coalesce(_c(code) == 429, F.lit(False))


def is_cascadable(message: str | Column) -> Column:
    return any_term(message, CASCADE_TERMS)


def is_preference(x: str | Column) -> Column:
    return F.coalesce(_c(x).rlike(PREFERENCE), F.lit(False))


def is_identifier(x: str | Column) -> Column:
    return F.coalesce(_c(x).rlike(r"^[a-zA-Z_]\w*$"), F.lit(False))


def upload_allowed(name: str | Column, size: str | Column) -> Column:
    """Known extension and at most UPLOAD_BYTES."""
    ext = F.lower(F.regexp_extract(_c(name), r"\.([^.]*)$", 1))
    return F.coalesce(ext.isin(UPLOAD_EXTENSIONS) & (_c(size) <= UPLOAD_BYTES), F.lit(False))


def action_name(x: str | Column) -> Column:
    """Canonical audit action: upper case, `-` and spaces as `_`, old names renamed."""
    name = F.translate(F.upper(strip(F.coalesce(_c(x), F.lit("")))), "- ", "__")
    aliases = F.create_map(*(F.lit(x) for pair in ACTION_ALIASES.items() for x in pair))
    return F.coalesce(aliases[name], name)


def audit_details(details: str | Column, metadata: str | Column) -> Column:
    """Details, else those inside the JSON metadata, else the metadata as it is."""
    return F.coalesce(F.nullif(_c(details), F.lit("")), F.get_json_object(_c(metadata), "$.details"), _c(metadata), F.lit(""))


def normal_language(x: str | Column, names: dict[str, str]) -> Column:
    """English name of a language by code or alias, else the text with capitals; blank is Unknown."""
    text = strip(F.coalesce(_c(x), F.lit("")))
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.when(text == "", "Unknown").otherwise(F.coalesce(table[F.lower(text)], F.initcap(text)))


def compact_number(x: str | Column) -> Column:
    """1.5M, 45.2K, 350; "0" for what is no number."""
    n = _c(x).try_cast("double")
    short = F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fK", n / 1e3))
    return F.coalesce(short.otherwise(n.cast("bigint").cast("string")), F.lit("0"))


def percent(part: str | Column, total: str | Column) -> Column:
    """Whole percent, cut off; 100 without a positive total, 0 for what is no number (null counts as 0)."""
    a, b = (F.coalesce(_c(x).cast("string"), F.lit("0")).try_cast("double") for x in (part, total))
    return F.when(a.isNull() | b.isNull(), 0).when(b <= 0, 100).otherwise((a / b * 100).cast("int"))


def csv_guard(x: str | Column) -> Column:
    """A quote before text that a spreadsheet would take as a formula."""
    return F.when(_c(x).rlike(f"^{WS}*[=+\\-@]"), F.concat(F.lit("'"), _c(x))).otherwise(_c(x))


def excerpt(x: str | Column, most: int = 500) -> Column:
    """The first ``most`` characters, marked if there are more, white space as single blanks."""
    text = F.coalesce(_c(x), F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return strip(F.regexp_replace(cut, f"{WS}+", " "))


def spaced(x: str | Column) -> Column:
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def currency_of(accept_language: str | Column, chosen: str | Column | None = None) -> Column:
    """Currency of the first locale found in the header; a chosen one wins unless it is auto or blank."""
    text = F.lower(F.coalesce(_c(accept_language), F.lit("")))
    found = F.lit("USD")
    for part, currency in reversed(LOCALES):
        found = F.when(text.contains(part), currency).otherwise(found)
    return found if chosen is None else F.coalesce(F.when(~_c(chosen).isin("auto", ""), _c(chosen)), found)


def _dollars(v: Column) -> Column:
    # format_number rounds decimals half to even
    return F.concat(F.lit("$"), F.replace(F.when((v > 0) & (v < 0.10), F.format_number(v, 4)).otherwise(F.format_number(v, 2)), F.lit(","), F.lit("")))


def money(cost_usd: str | Column, currency: str | Column, rate: str | Column) -> Column:
    """A cost in its currency with the dollars beside it."""
    usd, to = _c(cost_usd).cast("decimal(18,6)"), _c(currency)
    local = usd * _c(rate).cast("decimal(14,4)")
    symbol = F.coalesce(F.create_map(*(F.lit(x) for pair in SYMBOLS.items() for x in pair))[to], F.lit("$"))
    whole = F.format_number(F.when(local < 0, F.ceil(local)).otherwise(F.floor(local)).cast("decimal(32,0)"), 0)
    amount = F.when(to == "IDR", whole).otherwise(F.replace(F.format_number(local, 2), F.lit(","), F.lit("")))
    return F.when(to == "USD", _dollars(usd)).otherwise(F.concat(symbol, amount, F.lit(" (~"), _dollars(usd), F.lit(")")))


def model_cost(model: str | Column, tokens_in: str | Column, tokens_out: str | Column, price_in: Column | None = None, price_out: Column | None = None) -> Column:
    """Dollars: at live prices per token where known, else by the kind of model per million."""
    name = F.lower(F.coalesce(_c(model), F.lit("")))
    dec = lambda v: F.lit(v).cast("decimal(20,12)")
    fixed = lambda a, b, c: F.when(name.contains("embed"), dec(a)).when(name.contains("lite"), dec(b)).otherwise(dec(c))
    a, b = fixed("0", "0.00000025", "0.0000015"), fixed("0", "0.0000015", "0.000009")
    a, b = (a if price_in is None else F.coalesce(price_in, a)), (b if price_out is None else F.coalesce(price_out, b))
    return (_c(tokens_in).cast("decimal(18,0)") * a + _c(tokens_out).cast("decimal(18,0)") * b).cast("decimal(18,6)")


def router_cost(model: str | Column, tokens_in: str | Column, tokens_out: str | Column, price_in: Column | None = None, price_out: Column | None = None) -> Column:
    """As ``model_cost`` for routed models: free ones cost nothing."""
    dec = lambda v: F.lit(v).cast("decimal(20,12)")
    a = dec("0.0000005") if price_in is None else F.coalesce(price_in, dec("0.0000005"))
    b = dec("0.0000015") if price_out is None else F.coalesce(price_out, dec("0.0000015"))
    paid = (_c(tokens_in).cast("decimal(18,0)") * a + _c(tokens_out).cast("decimal(18,0)") * b).cast("decimal(18,6)")
    return F.when(F.lower(_c(model)).contains("free"), F.lit(0).cast("decimal(18,6)")).otherwise(paid)


def timestamp_or(x: str | Column, now: Column) -> Column:
    """ISO time (UTC without a zone), else ``now``."""
    return F.coalesce(F.try_to_timestamp(_c(x)), now)


def client_ip(forwarded: str | Column, remote: str | Column) -> Column:
    hop = F.nullif(F.trim(F.split_part(_c(forwarded), F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(hop, F.nullif(_c(remote), F.lit("")), F.lit("127.0.0.1"))


def retry_delay(x: str | Column) -> Column:
    """Seconds that an error message asks to wait, else null."""
    said = F.regexp_extract(_c(x), RETRY_SAID, 1)
    field = F.regexp_extract(_c(x), RETRY_FIELD, 1)
    return F.coalesce(F.nullif(said, F.lit("")), F.nullif(field, F.lit(""))).try_cast("double")


def slug(x: str | Column) -> Column:
    """Lower case ASCII letters, digits and underscores, with single hyphens between."""
    kept = F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(kept), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def id_list(x: str | Column) -> Column:
    """Whole numbers of a comma-separated list; blanks and other text drop out."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(F.transform(parts, lambda p: p.try_cast("bigint")), lambda n: n.isNotNull())


def log_line(method: str | Column, url: str | Column, status: str | Column, latency: str | Column) -> Column:
    path, query = F.try_parse_url(_c(url), F.lit("PATH")), F.try_parse_url(_c(url), F.lit("QUERY"))
    asked = F.concat(F.coalesce(path, F.lit("/")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.concat(F.lit("HTTP "), _c(method), F.lit(" "), asked, F.lit(" - Status: "), _c(status).cast("string"), F.lit(" - Latency: "), _c(latency).cast("string"))


def quoted_yaml(x: str | Column) -> Column:
    """Each plain ``key: value`` line with its value in double quotes."""
    value = lambda v: F.replace(F.regexp_replace(v, "^'(.*)'$", "$1"), F.lit('"'), F.lit('\\"'))

    def line(text: Column) -> Column:
        key, rest = F.regexp_extract(text, r"^(\s*[\w-]+):[ \t]+(\S.*?)\s*$", 1), F.regexp_extract(text, r"^(\s*[\w-]+):[ \t]+(\S.*?)\s*$", 2)
        plain = (key != "") & ~rest.rlike(r'^".*"$|^[\[{|>]')
        return F.when(plain, F.concat(key, F.lit(': "'), value(rest), F.lit('"'))).otherwise(text)

    return F.array_join(F.transform(F.split(_c(x), "\n"), line), "\n")


def chunk_size(language: str | Column) -> Column:
    """Characters of a chunk: 500 where the language holds "ar", else 1200."""
    return F.when(F.lower(F.coalesce(_c(language), F.lit(""))).contains("ar"), 500).otherwise(1200)


_BLOCKS = re.compile(rf"{BLOCK_BREAK}|\n(?=#{{2,3}}{WS})")
_SENTENCES = re.compile(f"{SENTENCE_END}{WS}+")


def _packed(parts: Iterable[str], most: int, glue: str, parted: Callable[[str], list[str]] | None = None) -> list[str]:
    """Parts in order, joined while they fit; a part that opens a chunk after another is counted without its glue."""
    out, held, size = [], [], 0
    for part in parts:
        if size + len(part) <= most:
            held.append(part)
            size += len(part) + len(glue)
            continue
        if held:
            out.append(glue.join(held))
        held, size = [part], len(part)
        if parted and size > most:
            out += parted(part)
            held, size = [], 0
    return [*out, glue.join(held)] if held else out


def chunk_text(text: str, most: int) -> list[str]:
    """A text in chunks: blocks at rules and headings, then paragraphs, packed up to ``most`` characters; a longer
    paragraph goes by whole sentences, of which an over-long one stays whole. Linear in the text."""
    blocks = (b.strip() for b in _BLOCKS.split(text))
    paragraphs = (p for block in blocks if block for part in block.split("\n\n") if (p := part.strip()))
    return _packed(paragraphs, most, "\n\n", lambda p: _packed(_SENTENCES.split(p), most, " "))


def chunks(x: str | Column, most: Column) -> Column:
    """``chunk_text`` of a column, in Arrow batches: folded in expressions, a chunk's arrays were copied for each paragraph."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([chunk_text(t or "", n) for t, n in zip(texts.to_pylist(), sizes.to_pylist(), strict=True)], pa.list_(pa.string()))

    return cut(_c(x).cast("string"), most.cast("int"))


def chunk_page(x: str | Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(x), r"(?i)## Page (\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def chunk_chapter(x: str | Column) -> Column:
    return strip(F.regexp_extract(_c(x), r"(?i)(?:###?|Chapter|Surah|Hadith)\s+([^\n]+)", 1))


def chunk_anchor(page: Column, chapter: Column) -> Column:
    named = F.concat(F.lit("p"), page.cast("string"), F.lit("-"), slug(F.left(chapter, F.lit(30))))
    return F.when(chapter != "", named).otherwise(F.concat(F.lit("page-"), page.cast("string")))


def word_count(x: str | Column) -> Column:
    text = strip(x)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{WS}+")))
