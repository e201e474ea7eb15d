"""Files as tables: a recursive scan, and parsers of their bytes to Markdown.

Plain text, page counts and routing are built-in expressions; ragged CSV, JSON of any shape and
workbooks are parsed per file in Arrow batches.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
INGESTED = ["pdf", "jpg", "jpeg", "png", "csv", "txt"]
EMPTY_CSV, EMPTY_BOOK = "*Empty CSV Document*", "*Empty or Unreadable Excel Document*"


def files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of all files below a folder with one of the extensions."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return df.filter(F.lower("path").rlike(rf"\.({'|'.join(extensions or INGESTED)})$"))


def decoded(content: str | Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    text = c.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(c, "ISO-8859-1"))


def page_count(path: Column, content: Column) -> Column:
    """Pages of a PDF by its page objects, else by the count of its page tree, else 1; 1 for other files."""
    raw = F.decode(content, "ISO-8859-1")
    pages = F.regexp_count(raw, F.lit(r"/Type\s*/Page\b"))
    told = F.coalesce(
        F.nullif(F.regexp_extract(raw, r"(?s)/Type\s*/Pages.{0,200}?/Count\s+(\d+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(raw, r"(?s)/Count\s+(\d+).{0,200}?/Type\s*/Pages", 1), F.lit("")),
    ).cast("int")
    return F.when(~F.lower(path).endswith(".pdf"), 1).otherwise(F.when(pages > 0, pages).otherwise(F.coalesce(told, F.lit(1))))


def _cell(value: str, breaks: bool) -> str:
    value = value.replace("|", "\\|")
    return value.replace("\r\n", "<br>").replace("\n", "<br>") if breaks else value


def markdown_table(header: list[str], rows: list[list[str]]) -> str:
    """A Markdown table; rows are padded or cut to the header."""
    lines = ["| " + " | ".join(_cell(h, False) for h in header) + " |", "| " + " | ".join("---" for _ in header) + " |"]
    for row in rows:
        fitted = [*row, *[""] * len(header)][: len(header)]
        lines.append("| " + " | ".join(_cell(v, True) for v in fitted) + " |")
    return "\n".join(lines)


def _text(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def csv_markdown(content: bytes) -> str:
    csv.field_size_limit(2**31 - 1)  # a cell can hold a whole text; the reader's own limit is 131072 characters
    rows = list(csv.reader(io.StringIO(_text(content), newline="")))
    return markdown_table(rows[0], rows[1:]) if rows and rows[0] else EMPTY_CSV


def _records(items: list[dict]) -> str:
    keys = list(dict.fromkeys(k for item in items for k in item))
    return markdown_table(keys, [[str(item.get(k, "")).strip() for k in keys] for item in items])


def json_markdown(content: bytes) -> str:
    """Lists of records as a table, other lists as bullets, objects as sections."""
    try:
        data = json.loads(_text(content))
    except ValueError:
        return "*Unreadable JSON Document*"
    shown = lambda x: json.dumps(x, ensure_ascii=False)
    if isinstance(data, list):
        if not data:
            return "*Empty JSON Document*"
        if all(isinstance(x, dict) for x in data):
            return "## Dataset\n\n" + _records(data)
        return "\n\n".join(f"- {shown(x)}" for x in data)
    if not isinstance(data, dict):
        return shown(data)
    parts = []
    for key, value in data.items():
        if isinstance(value, list) and value and all(isinstance(x, dict) for x in value):
            body = _records(value)
        elif isinstance(value, (list, dict)):
            body = f"```json\n{json.dumps(value, ensure_ascii=False, indent=2)}\n```"
        else:
            body = str(value).strip()
        parts.append(f"## {str(key).replace('_', ' ').title()}\n\n{body}")
    return "\n\n".join(parts) or "*Empty JSON Document*"


def workbook_markdown(content: bytes) -> str:
    """A table per sheet of an XLSX file, blank rows left out."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    try:
        book = zipfile.ZipFile(io.BytesIO(content))
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{{{space['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", space)]
        titles = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{space['m']}}}sheet")]
        parts = []
        sheets = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        for title, name in zip(titles, sheets, strict=False):
            rows = []
            for row in ElementTree.fromstring(book.read(name)).iter(f"{{{space['m']}}}row"):
                values: dict[int, str] = {}
                for n, cell in enumerate(row.findall("m:c", space)):
                    letters = "".join(x for x in cell.get("r", "") if x.isalpha())
                    column = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else n
                    found = cell.find("m:v", space)
                    text = "".join(t.text or "" for t in cell.iter(f"{{{space['m']}}}t")) if found is None else found.text or ""
                    values[column] = shared[int(text)] if cell.get("t") == "s" and text else text
                line = [values.get(k, "") for k in range(max(values, default=-1) + 1)]
                if any(v.strip() for v in line):
                    rows.append(line)
            if rows:
                parts.append(f"## {title}\n\n{markdown_table(rows[0], rows[1:])}")
        return "\n\n".join(parts) or EMPTY_BOOK
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return EMPTY_BOOK


def _parsed(parse) -> Column:
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: parse(bytes(c)) if c is not None else None)

    return F.pandas_udf(run, "string")


def pdf_text(content: Column, provider=None) -> Column:
    """Sections ``## Page N`` with rules between, of a provider's pages (bytes -> list of texts); empty for up to 30 characters."""

    def run(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            pages = provider(bytes(c)) if provider and c is not None else []
            out.append("\n\n---\n\n".join(f"## Page {n}\n\n{p}" for n, p in enumerate(pages, 1)) if sum(len(p.strip()) for p in pages) > 30 else "")
        return pd.Series(out)

    return F.pandas_udf(run, "string")(content)


def markdown(df: DataFrame, pdf_provider=None, ocr_cache: DataFrame | None = None) -> DataFrame:
    """``raw_markdown`` and ``page_count`` of each file by its extension; each parser sees only its own files.

    What no parser reads comes from a cache of earlier readings by hash, else is null: left to a reader of images.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    rows = df.withColumns({"ext": ext, "file_hash": F.sha2("content", 256)})
    only = lambda kinds: F.when(F.col("ext").isin(kinds), F.col("content"))
    text = (
        F.when(F.col("ext") == "csv", _parsed(csv_markdown)(only(["csv"])))
        .when(F.col("ext") == "json", _parsed(json_markdown)(only(["json"])))
        .when(F.col("ext").isin("xlsx", "xls"), _parsed(workbook_markdown)(only(["xlsx", "xls"])))
        .when(F.col("ext").isin("txt", "md", "markdown"), decoded("content"))
        .when(F.col("ext") == "pdf", F.nullif(pdf_text(only(["pdf"]), pdf_provider), F.lit("")))
    )
    rows = rows.withColumn("raw_markdown", text).withColumn("page_count", page_count(F.col("path"), F.col("content")))
    if ocr_cache is not None:
        rows = rows.join(ocr_cache.select("file_hash", F.col("raw_markdown").alias("cached")), "file_hash", "left")
        rows = rows.withColumn("raw_markdown", F.coalesce("raw_markdown", "cached")).drop("cached")
    return rows.drop("content")


def price_list(snapshots: DataFrame, column: str = "value", *kept: str) -> DataFrame:
    """``pos, model, prompt, completion`` (decimals per token) of a JSON price list, ids in lower case, after the columns to keep."""
    kind = "data array<struct<id:string,pricing:struct<prompt:string,completion:string>>>"
    items = snapshots.select(*kept, F.posexplode(F.from_json(column, kind)["data"]).alias("pos", "item"))
    dec = lambda c: F.col(f"item.pricing.{c}").try_cast("decimal(20,12)").alias(c)
    return items.select(*kept, "pos", F.lower("item.id").alias("model"), dec("prompt"), dec("completion"))
