"""Defaults of a document's metadata, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import known, strip

# Lengths kept, and what stands for what is not known.
LENGTHS = {"title": 255, "author": 255, "language": 100, "document_type": 100, "semantic_signature": 255, "publisher": 255, "license_type": 100, "doi": 255}
AUTHOR, LANGUAGE, TITLE = "Anonymous", "English", "Untitled"
#: In names of files with this word, authors that are none or one of these words mean this edition.
EDITION, EDITION_WORDS, EDITION_AUTHOR = "sahih", ["anonymous", "divinely"], "Sahih International"
DOI_PREFIXES = ["https://doi.org/", "http://doi.org/"]


def _kept(parsed: str | Column, name: str) -> Column:
    """The first characters of a value, null where it is none or says that it is not known."""
    value = F.left(parsed if isinstance(parsed, Column) else F.col(parsed), F.lit(LENGTHS[name]))
    return F.when(known(value).isNotNull(), value)


def title_of(parsed: str | Column, filename: str | Column) -> Column:
    """The title, else the file's name without its ending and with spaces for ``_`` and ``-``, else the whole name."""
    name = F.coalesce(filename if isinstance(filename, Column) else F.col(filename), F.lit(""))
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.coalesce(_kept(parsed, "title"), F.nullif(strip(F.translate(stem, "_-", "  ")), F.lit("")), F.nullif(name, F.lit("")), F.lit(TITLE))


def author_of(parsed: str | Column, filename: str | Column) -> Column:
    """The author, else Anonymous; files of one edition have its name for authors that are none."""
    name = F.lower(F.coalesce(filename if isinstance(filename, Column) else F.col(filename), F.lit("")))
    author = F.coalesce(_kept(parsed, "author"), F.lit(AUTHOR))
    none = F.lit(False)
    for word in EDITION_WORDS:
        none = none | F.contains(F.lower(author), F.lit(word))
    return F.when(F.contains(name, F.lit(EDITION)) & none, EDITION_AUTHOR).otherwise(author)


def language_of(parsed: str | Column) -> Column:
    return F.coalesce(_kept(parsed, "language"), F.lit(LANGUAGE))


def year_of(parsed: str | Column) -> Column:
    """The first four digits; null without them."""
    return F.nullif(F.regexp_extract(F.coalesce(known(parsed), F.lit("")), r"\d{4}", 0), F.lit(""))


def doi_of(parsed: str | Column) -> Column:
    """The identifier without its address; null where it is not known."""
    doi = known(parsed)
    for prefix in DOI_PREFIXES:
        doi = F.replace(doi, F.lit(prefix), F.lit(""))
    return F.left(strip(doi), F.lit(LENGTHS["doi"]))


def described(parsed: dict[str, Column], current: dict[str, Column], filename: Column) -> dict[str, Column]:
    """All metadata after a parse: title, author and language with their defaults, the others as parsed or, where that says nothing, as they were."""
    plain = {n: F.coalesce(_kept(parsed[n], n), current[n]) for n in ("publisher", "license_type")}
    marks = {n: F.coalesce(F.nullif(F.left(parsed[n], F.lit(LENGTHS[n])), F.lit("")), current[n]) for n in ("document_type", "semantic_signature")}
    return {
        "title": title_of(parsed["title"], filename),
        "author": author_of(parsed["author"], filename),
        "language": language_of(parsed["language"]),
        "publication_year": F.coalesce(year_of(parsed["publication_year"]), current["publication_year"]),
        "doi": F.coalesce(doi_of(parsed["doi"]), current["doi"]),
        **plain,
        **marks,
    }
