"""Who may see which rows, and lookups over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import any_term

SEARCHED = ["title", "author", "language", "document_type", "publisher", "publication_year", "doi"]


def visible(user: str | None, staff: bool = False, owner: str = "uploaded_by_id") -> Column:
    """Staff see all rows, users their own and ownerless ones, others the ownerless."""
    if staff:
        return F.lit(True)
    free = F.col(owner).isNull()
    return free if user is None else free | (F.col(owner) == user)


def scoped(docs: DataFrame, user: str | None, staff: bool = False, ids: DataFrame | None = None) -> DataFrame:
    """Visible rows, and of those only the given ids where there are any given."""
    rows = docs.filter(visible(user, staff))
    return rows if ids is None else rows.join(ids.select("doc_uuid"), "doc_uuid", "left_semi")


def may_change(user: str | None, staff: bool = False, ownerless: bool = False) -> Column:
    """Owner or staff; with ``ownerless`` also rows without owner."""
    own = F.coalesce(F.col("uploaded_by_id") == F.lit(user), F.lit(False))
    return F.lit(staff) | own | (F.col("uploaded_by_id").isNull() & F.lit(ownerless))


def matching(docs: DataFrame, text: str, columns: list[str] = SEARCHED) -> DataFrame:
    """Rows with the text, in any case, in one of the columns; all rows for no text."""
    if not text.strip():
        return docs
    return docs.filter(reduce(lambda a, b: a | b, (any_term(F.col(c).cast("string"), [text.strip().lower()]) for c in columns)))


def live(expires: str, now: Column, forever: bool = False) -> Column:
    """Not expired; with ``forever`` a row without an end lives on."""
    alive = F.col(expires) > now
    return F.coalesce(alive, F.lit(forever))


def stale(now: Column, minutes: int = 5) -> Column:
    """In work and not touched for that long."""
    working = F.col("status").isin("PENDING", "EXTRACTING", "REFINING", "EMBEDDING")
    return working & (F.col("updated_at") <= now - F.make_interval(mins=F.lit(minutes)))


def all_inside(items: str | Column, allowed: str | Column) -> Column:
    return F.size(F.array_except(items, allowed)) == 0


def ipv4(x: Column) -> Column:
    """An address as a number, null where it is none."""
    parts = F.split(F.trim(x), r"\.")
    byte = lambda n: F.get(parts, n).try_cast("bigint")
    good = F.trim(x).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & (F.greatest(*(byte(n) for n in range(4))) <= 255)
    return F.when(good, byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3))


def in_networks(addresses: str | Column, cidrs: list[str]) -> Column:
    """Whether any address of a comma-separated list lies in any network."""
    spans = []
    for cidr in cidrs:
        base, bits = cidr.split("/")
        low = sum(int(b) << 8 * (3 - i) for i, b in enumerate(base.split(".")))
        low = low >> (32 - int(bits)) << (32 - int(bits))
        spans.append((low, low + (1 << (32 - int(bits))) - 1))
    column = F.col(addresses) if isinstance(addresses, str) else addresses
    inside = lambda n: reduce(lambda a, b: a | b, (n.between(a, b) for a, b in spans))
    return F.coalesce(F.exists(F.split(F.coalesce(column, F.lit("")), ","), lambda a: F.coalesce(inside(ipv4(a)), F.lit(False))), F.lit(False))


def sorted_by(docs: DataFrame, key: str = "date", ascending: bool = False) -> DataFrame:
    """By name, cost, status or date (also for unknown keys: newest first), ties by id."""
    keys = {
        "name": F.lower(F.coalesce(F.nullif("title", F.lit("")), "original_filename", F.lit(""))),
        "cost": F.col("cost_micro"),
        "status": F.col("status"),
        "date": F.col("created_s"),
    }
    if key not in keys:
        key, ascending = "date", False
    return docs.orderBy(keys[key].asc() if ascending else keys[key].desc(), "doc_id")
