"""What the operators share: intermediate tables, column names that cannot clash, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import shared_folder, table, text_batches

__all__ = ["ascii_words", "names_apart", "parallelism", "shared_folder", "small_or_shuffled", "table", "text_batches", "text_of"]

#: ASCII to lower case, and everything ASCII that is no letter or digit to a space; bytes over 0x7F stay.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def names_apart(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores put before those that ``df`` already has in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_words(text: str | None) -> list[bytes]:
    """Words as UTF-8: runs of ASCII letters (lowered) and digits and of everything beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(big: DataFrame, small: DataFrame, on, how: str, rows: int, most: int = 300_000) -> DataFrame:
    """A join that broadcasts ``small`` only when its counted ``rows`` are few; else both sides are shuffled."""
    return big.join(F.broadcast(small) if rows <= most else small, on, how)
