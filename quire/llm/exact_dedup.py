"""Exact dedup by a heavy-hitter split.

Digests of all texts are written once, without the texts. Misra-Gries counters
(``DataFrame.freqItems``) name the few digests that can make up more than a share
``support`` of the rows; their exact sizes and winners are counted with map-side
aggregation and broadcast (at most ``1 / support`` rows), so rows of hot groups are decided
where they are read. All other digests take an ordinary shuffle, in which no group exceeds
that share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import names_apart, table, text_of

#: White space that does not count: space and U+0009 to U+000D.
BLANK = "[\\x20\\x09-\\x0D]+"


def _digest(text):
    return F.sha2(F.regexp_replace(text_of(text), BLANK, ""), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.002) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``n_points``.

    Texts are equal when they are after white space is deleted; null counts as empty. Of equal
    texts the one with the most code points stays, then the smallest id (null ids last), and of
    rows equal in both exactly one. An empty table gives no rows; columns beyond the two are not read.
    """
    rows = table(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(text_of(text_col)).cast("long").alias("points"),
            _digest(text_col).alias("digest"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    best = F.min(F.struct((-F.col("points")).alias("shorter"), F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = lambda some: some.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    # freqItems gives at most 1 / support digests: collecting and broadcasting them is bounded
    names = [r[0] for r in frequent.collect()]
    heavy = rows.sparkSession.createDataFrame([(n,) for n in names], "digest string")
    winners = groups(rows.join(F.broadcast(heavy), "digest", "left_semi"))
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    both = hot.unionByName(rest.join(groups(rest), "digest"))
    return both.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        F.col("points").alias("n_points"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that agree in id and text, one stays: the least by its JSON form, so that columns of any
    type, maps too, can be there. Null texts count as empty, null ids are ids of their own; an empty
    table gives no rows; names that clash with those used here are left alone.
    """
    digest, points, drop, again = names_apart(docs, "digest", "points", "drop", "again")
    marks = table(
        exact_dedup(docs, id_col, text_col)
        .groupBy(F.col(id_col).alias("key_id"), F.col("text_sha256").alias("key_digest"), F.col("n_points").alias("key_points"))
        .agg((~F.max("kept")).alias(drop), (F.count("*") > 1).alias(again))
        .filter(F.col(drop) | F.col(again)),
        "marks",
    )
    keyed = docs.withColumns({digest: _digest(text_col), points: F.length(text_of(text_col)).cast("long")})

    def on(some: DataFrame):
        return keyed[id_col].eqNullSafe(some["key_id"]) & (keyed[digest] == some["key_digest"]) & (keyed[points] == some["key_points"])

    single = keyed.join(marks, on(marks), "left_anti").select(*docs.columns)
    repeated = marks.filter(~F.col(drop))
    if repeated.isEmpty():
        return single
    # a minimum over whole rows combines before the shuffle
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = keyed.join(repeated, on(repeated), "left_semi").groupBy(id_col, digest, points).agg(F.min_by(row, F.to_json(row)).alias(again))
    return single.unionByName(first.select(f"{again}.*"))
