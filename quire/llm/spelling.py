"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters have one key,
and one letter more, less or exchanged changes it by that letter's value or by a difference of two.
Keys are joined by these values without trying all of them: each key less the value of each of its
letters (a *stem*) is listed once. A stem that is itself a key is a letter removed (or, seen from
there, added); two keys with a common stem differ by the exchange of one letter. A stem has at most as
many keys as there are letters, so no group grows with the corpus.

Keys say nothing of order. Only letters whose stem met another key are taken out of the words at their
places, and what is left must agree in order: with the other word, or, for exchanges, with what is
left of the other word at the same place. Words that agree in stem, place and rest differ pairwise in
that place alone, at most one a letter, so they are counted without writing pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table, text_of

#: Letters of a run; only A-Z are lowered.
LETTERS = r"A-Za-zÀ-ÿ"
#: Code points and occurrences of a word at least, and how much more often its form occurs.
LEAST, OCCURRENCES, TIMES = 6, 5, 5
#: One in so many runs, by its hash, stands for a misspelt one and loses a letter.
SPOILED = 199
#: Exponent of a letter's value.
POWER = 5


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, spoiled: int = SPOILED) -> DataFrame:
    """``word`` of each run of letters in the whole texts that has ``least`` code points or more, lowered, every ``spoiled``-th without a letter.

    A null text has no runs; a null id counts as an empty one in the hash.
    """
    found = F.explode(F.regexp_extract_all(text_of(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), found.alias("run"))
    rows = rows.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % spoiled == 0, cut).otherwise(F.col("run")).alias("word"))


def value_of(letter: Column) -> Column:
    """A letter's value: its rank among a-z and what follows U+00C0, to the fifth power."""
    point = F.ascii(letter).cast("long")
    rank = F.when(point < 128, point - 96).otherwise(point - 165)
    product = rank
    for _ in range(POWER - 1):
        product = product * rank
    return product


def key_of(word: Column) -> Column:
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda s, c: s + value_of(c))


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """Of distinct words with occurrences ``n``: ``word, form, root, n, n_near, form_n``.

    Near words differ by exactly one code point inserted, deleted or replaced. The form is the near
    word that occurs most (of equals the first in code-point order), if at least ``times`` times as
    often, else null; the root is where forms lead to. Words have letters of LETTERS in lower case.
    """
    words = table(words.select("word", "n", key_of(F.col("word")).alias("key")), "words")
    letters = words.select("key", F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).distinct()
    stems = letters.select("key", "letter", (F.col("key") - value_of(F.col("letter"))).alias("stem"))
    # a stem's keys differ by a letter's value each, so there are at most as many as letters
    shared = stems.groupBy("stem").agg((F.count_distinct("key") > 1).alias("exchanged"))
    keys = words.select(F.col("key").alias("stem")).distinct().withColumn("found", F.lit(True))
    met = shared.join(keys, "stem", "left").withColumn("removed", F.coalesce("found", F.lit(False))).drop("found").filter("exchanged or removed")
    met = table(stems.join(met, "stem"), "met")

    place = words.select("word", "n", "key", F.posexplode(F.split("word", "")).alias("place", "letter"))
    rest = F.concat(F.col("word").substr(F.lit(1), F.col("place")), F.col("word").substr(F.col("place") + 2, F.length("word")))
    before = F.when(F.col("place") > 0, F.col("word").substr(F.col("place"), F.lit(1)))
    left = table(place.join(met, ["key", "letter"]).withColumns({"rest": rest, "first": ~F.col("letter").eqNullSafe(before)}), "left")

    # the order of what is left: equal rests at one place are words that differ there alone
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word")))  # at most one a letter
    groups = left.filter("exchanged").groupBy("stem", "place", "rest").agg(ranked.alias("all")).filter(F.size("all") > 1)
    each = groups.select("all", F.explode("all").alias("one"))
    other = F.when(F.col("all")[0]["word"] == F.col("one.word"), F.col("all")[1]).otherwise(F.col("all")[0])
    exchanged = each.select(F.col("one.word").alias("word"), (F.size("all") - 1).cast("long").alias("near"), other.alias("best"))

    # of a letter that is repeated in a row only the first is taken out, so that a pair comes once
    shorter = words.select(F.col("key").alias("stem"), F.col("word").alias("rest"), F.col("n").alias("rest_n"))
    cut = table(left.filter("removed and first").select("stem", "word", "n", "rest").join(shorter, ["stem", "rest"]), "cut")
    one = F.lit(1).cast("long").alias("near")
    best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("word")).alias("best")
    removed = cut.select("word", one, best("rest_n", "rest")).union(cut.select(F.col("rest").alias("word"), one, best("n", "word")))

    near = exchanged.unionByName(removed).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    enough = -F.col("best.less") >= times * F.col("n")
    told = words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    told = table(told, "told")
    return told.join(roots(told), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where ``form`` leads to from each word, by pointers that double their reach in each round.

    A word has a bounded number of near words, so no pointer's target is hot; a form occurs ``times``
    as often as its word, so rounds are few whatever the corpus.
    """
    reached = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = table(reached.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        reached = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, occurrences: int = OCCURRENCES, times: int = TIMES, spoiled: int = SPOILED) -> DataFrame:
    """``variants`` of the words of all texts that have ``least`` code points and ``occurrences`` or more.

    Repeated rows count again. Null and empty texts, and tables without words, give no rows; further
    columns are not read. Occurrences are counted in the tasks before any word is shuffled.
    """
    counted = runs(docs, id_col, text_col, least, spoiled).filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return variants(counted.filter(F.col("n") >= occurrences), times)


def with_forms(docs: DataFrame, found: DataFrame, text_col: str = "text", as_col: str = "normalised") -> DataFrame:
    """``docs`` with each text's variants replaced by their roots (lower-cased), other characters as they are, as ``as_col``.

    Only words with a root of their own are looked up: counted few, they are a map in every task; else
    the texts' words meet them by a shuffle and are put together again. Null texts stay null.
    """
    known = table(found.filter("form is not null").select("word", "root"), "known")
    if known.count() > 200_000:
        return _put_together(docs, known, text_col, as_col)
    roots_of = {r["word"]: r["root"] for r in known.collect()}

    @F.pandas_udf("string")
    def replaced(texts):
        import re

        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        run = re.compile(f"[{LETTERS}]+")
        return texts.map(lambda t: t if t is None else run.sub(lambda m: roots_of.get(m[0].translate(lower), m[0]), t))

    return docs.withColumn(as_col, replaced(F.col(text_col).cast("string")))


def _put_together(docs: DataFrame, known: DataFrame, text_col: str, as_col: str) -> DataFrame:
    rows = table(docs.withColumn("_row_of_text", F.monotonically_increasing_id()), "rows")
    # a text as pieces: runs of letters and what lies between, each with its place
    pieces = rows.select("_row_of_text", F.posexplode(F.regexp_extract_all(text_of(text_col), F.lit(f"[{LETTERS}]+|[^{LETTERS}]+"), F.lit(0))).alias("place", "piece"))
    lower = F.translate("piece", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = pieces.withColumn("word", lower).join(known, "word", "left").select("_row_of_text", F.struct("place", F.coalesce("root", "piece").alias("piece")).alias("at"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["piece"]), "")
    whole = told.groupBy("_row_of_text").agg(text.alias(as_col))
    joined = rows.join(whole, "_row_of_text", "left")
    return joined.withColumn(as_col, F.when(F.col(text_col).isNotNull(), F.coalesce(as_col, F.lit("")))).drop("_row_of_text")
