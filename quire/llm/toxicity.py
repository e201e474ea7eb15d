"""Toxicity by class-conditional Kneser-Ney models of words and word pairs.

One model of toxic texts and one of ordinary ones. An expression is a word after the word before it.
A word alone counts, as in Kneser-Ney smoothing, by its different contexts, the words it was seen
after; its discounted probability in a class is interpolated with counts that both classes share,
gathered from all documents: by texts that hold the word, with the discount that the counts of counts
give. A pair's discounted probability in a class is interpolated with the one that both classes share,
which is tilted by how much likelier the word alone is in that class. Class counts go by texts
too, so neither one long text nor copies make an expression frequent. Both classes are discounted by the same *rate*: ``d`` of the
smaller class's counts, in proportion more of the larger one's. Counts up to the discount are
taken whole, so a rare expression has in both classes what the shared counts say, and the model
needs to hold only expressions above it; that leaves out nothing that would change a score. ``d`` is
chosen, with the curve below, among a few values.

The class models are fitted on at most LABELLED different texts a class, those of least hashes; the
shared counts are of all documents and grow with them.

A text is judged by its log-likelihood ratio, normalised by length: in its most toxic window of WINDOW
words, and over the TOP share of its most telling words (in a long text a few insults drown). A logistic curve joins both
into a score. Its numbers, and ``d``, are fitted on at most ``sample`` texts a class, each seen
without its own counts.

Words are runs of letters and digits, whole; scripts without spaces count by character. A model of up
to MODEL expressions goes to the tasks; of a larger one the tasks know the words most texts have, and
the other words of the texts meet their expressions by a shuffle (``scored``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import ascii_words, small_or_shuffled, table, text_batches, text_of

#: Different labelled texts of each class at most that the class models are fitted on, and of those the ones for the curve's three numbers.
LABELLED, SAMPLE = 16_384, 4000
#: Words of a window, and one in so many words that is among the most telling.
WINDOW, TOP = 16, 50
#: Discounts to choose from, in counts of the smaller class.
DISCOUNTS = (2.0, 4.0, 8.0)
#: Expressions of a model that goes to all tasks.
MODEL = 500_000
#: Different expressions that a task holds before it passes their counts on.
HELD = 100_000
#: A score from which a text counts as toxic.
THRESHOLD = 0.3
#: Characters of scripts without spaces: each is a word.
ALONE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: What a text's first word is seen after.
START = b""


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str | None) -> list[bytes]:
    text = (text or "").lower()
    if not text.isascii() and ALONE.search(text):
        text = ALONE.sub(" \\g<0> ", text)
    return ascii_words(text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By word the texts that hold it (``before`` null), and by pair the labelled texts of each class."""
    classes, shared = (Counter(), Counter()), Counter()

    def records() -> Iterator[pa.RecordBatch]:
        names, none = ["before", "word", "n0", "n1", "n2"], lambda n: pa.array(np.zeros(n, np.int64))
        for y, c in enumerate(classes):
            if c:
                before, word = zip(*c, strict=True)
                n = pa.array(list(c.values()), pa.int64())
                yield pa.record_batch([pa.array(before, pa.binary()), pa.array(word, pa.binary()), *((none(len(c)), n) if y else (n, none(len(c)))), none(len(c))], names)
        columns = [pa.nulls(len(shared), pa.binary()), pa.array(list(shared), pa.binary()), none(len(shared)), none(len(shared)), pa.array(list(shared.values()), pa.int64())]
        yield pa.record_batch(columns, names)
        for c in (*classes, shared):
            c.clear()

    for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        for y, text, counted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            if counted:
                shared.update(set(words))
            if y is not None:
                classes[y].update(set(zip([START, *words], words, strict=False)))
        if len(shared) + len(classes[0]) + len(classes[1]) > HELD:
            yield from records()
    yield from records()


@dataclass
class Counts:
    """What all probabilities need: the expressions above the least discount as small tables, totals of both classes, and the shared counts' numbers."""

    words: DataFrame
    pairs: DataFrame
    levels: list[Level]
    shared: tuple[float, float, float]


def _usual(once: float, twice: float) -> float:
    """The discount that the counts of counts give."""
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.9)


def counted(texts: DataFrame, discounts: tuple[float, ...]) -> Counts | None:
    """Counts of ``label, text, shared``; None without pairs of both classes.

    Every pair and word is counted; what no discount leaves anything of is then dropped, as it changes no score.
    """
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(3)]
    grams = table(texts.select("label", "text", "shared").mapInArrow(_counts, "before binary, word binary, n0 long, n1 long, n2 long").groupBy("before", "word").agg(*sums), "grams", "zstd")
    pairs = grams.filter("before is not null")
    some = lambda c: F.sum((F.col(c) > 0).cast("long"))
    # a word's contexts are the pairs that end with it
    words = table(grams.groupBy("word").agg(F.sum("n2").alias("texts"), some("n0").alias("k0"), some("n1").alias("k1")), "words", "zstd")
    one = lambda n: F.sum((F.col("texts") == n).cast("long"))
    k0, k1, total, kinds, n1, n2 = (float(x or 0) for x in words.agg(F.sum("k0"), F.sum("k1"), F.sum("texts"), some("texts"), one(1), one(2)).first())
    both = [F.sum((F.col("n0") + F.col("n1") == n).cast("long")) for n in (1, 2)]
    t0, t1, b1, b2 = (float(x or 0) for x in pairs.agg(F.sum("n0"), F.sum("n1"), *both).first())
    if not (k0 and k1 and t0 and t1):
        return None
    types, tokens = np.array([k0, k1]), np.array([t0, t1])
    at = lambda d, of: [float(x) for x in d * of / of.min()]  # noqa: E731  ``d`` in the class with fewer, as large a share in the other
    freed = lambda c, d: F.sum(F.least(F.col(c).cast("double"), F.lit(d)))
    told = words.agg(*(freed(f"k{y}", at(d, types)[y]) for d in discounts for y in (0, 1))).first()
    levels = [Level(np.array(at(d, types)), np.array(at(d, tokens)), np.array(told[2 * i : 2 * i + 2], float) / types, types, tokens, _usual(b1, b2)) for i, d in enumerate(discounts)]
    least = min(levels, key=lambda level: level.word_discount[0])
    above = lambda names, limits: (F.col(names[0]) > float(limits[0])) | (F.col(names[1]) > float(limits[1]))
    kept_pairs = table(pairs.filter(above(("n0", "n1"), least.pair_discount)).drop("n2"), "pairs", "zstd")
    left = [freed(f"n{y}", at(d, tokens)[y]).alias(f"left{y}_{i}") for i, d in enumerate(discounts) for y in (0, 1)]
    # pairs of a first word none of which is above the discount free all of it, as an unseen one does
    firsts = kept_pairs.select("before").distinct()
    contexts = pairs.join(firsts, "before", "left_semi").groupBy(F.col("before").alias("word")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.count("*").alias("kinds"), *left)
    named = kept_pairs.select("word").union(firsts).distinct().withColumn("named", F.lit(True))
    kept = words.join(named, "word", "full").filter(above(("k0", "k1"), least.word_discount) | F.col("named")).drop("named")
    kept = table(kept.join(contexts, "word", "left").na.fill(0), "kept", "zstd")
    return Counts(kept, kept_pairs, levels, (total, kinds, _usual(n1, n2)))


def shared_probability(texts: np.ndarray, shared: tuple[float, float, float]) -> np.ndarray:
    """Of words in so many texts: discounted, what is freed spread evenly over all words and an unseen one."""
    total, types, discount = shared
    return np.maximum(texts - discount, 0) / total + discount * types / total / (types + 1)


@dataclass
class Level:
    """Probabilities at one discount ``d``: what words and contexts free, by class."""

    word_discount: np.ndarray
    pair_discount: np.ndarray
    freed: np.ndarray
    types: np.ndarray
    tokens: np.ndarray
    pooled: float

    def word(self, k: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of words with contexts ``k`` (two rows: classes) and shared probabilities ``p``."""
        return np.maximum(k - self.word_discount[:, None], 0) / self.types[:, None] + self.freed[:, None] * p

    def pair(self, n: np.ndarray, context: np.ndarray, left: np.ndarray, kinds: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Of pairs in ``n`` texts; their first words' pairs, of so many ``kinds``, sum to ``context`` and free ``left`` of it. ``word``: the second words' probabilities."""
        seen, all_seen = np.maximum(context, 1), np.maximum(context.sum(axis=0), 1)
        shared = np.maximum(n.sum(axis=0) - self.pooled, 0) / all_seen + self.pooled * kinds / all_seen * p
        tilt = word / (self.tokens @ word / self.tokens.sum())
        return np.maximum(n - self.pair_discount[:, None], 0) / seen + np.where(context > 0, left / seen, 1) * shared * tilt


@dataclass
class Model:
    """The expressions above the discount; all others have what both classes share.

    ``ids`` numbers words from 1. Arrays of words have the unknown word at 0: contexts ``k`` a class, ``shared`` probability, sums
    ``context`` and what is freed of them ``left`` as first words, of so many ``kinds`` of pairs. ``keys`` are pairs in ascending order, ``n`` their texts a class.
    """

    level: Level | None = None
    ids: dict[bytes, int] = field(default_factory=dict)
    k: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))
    shared: np.ndarray = field(default_factory=lambda: np.ones(1))
    context: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    n: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    curve: tuple[float, ...] | None = None
    #: Where the model is larger: words, contexts and pairs as tables of log ratios, beside the ratio of an unknown word.
    tables: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}  # tasks get what they hold, tables stay with the driver

    def pairs_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words, of those before them, and the place of each pair among ``keys`` (-1: none)."""
        known = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        before = np.concatenate([[self.ids.get(START, 0)], known[:-1]]).astype(np.int64)
        if not len(self.keys):
            return known, before, np.full(len(known), -1)
        key = before * len(self.shared) + known
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return known, before, np.where(self.keys[at] == key, at, -1)

    def prepare(self) -> None:
        """Log ratios (toxic over ordinary) of words, contexts and pairs, once for all texts."""
        p = self.level.word(self.k, self.shared)
        seen = np.maximum(self.context, 1)
        through = np.where(self.context > 0, self.left / seen, 1)
        self.of_word, self.of_context = np.log(p[1] / p[0]), np.log(through[1] / through[0])
        first, second = np.divmod(self.keys, len(self.shared))
        whole = self.level.pair(self.n, self.context[:, first], self.left[:, first], self.kinds[first], p[:, second], self.shared[second])
        self.of_pair = np.log(whole[1] / whole[0])

    def ratios(self, words: list[bytes]) -> np.ndarray:
        known, before, at = self.pairs_of(words)
        return np.where(at >= 0, self.of_pair[at] if len(self.keys) else 0, self.of_word[known] + self.of_context[before])

    def ratios_without(self, words: list[bytes], y: int) -> np.ndarray:
        """As a text of class ``y`` sees it without its own counts: each of its pairs one text less, each word as many contexts less as the text gives it."""
        known, before, at = self.pairs_of(words)
        own = np.array([[y == 0], [y == 1]])
        pairs = np.unique(np.column_stack([before, known]), axis=0) if len(known) else np.zeros((0, 2), np.int64)
        given, started = np.zeros(len(self.shared)), np.zeros(len(self.shared))
        np.add.at(given, pairs[:, 1], 1)
        np.add.at(started, pairs[:, 0], 1)
        p = self.level.word(np.maximum(self.k[:, known] - own * given[known], 0), self.shared[known])
        context = np.maximum(self.context[:, before] - own * started[before], 0)
        left = np.minimum(self.left[:, before], context)
        through = np.where(context > 0, left / np.maximum(context, 1), 1)
        out = np.log(p[1] / p[0]) + np.log(np.maximum(through[1], 1e-9) / np.maximum(through[0], 1e-9))
        if len(held := np.flatnonzero(at >= 0)):
            n = np.maximum(self.n[:, at[held]] - own, 0)
            whole = self.level.pair(n, context[:, held], left[:, held], self.kinds[before[held]], p[:, held], self.shared[known[held]])
            out[held] = np.log(whole[1] / whole[0])
        return out

    def score_of(self, ratios: np.ndarray) -> float:
        if self.curve is None:
            return 0.0
        at = self.curve[0] + float(np.dot(self.curve[1:], features(ratios)))
        return float(1 / (1 + np.exp(-min(max(at, -30.0), 30.0))))

    def score(self, text: str | None) -> float:
        return self.score_of(self.ratios(words_of(text))) if self.curve else 0.0


def features(ratios: np.ndarray) -> tuple[float, float]:
    """Ratio per word in the most toxic window, and over the most telling words; 0 without words."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0
    sums, size, top = np.concatenate([[0], np.cumsum(ratios)]), min(n, WINDOW), max(1, n // TOP)
    return float((sums[size:] - sums[:-size]).max() / size), float(np.partition(ratios, n - top)[n - top :].mean())


def _different(texts: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``label, text, shared``: each text for the shared counts, and of equal texts of a class one with its label; and how many different ones each class has.

    Only labelled texts that occur repeatedly are shuffled.
    """
    shared = F.lit(True).alias("shared")
    rows = texts.withColumn("digest", F.when(F.col("label").isNotNull(), F.sha2("text", 256)))
    groups = table(rows.filter("label is not null").groupBy("label", "digest").agg(F.count("*").alias("copies")), "digests")
    sizes = {r[0]: r[1] for r in groups.groupBy("label").count().collect()}
    several = groups.filter("copies > 1").drop("copies").withColumn("several", F.lit(True))
    if several.isEmpty():
        return texts.select("label", "text", shared), sizes
    marked = small_or_shuffled(rows, several, ["label", "digest"], "left", several.count())
    first = marked.filter("several").dropDuplicates(["label", "digest"]).select("label", "text", F.lit(False).alias("shared"))
    return marked.select(F.when(F.col("several").isNull(), F.col("label")).alias("label"), "text", shared).unionByName(first), sizes


def _parts(counts: Counts, i: int) -> tuple[DataFrame, DataFrame]:
    """Words and pairs of the model at the i-th discount: those above it in some class, and the words of those pairs."""
    level = counts.levels[i]
    above = lambda names, limits: (F.col(names[0]) > float(limits[0])) | (F.col(names[1]) > float(limits[1]))
    pairs = counts.pairs.filter(above(("n0", "n1"), level.pair_discount))
    named = pairs.select("word").union(pairs.select("before")).distinct().withColumn("named", F.lit(True))
    words = counts.words.join(named, "word", "left").filter(above(("k0", "k1"), level.word_discount) | F.col("named")).drop("named")
    return words, pairs


def _collected(counts: Counts, words: DataFrame, pairs: DataFrame) -> list[Model]:
    """The model of rows that were counted, or are bounded by a sample, to be few: one a discount, with the same expressions."""
    rows = words.orderBy("word").toArrow()
    ids = {w: i for i, w in enumerate(rows["word"].to_pylist(), 1)}
    column = lambda *names: np.array([np.concatenate([[0.0], rows[n].to_numpy().astype(float)]) for n in names])
    found = pairs.toArrow()
    number = lambda name: np.array([ids[w] for w in found[name].to_pylist()], np.int64)
    keys = number("before") * (len(ids) + 1) + number("word")
    order = np.argsort(keys)
    n = np.array([found[c].to_numpy().astype(float)[order] for c in ("n0", "n1")])
    shared = shared_probability(column("texts")[0], counts.shared)
    out = []
    for i, level in enumerate(counts.levels):
        out.append(Model(level, ids, column("k0", "k1"), shared, column("c0", "c1"), column(f"left0_{i}", f"left1_{i}"), column("kinds")[0], keys[order], n))
    return out


def _of_sample(texts: DataFrame, words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The words and pairs that occur in a bounded sample of texts."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {w for t in batch.column(0).to_pylist() for w in words_of(t)} | {START}
            yield pa.record_batch([pa.array(list(found), pa.binary())], ["word"])

    known = table(texts.select("text").mapInArrow(held, "word binary").distinct(), "known")
    both = pairs.join(known, "word", "left_semi").join(known.withColumnRenamed("word", "before"), "before", "left_semi")
    return words.join(known, "word", "left_semi"), both


def _edges(texts: DataFrame, sizes: dict[int, int], most: int) -> dict[int, int | None]:
    """For each class the hash up to which ``most`` texts lie; None where all do."""
    edge = lambda y: texts.filter(F.col("label") == y).select(F.xxhash64("text").alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return {y: edge(y) if n > most else None for y, n in sizes.items()}


def _within(edges: dict[int, int | None]) -> Column:
    """Whether a labelled text is among those of its class up to the edge."""
    beyond = F.lit(False)
    for y, edge in edges.items():
        if edge is not None:
            beyond = beyond | ((F.col("label") == y) & (F.xxhash64("text") > edge))
    return F.col("label").isNotNull() & ~beyond


def fit(texts: DataFrame, sample: int = SAMPLE, discounts: tuple[float, ...] = DISCOUNTS, most: int = MODEL, labelled: int = LABELLED) -> Model:
    """The model of all rows ``label, text`` (as ``labelled`` gives: label null where it is unknown or must not be learned).

    Of equal texts of a class one counts for it, and of different ones those of the ``labelled`` least hashes; for the shared counts each row does.
    At most ``sample`` texts a class, again those of the least hashes, give the curve and the discount. Without both classes every score is 0.
    """
    texts, sizes = _different(text_batches(texts))
    if len(sizes) < 2:
        return Model()
    within = _within(_edges(texts, sizes, labelled))
    counts = counted(texts.withColumn("label", F.when(within, F.col("label"))), discounts)
    if counts is None:
        return Model()
    drawn = table(texts.filter(_within(_edges(texts, sizes, min(sample, labelled)))).select("label", "text"), "drawn")
    tried = _collected(counts, *_of_sample(drawn, counts.words, counts.pairs))
    found = _features(drawn, tried)
    y = found[:, 0]
    weight = np.where(y == 1, sizes[1] / max((y == 1).sum(), 1), sizes[0] / max((y == 0).sum(), 1))
    fits = [logistic(y, found[:, 1 + 2 * k : 3 + 2 * k], weight) for k in range(len(tried))]
    least = min(fits, key=lambda f: f[0])
    # the largest discount that is no worse than the best by more than chance
    fair = [k for k, (loss, _, each) in enumerate(fits) if loss - least[0] <= (each - least[2]).std() / len(each) ** 0.5]
    best = max(fair, key=lambda k: discounts[k])
    words, pairs = (table(part, "model", "zstd") for part in _parts(counts, best))
    if words.count() + pairs.count() <= most:
        model = _collected(counts, words, pairs)[best]
    else:
        head = words.orderBy(F.desc("texts"), "word").limit(most // 2)
        model = _collected(counts, head, pairs.filter("false"))[best]
        model.tables = _ratio_tables(counts.levels[best], best, counts, words, pairs)
    model.prepare()
    model.curve = fits[best][1]
    return model


def _features(texts: DataFrame, tried: list[Model]) -> np.ndarray:
    """Label, and both features under each of the tried models without the text's own counts, of the bounded sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            out = []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                out.append([x for model in tried for x in features(model.ratios_without(words, y))])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["label", "x"])

    return np.array([[r[0], *r[1]] for r in texts.mapInArrow(rows, "label int, x array<double>").collect()], float)


def logistic(y: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, ...], np.ndarray]:
    """Weighted logistic regression with a small ridge: mean loss, its three numbers, and each row's loss by its weight."""
    x, weight = np.column_stack([np.ones(len(y)), x]), weight / weight.sum()
    sign, theta, ridge = 2 * y - 1, np.zeros(3), np.array([1e-9, 1e-6, 1e-5])

    def loss(t: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, -sign * (x @ t))).sum() + (ridge * t * t).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(slope, x.T @ (weight * (p - y)) + ridge * theta)
        while np.abs(step).max() > 1e-8 and loss(theta - step) > loss(theta):
            step = step / 2  # where classes lie apart, whole Newton steps overshoot
        theta = theta - step
        if np.abs(step).max() < 1e-7:
            break
    return loss(theta), tuple(theta.tolist()), len(y) * weight * np.logaddexp(0, -sign * (x @ theta))


def toxicity(model: Model, text_col: str = "text") -> Column:
    """The score of each whole text under a model that the tasks hold; null and empty texts have the curve's value at ratio 0."""
    if model.tables is not None:
        raise ValueError("this model is larger than a task holds: use scored")

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for i in range(0, len(texts), 200) for t in texts.slice(i, 200).to_pylist()], pa.float64())

    return scores(F.col(text_col).cast("string"))


def _ratio_tables(level: Level, i: int, counts: Counts, words: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``word, ratio``, ``before, through`` and ``before, word, whole``: the log ratios of a large model, by built-in functions."""
    total, types, discount = counts.shared
    shared = lambda n: F.greatest(n - discount, F.lit(0.0)) / total + discount * types / total / (types + 1)
    p = [F.greatest(F.col(f"k{y}") - float(level.word_discount[y]), F.lit(0.0)) / float(level.types[y]) + float(level.freed[y]) * shared(F.col("texts")) for y in (0, 1)]
    through = [F.when(F.col(f"c{y}") > 0, F.col(f"left{y}_{i}") / F.col(f"c{y}")).otherwise(1.0) for y in (0, 1)]
    told = words.select("word", p[0].alias("p0"), p[1].alias("p1"), shared(F.col("texts")).alias("p"), through[0].alias("t0"), through[1].alias("t1"), "c0", "c1", "kinds")
    first = told.select(F.col("word").alias("before"), "t0", "t1", "c0", "c1", "kinds")
    both = pairs.join(told.select("word", "p0", "p1", "p"), "word").join(first, "before")
    seen = F.greatest(F.col("c0") + F.col("c1"), F.lit(1))
    pooled = F.greatest(F.col("n0") + F.col("n1") - level.pooled, F.lit(0.0)) / seen + level.pooled * F.col("kinds") / seen * F.col("p")
    usual = (float(level.tokens[0]) * F.col("p0") + float(level.tokens[1]) * F.col("p1")) / float(level.tokens.sum())
    own = [F.greatest(F.col(f"n{y}") - float(level.pair_discount[y]), F.lit(0.0)) / F.greatest(F.col(f"c{y}"), F.lit(1)) for y in (0, 1)]
    q = [own[y] + F.col(f"t{y}") * pooled * F.col(f"p{y}") / usual for y in (0, 1)]
    return (
        table(told.select("word", F.log(F.col("p1") / F.col("p0")).alias("ratio")), "words"),
        table(first.select("before", F.log(F.col("t1") / F.col("t0")).alias("through")), "contexts"),
        table(both.select("before", "word", F.log(q[1] / q[0]).alias("whole")), "pairs"),
    )


def scored(docs: DataFrame, model: Model, text_col: str = "text", as_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as ``as_col``, by a model of any size.

    A model that the tasks hold scores texts where they are read. Beyond that each text's words are
    numbered by their place and meet the tables of ratios by shuffles, but for the words most texts have,
    whose own ratio the tasks know; a text's ratios come together again, no more than its words.
    """
    if model.tables is None:
        at = docs.columns.index(text_col)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
                texts = batch.column(at).cast(pa.string()).to_pylist()
                yield pa.record_batch([*batch.columns, pa.array([model.score(t) for t in texts], pa.float64())], [*batch.schema.names, as_col])

        # whole rows, as workers of column functions load more libraries than these, and stay
        return text_batches(docs).mapInArrow(score, StructType([*docs.schema.fields, StructField(as_col, DoubleType())]))
    row = "_" * (1 + max((len(c) for c in docs.columns), default=0)) + "row"
    rows = table(text_batches(docs).withColumn(row, F.monotonically_increasing_id()), "rows")
    unknown = float(model.of_word[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 50) for b in batches for i in range(0, b.num_rows, 50)):
            owner, place, before, words = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text)
                owner += [key] * len(found)
                place += range(len(found))
                words += found
                before += [START, *found[:-1]] if found else []
            own = [None if (i := model.ids.get(w)) is None else float(model.of_word[i]) for w in words]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()]
            for i in range(0, len(words), 100_000):
                yield pa.record_batch([pa.array(c[i : i + 100_000], t) for c, t in zip((owner, place, before, words, own), kinds, strict=True)], ["owner", "place", "before", "word", "own"])

    of_word, of_context, of_pair = model.tables
    tokens = rows.select(row, F.col(text_col).cast("string")).mapInArrow(cut, "owner long, place long, before binary, word binary, own double")
    # frequent words are spread by their place, and their few rows copied to each part
    parts = 16
    spread = lambda df, *names: df.join(df.sparkSession.range(parts).select(F.col("id").alias("part")))  # noqa: E731, ARG005
    tokens = tokens.withColumn("part", F.pmod(F.hash("owner", "place"), F.lit(parts)).cast("long"))
    met = tokens.filter("own is null").join(spread(of_word), ["word", "part"], "left").select("owner", "place", "part", "before", "word", F.coalesce("ratio", F.lit(unknown)).alias("own"))
    both = tokens.filter("own is not null").select(met.columns).unionByName(met)
    both = both.join(spread(of_context), ["before", "part"], "left").join(spread(of_pair), ["before", "word", "part"], "left")
    ratio = F.coalesce("whole", F.col("own") + F.coalesce("through", F.lit(0.0)))
    lists = both.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", ratio.alias("ratio")))), lambda x: x["ratio"]).alias("ratios"))

    @F.arrow_udf("double")
    def judged(lists: pa.Array) -> pa.Array:
        return pa.array([model.score_of(np.array(r or [], float)) for r in lists.to_pylist()], pa.float64())

    found = lists.select(F.col("owner").alias(row), judged("ratios").alias("found_score"))
    return rows.join(found, row, "left").withColumn(as_col, F.coalesce("found_score", F.lit(model.score_of(np.zeros(0))))).drop(row, "found_score")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``label, text`` of all rows; the label is null where there is none to learn from.

    Of several labels of an id the largest counts; labels other than 0 and 1, null ids and held-out ones are not learned.
    """
    known = labels.filter(~held_out(id_col)).filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    known = table(known, "labels")
    texts = docs.select(F.col(id_col).alias("key"), text_of(text_col).alias("text"))
    return small_or_shuffled(texts, known, "key", "left", known.count()).select("label", "text")
