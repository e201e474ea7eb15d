"""A stored inverted index of words: BM25 for many queries at once, phrases, and all-words matches.

Each text moves once, to its slice (of a fixed number of rows, by the row's hash), and a task turns a
slice into postings: a term's rows in order of their impact, in blocks with the largest impact as their
bound. So a term that every text has is many groups of bounded size. A search brings a slice's blocks of
the asked terms and all queries together, adds up each query's postings as arrays and keeps the slice's
best; so no posting becomes a row for each query that asks for it. ``blocks_read`` tells how few blocks
the bounds would leave to a search that skips.

The folder holds ``rows`` (key, words), ``terms`` (rows that have it) and ``postings`` in buckets of
terms, sorted by term, so that a term's blocks are a few row groups.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import stemming
from quire.sources.tables import small_by_count, table, text_batches

#: Constants of BM25.
K1, B = 1.2, 0.75
#: Rows of a slice, postings of a block, buckets of terms, queries that meet a slice at once.
SLICE, BLOCK, BUCKETS, QUERIES = 16_384, 128, 64, 65_536
#: How texts become terms.
TERMS: dict[str, Callable[[str | None], list[str]]] = {"words": stemming.words, "stems": stemming.stems}


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([len(stemming.words(t)) for t in batch.column(1).to_pylist()], pa.int32())], ["key", "size"])


def _inverted(kind: str, mean: float, k1: float, b: float, block: int):
    """Rows ``key, content, slice`` in the order of their slices to blocks of postings: a task holds the words of one slice as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, sizes, terms, words = None, [], [], {}, array("i")
        for batch in batches:
            slices = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), batch.num_rows]
            for first, end in pairwise(edges):
                if first < end and slices[first] != own:
                    yield from _slice_blocks(own, keys, sizes, terms, words, mean, k1, b, block)
                    own, keys, sizes, terms, words = int(slices[first]), [], [], {}, array("i")
                keys.append(batch.column(0).slice(first, end - first))
                for text in batch.column(1).slice(first, end - first).to_pylist():
                    found = TERMS[kind](text)
                    sizes.append(len(found))
                    words.extend([terms.setdefault(t, len(terms)) for t in found])
        yield from _slice_blocks(own, keys, sizes, terms, words, mean, k1, b, block)

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all runs, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())


def _slice_blocks(own, keys, sizes, terms, words, mean, k1, b, block) -> Iterator[pa.RecordBatch]:
    if not len(words):
        return
    sizes, word, names = np.array(sizes), np.frombuffer(words, np.int32), np.array(list(terms), object)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    position = _spread(np.zeros(len(sizes), np.int64), sizes).astype(np.int32)
    order = np.argsort(word, kind="stable")  # rows and positions stay in order
    word, row, position = word[order], row[order], position[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(word) != 0) | (np.diff(row) != 0))))
    tf = np.diff(np.append(first, len(word)))
    word, row = word[first], row[first]
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / mean))
    order = np.lexsort((-impact, word))
    word, row, impact, tf, first = word[order], row[order], impact[order], tf[order], first[order]
    begins = np.flatnonzero(np.concatenate(([True], np.diff(word) != 0)))
    nth = np.arange(len(word)) - np.repeat(begins, np.diff(np.append(begins, len(word))))
    begins = np.flatnonzero(nth % block == 0)
    ends, held = np.append(begins[1:], len(word)), pa.concat_arrays(keys)
    for at in range(0, len(begins), 2000):
        a, z = begins[at], ends[min(at + 2000, len(ends)) - 1]
        head = begins[at : at + 2000]
        many = _offsets(ends[at : at + 2000] - head)
        places = pa.ListArray.from_arrays(_offsets(tf[a:z]), pa.array(position[_spread(first[a:z], tf[a:z])]))
        yield pa.record_batch(
            [
                pa.array(names[word[head]], pa.string()),
                pa.array(np.full(len(head), own, np.int32)),
                pa.array((nth[head] // block).astype(np.int32)),
                pa.array(impact[head]),
                pa.ListArray.from_arrays(many, held.take(pa.array(row[a:z]))),
                pa.ListArray.from_arrays(many, pa.array(impact[a:z])),
                pa.ListArray.from_arrays(many, places),
            ],
            ["term", "slice", "block", "top", "keys", "impacts", "positions"],
        )


class _Slice:
    """The asked terms' postings of one slice: rows by number, their keys, and each term's runs of postings."""

    def __init__(self, blocks: pa.Table):
        held = blocks["keys"].combine_chunks()
        coded = held.flatten().dictionary_encode()
        self.rows, self.keys = coded.indices.to_numpy(), coded.dictionary
        self.rank = np.argsort(pc.sort_indices(self.keys).to_numpy())
        runs: dict[str, list[tuple[int, int]]] = {}
        for term, a, z in zip(blocks["term"].to_pylist(), (o := held.offsets.to_numpy() - held.offsets[0].as_py())[:-1].tolist(), o[1:].tolist(), strict=True):
            runs.setdefault(term, []).append((a, z))
        self.places = {t: np.concatenate([np.arange(a, z) for a, z in r]) for t, r in runs.items()}


def _best_of_slice(k: int, every: bool, kind_of: pa.Schema):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not (blocks.num_rows and asked.num_rows):
            return kind_of.empty_table()
        here = _Slice(blocks)
        weights = blocks["impacts"].combine_chunks().flatten().to_numpy() * np.repeat(blocks["idf"].to_numpy(), pc.list_value_length(blocks["keys"]).to_numpy())
        known = {t: (here.rows[p], weights[p]) for t, p in here.places.items()}
        score, had = np.zeros(len(here.keys)), np.zeros(len(here.keys), np.int32)
        whose, rows, scores = [], [], []
        for n, (terms, need) in enumerate(zip(asked["terms"].to_pylist(), asked["asked"].to_pylist(), strict=True)):
            met = [known[t] for t in terms if t in known]
            if not met or every and len(met) < need:
                continue
            score.fill(0)
            for row, weight in met:
                score[row] += weight
            if every:
                had.fill(0)
                for row, _ in met:
                    had[row] += 1
                score[had < need] = 0
            top = np.flatnonzero(score)
            if len(top) > k:
                some = score[top]
                top = top[some >= np.partition(some, -k)[-k]]  # ties too
            top = top[np.lexsort((here.rank[top], -score[top]))[:k]]
            whose.append(np.full(len(top), n)), rows.append(top), scores.append(score[top])
        if not whose:
            return kind_of.empty_table()
        return pa.Table.from_arrays([asked["query_id"].combine_chunks().take(pa.array(np.concatenate(whose))), here.keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], schema=kind_of)

    return run


def _phrases_of_slice(kind_of: pa.Schema):
    """Starts of a phrase: places of its rarest word, of which those stay that have each other word at its distance."""

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not (blocks.num_rows and asked.num_rows):
            return kind_of.empty_table()
        here, phrases = _Slice(blocks), asked["terms"].to_pylist()
        lists = blocks["positions"].combine_chunks().flatten()
        at, first = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        wide = int(at.max()) + max(map(len, phrases)) + 1  # a row's places, and room for a phrase before the next row's
        known = {}
        for term, places in here.places.items():
            sizes = first[places + 1] - first[places]
            known[term] = np.sort(np.repeat(here.rows[places].astype(np.int64) * wide, sizes) + at[_spread(first[places].astype(np.int64), sizes)])
        whose, rows, counts = [], [], []
        for n, terms in enumerate(phrases):
            if not terms or any(t not in known for t in terms):
                continue
            by = sorted(range(len(terms)), key=lambda i, terms=terms: len(known[terms[i]]))
            starts = known[terms[by[0]]] - by[0]
            for i in by[1:]:
                held, wanted = known[terms[i]], starts + i
                place = np.searchsorted(held, wanted)
                starts = starts[held[np.minimum(place, len(held) - 1)] == wanted]
                if not len(starts):
                    break
            row, many = np.unique(starts // wide, return_counts=True)
            whose.append(np.full(len(row), n)), rows.append(row), counts.append(many)
        if not whose:
            return kind_of.empty_table()
        return pa.Table.from_arrays([asked["query_id"].combine_chunks().take(pa.array(np.concatenate(whose))), here.keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(counts), pa.int64())], schema=kind_of)

    return run


def _query_terms(queries: DataFrame, kind: str, places: bool = False) -> DataFrame:
    """``query_id, term`` of each query text, each term once; with ``places`` each occurrence and its ``offset``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, at, w) for n, t in enumerate(batch.column(1).to_pylist()) for at, w in enumerate(TERMS[kind](t))]
            own = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([batch.column(0).take(own), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["query_id", "offset", "term"])

    found = queries.select("query_id", F.col("query_text").cast("string")).mapInArrow(cut, f"query_id {queries.schema['query_id'].dataType.simpleString()}, offset int, term string")
    return found if places else found.select("query_id", "term").distinct()


def bucket_of(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    folder: str
    kind: str
    key: str
    rows: int
    mean: float
    slices: int
    key_kind: str

    @classmethod
    def build(cls, rows: DataFrame, folder: str, key: str, content: str = "content", kind: str = "words", k1: float = K1, b: float = B) -> TextIndex:
        """An index of all rows and whole texts; null and empty texts have no words and are found by no query. Keys must be unique."""
        spark = rows.sparkSession
        named = text_batches(rows).select(F.col(key).alias("key"), F.col(content).cast("string").alias("content"))
        key_kind = named.schema["key"].dataType.simpleString()
        named.mapInArrow(_sizes, f"`key` {key_kind}, size int").write.parquet(f"{folder}/rows")
        n, mean = spark.read.parquet(f"{folder}/rows").agg(F.count("*"), F.avg(F.when(F.col("size") > 0, F.col("size")))).first()
        slices = max(1, -(-n // SLICE))
        # each text moves once, to its slice; a task turns a slice at a time into blocks, highest impact first
        dealt = named.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")).repartition(slices, "slice").sortWithinPartitions("slice")
        kinds = f"term string, slice int, block int, top double, keys array<{key_kind}>, impacts array<double>, positions array<array<int>>"
        blocks = dealt.mapInArrow(_inverted(kind, float(mean or 1), k1, b, BLOCK), kinds).withColumn("bucket", bucket_of())
        blocks.sortWithinPartitions("bucket", "term", "slice", "block").write.partitionBy("bucket").parquet(f"{folder}/postings")
        about = (kind, key, int(n), float(mean or 0), int(slices), key_kind)
        spark.createDataFrame([about], "kind string, key string, rows long, mean double, slices int, key_kind string").coalesce(1).write.parquet(f"{folder}/about")
        index = cls(folder, *about)
        index.postings(spark).groupBy("term").agg(F.sum(F.size("keys")).alias("df"), F.max("top").alias("top")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TextIndex:
        return cls(folder, *spark.read.parquet(f"{folder}/about").first())

    def postings(self, spark: SparkSession) -> DataFrame:
        kinds = f"term string, slice int, block int, top double, keys array<{self.key_kind}>, impacts array<double>, positions array<array<int>>, bucket int"
        return spark.read.schema(kinds).parquet(f"{self.folder}/postings")

    def _weighted(self, queries: DataFrame) -> DataFrame:
        """``query_id, term, idf`` of the terms that the index has, and of each query's terms how many those are."""
        known = queries.sparkSession.read.parquet(f"{self.folder}/terms").select("term", "df")
        asked = _query_terms(queries, self.kind)
        asked = asked.join(asked.groupBy("query_id").agg(F.count("*").alias("asked")), "query_id")
        idf = F.log(1 + (self.rows - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return table(asked.join(known, "term").select("query_id", "term", "asked", idf.alias("idf"), bucket_of().alias("bucket")), "asked")

    def search(self, queries: DataFrame, k: int, every: bool = False) -> DataFrame:
        """For each query (``query_id``, ``query_text``) its k best rows by BM25: key, ``score``, ``place``; ties by key. With ``every`` only rows that have all its words."""
        asked = self._weighted(queries)
        of_query = asked.groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.first("asked").alias("asked"))
        blocks = self.postings(queries.sparkSession).select("bucket", "term", "slice", "keys", "impacts").join(small_by_count(table(self._distinct(asked), "terms")), ["bucket", "term"])
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `key` {self.key_kind}, score double"
        found, same = self._met(blocks.select("slice", "term", "idf", "keys", "impacts"), of_query, lambda s: _best_of_slice(k, every, s), kinds)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).withColumnRenamed("query_id", "first_id")
        return ranked.join(same, "first_id").select("query_id", F.col("key").alias(self.key), "score", "place")

    def _distinct(self, asked: DataFrame) -> DataFrame:
        return asked.select("bucket", "term", *(c for c in ("idf",) if c in asked.columns)).distinct()

    def _met(self, blocks: DataFrame, asked: DataFrame, work, kinds: str) -> tuple[DataFrame, DataFrame]:
        """``work`` over each slice's ``blocks`` with all of ``asked``, equal queries once and very many in parts; and for each ``first_id`` the equal ``query_id``."""
        asked = table(asked, "queries")
        like = [c for c in asked.columns if c != "query_id"]
        first = table(asked.groupBy(like).agg(F.min("query_id").alias("first_id")), "different")
        same = table(asked.join(first, like).select("query_id", "first_id"), "same")
        asked = first.withColumnRenamed("first_id", "query_id")
        parts = max(1, -(-asked.count() // QUERIES))
        tasks = min(self.slices * parts, 1024)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = blocks.withColumn("part", every(parts)) if parts > 1 else blocks.withColumn("part", F.lit(0))
        right = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("slice", every(self.slices))
        left, right = (df.repartition(tasks, "slice", "part").groupBy("slice", "part") for df in (left, right))
        empty = asked.sparkSession.createDataFrame([], kinds)
        return left.cogroup(right).applyInArrow(work(to_arrow_schema(empty.schema)), empty.schema), same

    def blocks_read(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """How many blocks a search opens at most, and how many the queries' terms have."""
        blocks = self._blocks(queries)
        threshold = self.search(queries, k).groupBy("query_id").agg(F.min("score").alias("threshold"), F.count("*").alias("n"))
        in_slice = blocks.groupBy("query_id", "slice", "term").agg(F.max("bound").alias("here"))
        slices = in_slice.groupBy("query_id", "slice").agg(F.sum("here").alias("most"))
        bound = blocks.join(in_slice, ["query_id", "slice", "term"]).join(slices, ["query_id", "slice"]).join(threshold, "query_id", "left")
        needed = bound.filter((F.coalesce("n", F.lit(0)) < k) | (F.col("bound") + F.col("most") - F.col("here") >= F.col("threshold") - 1e-9))
        return needed.count(), blocks.count()

    def _blocks(self, queries: DataFrame) -> DataFrame:
        """The blocks of the queries' terms, without their postings: ``query_id, term, idf, slice, block, bound``."""
        asked = self._weighted(queries)
        heads = self.postings(queries.sparkSession).select("bucket", "term", "slice", "block", "top")
        met = heads.join(small_by_count(asked), ["bucket", "term"])
        return table(met.select("query_id", "asked", "bucket", "term", "idf", "slice", "block", (F.col("idf") * F.col("top")).alias("bound")), "blocks")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """Rows that hold a query's words in a row: ``query_id``, key, ``n`` places. A slice at a time, from the rarest word on."""
        spark = queries.sparkSession
        places = table(_query_terms(queries, self.kind, places=True).withColumn("bucket", bucket_of()), "places")
        terms = F.transform(F.array_sort(F.collect_list(F.struct("offset", "term"))), lambda x: x["term"])
        held = self.postings(spark).select("bucket", "term", "slice", "keys", "positions").join(small_by_count(table(self._distinct(places), "terms")), ["bucket", "term"])
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `key` {self.key_kind}, n long"
        found, same = self._met(held.select("slice", "term", "keys", "positions"), places.groupBy("query_id").agg(terms.alias("terms")), _phrases_of_slice, kinds)
        return found.withColumnRenamed("query_id", "first_id").join(same, "first_id").select("query_id", F.col("key").alias(self.key), "n")
