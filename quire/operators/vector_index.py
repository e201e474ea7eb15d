"""A stored inverted-file index over vectors.

Vectors are dealt to lists by their nearest centre; a search looks only into the lists whose centres
are nearest to the query. Centres are fitted on a bounded sample (the rows of least hashes, at most
SAMPLE rows and NUMBERS numbers), and so is the number of lists to look into: the least with which the
sample's own neighbours are found at the target recall. Every row is indexed, and looking into all
lists is the exact search.

The index is a folder: ``rows`` as Parquet in a directory a list, so that a search reads only the lists
it needs, ``centres`` and ``about``. Writing rebalances lists by size, so a list that holds a third of
all rows is several files. Rows can be added later; they are dealt to the same centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vector import cosine_distance
from quire.operators.retrieval import MATRIX, Best, ranked
from quire.sources.tables import stored, table

#: Rows and numbers of the sample; lists at most; rounds of fitting.
SAMPLE, NUMBERS, LISTS, ROUNDS = 32_768, 8_000_000, 1024, 10
#: Recall of the ten nearest that the number of lists looked into is fitted to, on at most so many vectors of the sample.
RECALL, NEIGHBOURS, TRIALS = 0.95, 10, 400
#: Parts in which more numbers than ``NUMBERS`` are dealt to lists, one after the other, so that only a part's shuffle is on disk.
PARTS = 4
#: Rows that the driver compares with all centres at once, and trials with the whole sample.
ROWS, TRIALS_AT_ONCE = 1024, 50


def _unit(matrix: np.ndarray) -> np.ndarray:
    unit = np.empty(matrix.shape)
    for i in range(0, len(matrix), ROWS):
        some = matrix[i : i + ROWS]
        unit[i : i + ROWS] = some / np.maximum(np.sqrt((some * some).sum(axis=1)), 1e-300)[:, None]
    return unit


def _nearest_centres(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(unit[i : i + ROWS] @ centres.T).argmax(axis=1) for i in range(0, len(unit), ROWS)])


def fitted_centres(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres on the unit sphere by rounds of assignment and means; one that loses all its vectors stays."""
    unit = _unit(sample)
    centres = unit[:: max(1, len(unit) // lists)][:lists].copy()  # the sample is in the order of hashes
    for _ in range(rounds):
        own = _nearest_centres(unit, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = _unit(sums[full])
    return centres


def fitted_probes(sample: np.ndarray, centres: np.ndarray, recall: float = RECALL, trials: int = TRIALS) -> int:
    """The least number of lists that hold the target share of the nearest neighbours of the sample's vectors within the sample."""
    unit = _unit(sample)
    if len(unit) <= NEIGHBOURS + 1:
        return len(centres)
    chosen = np.arange(len(unit))[:: max(1, len(unit) // trials)][:trials]
    own, counts = _nearest_centres(unit, centres), np.zeros(len(centres), np.int64)
    for i in range(0, len(chosen), TRIALS_AT_ONCE):
        at = chosen[i : i + TRIALS_AT_ONCE]
        far = -(unit[at] @ unit.T)
        far[np.arange(len(at)), at] = np.inf
        near = np.argpartition(far, NEIGHBOURS, axis=1)[:, :NEIGHBOURS]
        order = np.argsort(-(unit[at] @ centres.T), axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(centres))[None, :].repeat(len(at), axis=0), axis=1)
        counts += np.bincount(np.take_along_axis(place, own[near], axis=1).ravel(), minlength=len(centres))
    return int(np.searchsorted(np.cumsum(counts), recall * counts.sum())) + 1


def _usable_sizes(vectors: pa.ListArray) -> np.ndarray:
    """The vectors' sizes; 0 for those without a distance to others, as ``usable`` has it."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)  # nulls are not finite here
    ends = np.concatenate(([0], np.cumsum(sizes)))
    finite, other = (np.concatenate(([0], np.cumsum(x)))[ends] for x in (np.isfinite(values), values != 0))
    return np.where((np.diff(finite) == sizes) & (np.diff(other) > 0), sizes, 0)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array(_usable_sizes(batch.column(1)), pa.int32())], ["key", "size"])


def _fitting(width: int, at: int):
    """Those rows whose vectors, in column ``at``, are usable and of this length, at most 1024 at once."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            fits = np.flatnonzero(_usable_sizes(batch.column(at)) == width)
            if len(fits):
                yield batch if len(fits) == batch.num_rows else batch.take(pa.array(fits))

    return fit


def _dealt(centres: np.ndarray):
    width = centres.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fitting(width, 1)(batches):
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            own = (_unit(rows) @ centres.T).argmax(axis=1)
            yield pa.record_batch([*batch.columns, pa.array(own, pa.int32())], ["key", "vector", "list"])

    return deal


def _matrix(vectors: pa.ChunkedArray, width: int, place: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length as rows of a matrix, at their ``place`` if given."""
    matrix, at = np.empty((len(vectors), width)), 0
    for some in vectors.chunks:
        rows = slice(at, at + len(some))
        matrix[rows if place is None else place[rows]] = some.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        at += len(some)
    return matrix


def _drawn(rows: DataFrame, hashes: DataFrame, most: int, width: int, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> np.ndarray:
    """Vectors of the ``most`` rows (``key``, and after ``made`` a ``vector``) of the least ``hashes``, in their order.

    Hashes are chosen first, so that no task makes or passes on vectors that others outdo, and the driver gets arrays.
    """
    least = hashes.orderBy("hash").limit(most).toArrow()["hash"].to_numpy()
    last = int(least.max())
    hashed = rows.withColumn("hash", F.xxhash64("key"))
    kinds = f"hash long, `key` {rows.schema['key'].dataType.simpleString()}, vector array<double>"
    fits = lambda of: made(hashed.filter(of)).select("hash", "key", "vector").mapInArrow(_fitting(width, 2), kinds)
    ties = fits(F.col("hash") == last).orderBy("key").limit(int((least == last).sum()))
    drawn = fits(F.col("hash") < last).unionByName(ties).select("hash", "vector").toArrow()
    place = np.empty(len(drawn), np.int64)
    place[np.argsort(drawn["hash"].to_numpy(), kind="stable")] = np.arange(len(drawn))
    return _matrix(drawn["vector"], width, place)


def usable(vector: str) -> Column:
    """Vectors with a distance to others: no nulls, only finite components, and not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class VectorIndex:
    folder: str
    centres: np.ndarray
    probes: int
    indexed: int
    left_out: int
    key: str
    #: Share of the sample's neighbours that the fitted number of lists holds.
    recall: float

    @classmethod
    def build(
        cls, rows: DataFrame, folder: str, key: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, recall: float = RECALL, embed: Callable[[DataFrame], DataFrame] | None = None
    ) -> VectorIndex:
        """An index of all rows that have a distance to anything: no nulls in the vector, not all zeros, and the commonest length. Others are counted as left out.

        With ``embed`` the rows come without vectors and it gives them; only the index keeps those, as they take many times the
        room of their texts. It must give a row the same vector each time: each row's is made twice, the sample's three times.
        """
        spark = rows.sparkSession
        vectors = F.col(vector).cast("array<double>").alias("vector")
        whole = rows.withColumn("key", F.col(key)) if embed else rows.select(F.col(key).alias("key"), vectors)
        made = (lambda some: embed(some).withColumn("vector", vectors)) if embed else lambda some: some
        key_kind = whole.schema["key"].dataType.simpleString()
        looked = made(whole).select("key", "vector").mapInArrow(_sizes, f"`key` {key_kind}, size int")
        looked = table(looked.select(F.xxhash64("key").alias("hash"), "size"), "sizes")
        sizes = looked.groupBy("size").agg(F.count("*").alias("n")).collect()  # a row a length
        known = sorted((-r["n"], r["size"]) for r in sizes if r["size"])
        if not known:
            raise ValueError("no vectors to index")
        n, width = -known[0][0], known[0][1]
        matrix = _drawn(whole, looked.filter(F.col("size") == width).select("hash"), min(sample, max(1, NUMBERS // width)), width, made)
        pa.default_memory_pool().release_unused()
        many = lists or max(1, min(LISTS, round(n**0.5), len(matrix) // 8))
        centres = fitted_centres(matrix, min(many, len(matrix)))
        probes = fitted_probes(matrix, centres, recall)
        parts = PARTS if n * width > NUMBERS else 1
        for part in range(parts):
            some = whole.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part) if parts > 1 else whole
            kept = made(some).select("key", "vector").mapInArrow(_dealt(centres), f"`key` {key_kind}, vector array<double>, list int")
            stored(kept.hint("rebalance", "list"), f"{folder}/rows", by=("list",), mode="append" if part else "error")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        about = (probes, n, sum(r["n"] for r in sizes) - n, key, recall)
        spark.createDataFrame([about], "probes int, indexed long, left_out long, key string, recall double").coalesce(1).write.parquet(f"{folder}/about")
        return cls(folder, centres, *about)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        about = spark.read.parquet(f"{folder}/about").first()
        centres = spark.read.parquet(f"{folder}/centres").orderBy("list").collect()
        return cls(folder, np.array([r["centre"] for r in centres], float), *about)

    def add(self, rows: DataFrame, vector: str = "embedding") -> None:
        """Further rows, in the lists of the centres as they are."""
        whole = rows.select(F.col(self.key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        dealt = whole.mapInArrow(_dealt(self.centres), f"`key` {whole.schema['key'].dataType.simpleString()}, vector array<double>, list int")
        dealt.hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.folder}/rows")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")

    def lists_of(self, vector: np.ndarray, probes: int) -> np.ndarray:
        like = self.centres @ vector
        return np.argsort(-like, kind="stable")[:probes]

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """For each query (``query_id``, ``query_vector``) the k nearest rows found: key, ``distance`` (exact), ``place``; ties by key.

        ``probes``: lists to look into; the fitted number by default, all of them for the exact search.
        Few queries go to all tasks by the lists they look into, and each task passes on k rows a
        query; many meet the lists' rows in a join on the list. Queries of another length, and those without a usable vector, find none.
        """
        spark, probes = queries.sparkSession, min(probes or self.probes, len(self.centres))
        fits = queries.filter((F.size("query_vector") == self.centres.shape[1]) & usable("query_vector")).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        numbers = fits.count() * self.centres.shape[1]
        rows = self.rows(spark)
        if numbers > MATRIX:
            return self._joined(fits, rows, k, probes)
        asked = fits.toArrow()
        matrix = _matrix(asked["query_vector"], self.centres.shape[1])
        wanted: dict[int, list[int]] = {}
        for q, v in enumerate(matrix):
            for at in self.lists_of(v, probes).tolist():
                wanted.setdefault(at, []).append(q)
        by_list = {at: np.array(qs) for at, qs in wanted.items()}
        if len(by_list) < len(self.centres):
            rows = rows.filter(F.col("list").isin(sorted(by_list)))  # read only their directories
        names = asked["query_id"].to_pylist()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, key_type = Best(matrix, k), None
            for batch in batches:
                key_type = batch.schema.field(0).type
                own = batch.column(2).to_numpy(zero_copy_only=False)
                for at in np.unique(own).tolist():
                    if at in by_list:
                        some = pa.array(np.flatnonzero(own == at))
                        best.add(batch.column(0).take(some), batch.column(1).take(some), by_list[at])
            if (found := best.record(names, key_type)) is not None:
                yield found

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `key` {rows.schema['key'].dataType.simpleString()}, distance double"
        return ranked(rows.select("key", "vector", "list").mapInArrow(near, kinds), k, "key").withColumnRenamed("key", self.key)

    def _joined(self, queries: DataFrame, rows: DataFrame, k: int, probes: int) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                lists = [self.lists_of(v, probes) for v in vectors]
                own = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.concatenate(lists).astype(np.int32))], ["query_id", "query_vector", "list"])

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, query_vector array<double>, list int"
        # a list's rows are spread over parts, each of which meets all queries of the list
        parts = 16
        asked = queries.mapInArrow(look, kinds).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        held = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        pairs = held.join(asked, ["list", "part"]).withColumn("distance", cosine_distance(F.col("query_vector"), F.col("vector")))
        return ranked(pairs, k, "key").withColumnRenamed("key", self.key)


def recall_of(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """``query_id, n_exact, n_found``: how many of each query's exact neighbours a search found."""
    hit = found.select("query_id", F.col(key).alias("found_key"), F.lit(1).alias("hit"))
    return exact.select("query_id", F.col(key).alias("found_key")).join(hit, ["query_id", "found_key"], "left").groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
