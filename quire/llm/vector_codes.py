"""Vector codes: product quantisation by Lloyd's rounds with Hamerly's bounds, in integers.

A vector's components become integers and are cut into ``parts`` equal parts; each part has its
codebook, and a vector is stored as one entry number a part. Codebooks are of a fixed size (parts x
entries x components of a part), so they go to every task; the vectors never leave the tables.

Each round writes, beside a vector's integers, its entry numbers and two bounds a part: an upper one
on the distance to its entry and a lower one on the distance to the nearest other entry. Entries that
moved loosen the bounds by how far they went; a part is compared with its own entry, and then with
all entries, only where the upper bound is not strictly below both the lower one and half the way to
the nearest other entry. A tie never passes a strict comparison, so ties are always scanned and go to
the lower number. Square roots and sums of bounds are rounded away from each other, so that the
result is exactly that of full scans in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task compares at once.
SLICE = 1024
#: Different labels that are sent to all tasks; more are joined by a shuffle, but for hot ones.
LABELS = 100_000
_STATE = "vec_id long, label string, v array<long>, code binary, upper array<double>, lower array<double>"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of integers: nearest entry, the least number of equal ones, and both bounds."""
    squares = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    own, rows = squares.argmin(axis=1), np.arange(len(x))
    near = squares[rows, own]
    squares[rows, own] = np.iinfo(np.int64).max
    second = _down(np.sqrt(squares.min(axis=1).astype(float))) if len(book) > 1 else np.full(len(x), np.inf)
    return own, _up(np.sqrt(near.astype(float))), second


@dataclass(frozen=True)
class Moved:
    """A part's codebook, how far its entries moved at most, and half the way to each entry's nearest other one."""

    book: np.ndarray
    far: np.ndarray
    others: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, old: np.ndarray, new: np.ndarray) -> Moved:
        far = _up(np.sqrt(((new - old) ** 2).sum(axis=1).astype(float)))
        others = np.array([np.delete(far, k).max(initial=0.0) for k in range(len(new))])
        apart = ((new[:, None, :] - new[None]) ** 2).sum(axis=2).astype(float)
        np.fill_diagonal(apart, np.inf)
        return cls(new, far, others, _down(np.sqrt(apart.min(axis=1)) / 2))


def reassigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: Moved) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Entries and bounds of a part's rows after its codebook moved, and how many rows had to be scanned."""
    own, upper, lower = own.copy(), _up(upper + moved.far[own]), _down(lower - moved.others[own])
    enough = np.maximum(lower, moved.half[own])
    unsure = np.flatnonzero(~(upper < enough))
    exact = ((x[unsure] - moved.book[own[unsure]]) ** 2).sum(axis=1)
    upper[unsure] = _up(np.sqrt(exact.astype(float)))
    unsure = unsure[~(upper[unsure] < enough[unsure])]
    if len(unsure):
        own[unsure], upper[unsure], lower[unsure] = scan(x[unsure], moved.book)
    return own, upper, lower, len(unsure)


def _matrix(column: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _record(batch: pa.RecordBatch, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array(list(bounds), pa.list_(pa.float64())) for bounds in (upper, lower)]
    codes = pa.array([row.tobytes() for row in own.astype(np.uint8)], pa.binary())
    return pa.record_batch([*batch.columns[:3], codes, *lists], ["vec_id", "label", "v", "code", "upper", "lower"])


def _first_scan(books: np.ndarray):
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            x = _matrix(batch.column(2), parts * width)
            found = [scan(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            yield _record(batch, *(np.stack(each, axis=1) for each in zip(*found, strict=True)))

    return assign


def _next_scan(old: np.ndarray, new: np.ndarray):
    parts, _, width = new.shape
    moved = [Moved.of(old[p], new[p]) for p in range(parts)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            x = _matrix(batch.column(2), parts * width)
            own = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            upper, lower = (_matrix(batch.column(k), parts, float) for k in (4, 5))
            found = [reassigned(x[:, p * width : (p + 1) * width], own[:, p], upper[:, p], lower[:, p], moved[p])[:3] for p in range(parts)]
            yield _record(batch, *(np.stack(each, axis=1) for each in zip(*found, strict=True)))

    return assign


def _sums(shape: tuple[int, int, int]):
    """A task's counts and component sums of all entries: one row an entry that is in use."""
    parts, entries, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), parts * width).reshape(-1, parts, width)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                counts[p] += np.bincount(own[:, p], minlength=entries)
                np.add.at(sums[p], own[:, p], x[:, p])
        at, entry = np.nonzero(counts)
        columns = [pa.array(at, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[at, entry]), pa.array(list(sums[at, entry]), pa.list_(pa.int64()))]
        yield pa.record_batch(columns, ["part", "entry", "n", "sums"])

    return add


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its parts' mean; unused entries stay. At most parts x entries rows reach the driver."""
    width = books.shape[2]
    told = state.select("v", "code").mapInArrow(_sums(books.shape), "part int, entry int, n long, sums array<long>")
    # sums of sums can pass 64 bits where no distance does
    whole = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for row in whole.collect():
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return out


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int, scale: int) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the vectors that can be coded, and how many components they have."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") > 0))
    rows = rows.filter(finite & (F.size("x") % parts == 0))
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = sizes["size"] if sizes else parts
    most = isqrt(2**61 // size)  # beyond it squared distances leave 64 bits
    rows = rows.filter((F.size("x") == size) & F.forall("x", lambda c: F.abs(c * scale) < most))
    return table(rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")), "integers"), size


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, and the codebooks (parts x entries x components of a part).

    Rows: ``vec_id``, ``label``, ``code`` (a byte a part), ``error`` (squared distance to the coded vector). Component x is
    the integer floor(scale * x). Codebooks start as the parts of the vectors of the least ids (of
    equal ids, the least integers; null ids last), fewer where there are fewer vectors. Left out are
    null vectors, those with null or non-finite components or components so large that a squared
    distance leaves 64 bits, and those whose length is not the commonest that ``parts`` divides. Of
    equal distances the lower entry counts; equal vectors have equal codes; an empty table gives no
    rows and empty codebooks. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is one byte")
    rows, size = integers(vectors, id_col, vector_col, label_col, parts, scale)
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(entries).select("v").collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2).copy()
    if not first:
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    state = table(rows.mapInArrow(_first_scan(books), _STATE), "state")
    for _ in range(rounds):
        new = _updated(state, books)
        state, books = table(state.mapInArrow(_next_scan(books, new), _STATE), "state"), new
    return state.select("vec_id", "label", "code", "v").mapInArrow(_errors(books), "vec_id long, label string, code binary, error long"), books


def _errors(books: np.ndarray):
    parts, _, width = books.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3), parts * width).reshape(-1, parts, width)
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            error = ((x - books[np.arange(parts), own]) ** 2).sum(axis=(1, 2))
            yield pa.record_batch([*batch.columns[:3], pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return measure


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """The vectors that the codes stand for: the middle of each component's integer, as ``embedding``."""
    parts, _, width = books.shape

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            x = (books[np.arange(parts), own].reshape(-1, parts * width) + 0.5) / scale
            yield pa.record_batch([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(look_up, "vec_id long, embedding array<double>")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of errors over equal labels (nulls together) as ``label_error``.

    Sums combine before the shuffle. Few labels go to all tasks; of many, those of over a thousandth of
    the rows do (at most a thousand), and the others are joined by a shuffle, where none is hot.
    """
    codes = table(codes, "codes")
    sums = table(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    known = sums.select(F.col("label").alias("known"), "label_error")
    on = F.col("label").eqNullSafe(F.col("known"))
    if sums.count() <= LABELS:
        return codes.join(F.broadcast(known), on).drop("known")
    hot = sums.filter(F.col("n") * 1000 > codes.count()).select(F.col("label").alias("known"), "label_error")
    often, rest = codes.join(F.broadcast(hot), on).drop("known"), codes.join(F.broadcast(hot), on, "left_anti")
    return often.unionByName(rest.join(known, on).drop("known"))
