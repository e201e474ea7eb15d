"""Packing into fixed windows by minimum bin slack.

Texts are encoded and cut where they are read: whole windows first, then one remainder
shorter than a window. Only the histogram of remainder lengths, which has fewer entries
than the window has ids whatever the corpus, reaches the driver. There each window is
filled around the longest remainder left with the multiset of lengths that comes closest to
capacity (subset sums as bits of one integer, counts found by tracking back), and a multiset
is used as often as the counts allow. Tasks then find each piece's place from its rank
among the pieces of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import names_apart, table, text_batches
from quire.llm.tokens import END_ID, encoder

CAPACITY = 2048


def cut_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: each text's ids and the end id, cut every ``capacity`` ids.

    ``ids`` are little-endian unsigned 32-bit integers. Null and empty texts are the end id alone.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            doc, start, ids, total = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ids = encode(text) + end
                for at in range(0, len(all_ids), 4 * capacity):
                    doc.append(key)
                    start.append(at // 4)
                    ids.append(all_ids[at : at + 4 * capacity])
                    total.append(len(all_ids) // 4)
            yield pa.record_batch(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths, each at most ``counts`` times, whose sum is closest to ``room`` from below."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:  # times 1, 2, 4, ... and the rest make every count up to the limit
            take = min(times, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, times = left - take, 2 * times
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: count})`` until all pieces are placed; each round uses up the longest length or its partner."""
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        longest = max(left)
        others = left | {longest: left[longest] - 1}
        used = closest_fill({n: c for n, c in others.items() if c}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // c for n, c in used.items())
        out.append((times, used))
        left = {n: c - times * used.get(n, 0) for n, c in left.items() if c > times * used.get(n, 0)}
    return out


class _Places:
    """For the k-th piece of a length: its window and its place there."""

    def __init__(self, fills: list[tuple[int, dict[int, int]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        window = 0
        for times, used in fills:
            offset = 0
            for length in sorted(used, reverse=True):
                rank = ranks.get(length, 0)
                runs.setdefault(length, []).append((rank, window, used[length], offset))
                ranks[length] = rank + times * used[length]
                offset += length * used[length]
            window += times
        self.windows = window
        self.runs = {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for n in np.unique(length):
            some = np.flatnonzero(length == n)
            first, base, each, at = self.runs[int(n)]
            run = np.searchsorted(first, rank[some], "right") - 1
            turn, slot = np.divmod(rank[some] - first[run], each[run])
            window[some], offset[some] = base[run] + turn, at[run] + slot * n
        return window, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``; other columns stay) plus ``sequence_id`` and ``offset``.

    Windows are gapless from 0. Ids of windows are unique, not consecutive. No pieces, no rows.
    """
    piece, part_name, within_name, before_name, place_name = names_apart(pieces, "piece", "part", "within", "before", "place")
    rows = table(pieces.withColumn(piece, F.monotonically_increasing_id()), "pieces")
    rest = rows.filter(F.col("length") < capacity)
    histogram = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}  # at most capacity - 1 rows
    places = _Places(minimum_bin_slack(histogram, capacity))
    # ranks by length without gathering a length: within each written part, plus the counts of the parts before
    part = F.shiftright(piece, 33)
    parts = rest.withColumn(part_name, part).groupBy("length", part_name).count()
    before = Window.partitionBy("length").orderBy(part_name).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", part_name, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(before_name))
    within = F.row_number().over(Window.partitionBy("length", part_name).orderBy(piece)) - 1
    ranked = rest.withColumn(part_name, part).withColumn(within_name, within).join(parts, ["length", part_name])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        window, offset = places.of(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": window, "offset": offset})

    placed = ranked.withColumn(place_name, place("length", F.col(within_name) + F.col(before_name)))
    full = rows.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col(piece) + places.windows, "offset": F.lit(0).cast("long")})
    columns = [*pieces.columns, "sequence_id", "offset"]
    placed = placed.withColumns({"sequence_id": F.col(place_name)["sequence_id"], "offset": F.col(place_name)["offset"]})
    return full.select(*columns).unionByName(placed.select(*columns))
