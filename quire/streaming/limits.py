"""Rate limits and timers as keyed state, in a stream and in a batch with the same fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources.tables import table

_STATE = "count long, until long"

#: Requests that a task of ``judged_spread`` sorts and joins.
TASK_ROWS = 250_000


class Limit:
    """At most ``most`` accepted requests until a window ends that opens with the first (or, with ``rearm``, with each) accepted one."""

    def __init__(self, most: int, seconds: int, rearm: bool = False):
        self.most, self.seconds, self.rearm = most, seconds, rearm

    def fold(self, times: list[int], count: int = 0, until: int = -(1 << 62)) -> tuple[list[bool], int, int]:
        allowed = []
        for t in times:
            if t >= until:
                count, until = 0, t + self.seconds
            ok = count < self.most
            allowed.append(ok)
            if ok:
                count += 1
                if self.rearm:
                    until = t + self.seconds
        return allowed, count, until


#: Searches: ten, each accepted one re-arms a minute. Exports: one a minute. Requests: a fixed hour.
SEARCH, EXPORT = Limit(10, 60, rearm=True), Limit(1, 60)


def judged(requests: DataFrame, limit: Limit, key: str = "key") -> DataFrame:
    """Batch form: ``requests`` (key, at_s, event_id) plus ``allowed``, in order of time within each key.

    Rows of a key arrive sorted and are folded in Arrow batches with two numbers of state, so a hot key
    needs no more memory than a quiet one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count, until = None, 0, -(1 << 62)
        for rows in batches:
            allowed = []
            for k, part in rows.groupby(key, sort=False):
                if k != last:
                    last, count, until = k, 0, -(1 << 62)
                found, count, until = limit.fold(part["at_s"].tolist(), count, until)
                allowed += found
            yield rows.assign(allowed=allowed)

    schema = ", ".join(f"`{c}` {t}" for c, t in requests.dtypes)
    return requests.repartition(key).sortWithinPartitions(key, "at_s", "event_id").mapInPandas(run, f"{schema}, allowed boolean")


def _dealt(rows: DataFrame, tasks: int | None, *on: str) -> DataFrame:
    """``rows`` by these columns in so many tasks at least; ``None`` leaves their number to Spark."""
    return rows.repartition(tasks, *on) if tasks else rows


def _met(left: DataFrame, right: DataFrame, on: list[str], tasks: int | None, how: str = "inner") -> DataFrame:
    """A join by sorting in so many tasks; requests compress so well that Spark, going by bytes, would broadcast millions of them or join them in few tasks."""
    return _dealt(left, tasks, *on).join(_dealt(right, tasks, *on).hint("merge"), on, how)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different rows of each batch; no task holds more than one."""
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names).aggregate([]).to_batches()


def judged_spread(requests: DataFrame, limit: Limit, key: str = "key") -> DataFrame:
    """Like ``judged``, for keys of any share of the rows: one key's requests spread over all tasks.

    A request that opens a window says which one opens the next: a pointer. Where each window begins is
    the path of pointers from a key's first request; it is followed by doubling: each round doubles
    how far all pointers reach and so the known part of the path. Requests are numbered within their key by a
    range-partitioned sort, and pointers meet their targets in another. Equal requests go in one order throughout.
    Beyond ``TASK_ROWS`` for each core, tasks are as many as the requests need, so that each has about so many of them.
    """
    given = table(requests.withColumn("_row", F.monotonically_increasing_id()), "requests")
    known, key = key, "_key"  # a null key is one of its own
    keyed = given.withColumn(key, F.coalesce(F.concat(F.lit("="), F.col(known).cast("string")), F.lit("")))
    order = [F.col(key), F.col("at_s"), F.col("event_id"), F.col("_row")]
    needed = -(-given.count() // TASK_ROWS)
    tasks = needed if needed > given.sparkSession.sparkContext.defaultParallelism else None
    parts = table(keyed.select(key, "at_s", "event_id", "_row").repartitionByRange(*([tasks] if tasks else []), *order).withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    sizes = _dealt(parts.select(key, "_part"), tasks, key, "_part").groupBy(key, "_part").agg(F.count("*").alias("n"))
    starts = _dealt(sizes, tasks, key).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(key, "_part").orderBy("at_s", "event_id", "_row"))
    placed = _met(parts, table(starts, "starts"), [key, "_part"], tasks).withColumn("within", within)
    placed = table(placed.select(key, "at_s", "_row", (F.col("start") + F.col("within") - 1).alias("n")), "placed")

    pointers = table(_pointers(placed, limit, key, tasks), "pointers")
    opened = placed.filter("n = 0").select(key, "n")
    # only requests that some pointer names can be on the path
    named = pointers.select(key, F.col("next").alias("n")).union(opened).mapInArrow(_once, f"`{key}` string, n long")
    pointers = table(_met(pointers, named, [key, "n"], tasks, "left_semi"), "pointers")
    while True:
        further = table(_met(opened, pointers, [key, "n"], tasks).select(key, F.col("next").alias("n")), "further")
        if further.isEmpty():
            break
        opened = table(opened.unionByName(further), "opened")
        ahead = pointers.select(key, F.col("n").alias("next"), F.col("next").alias("after"))
        pointers = table(_met(pointers, ahead, [key, "next"], tasks).select(key, "n", F.col("after").alias("next")), "pointers")
    accepted = _dealt(opened.select(key, F.explode(F.sequence(F.col("n"), F.col("n") + limit.most - 1)).alias("n")), tasks, key, "n").distinct()
    told = _met(placed, accepted.withColumn("allowed", F.lit(True)), [key, "n"], tasks, "left").select("_row", F.coalesce("allowed", F.lit(False)).alias("allowed"))
    return _met(given, told, ["_row"], tasks).drop("_row")


def _pointers(placed: DataFrame, limit: Limit, key: str, tasks: int | None) -> DataFrame:
    """key, ``n, next``: if a window opened at the n-th request of a key, which request would open the next; no row where none does."""
    shifted = lambda by: placed.select(key, (F.col("n") - by).alias("n"), F.col("at_s").alias("then"))
    if not limit.rearm:
        return _first_from(placed, placed.select(key, "n", (F.col("at_s") + limit.seconds).alias("from_s")), key, tasks)
    # a pause of a whole window ends it early; else it is over a window's length after the last one that it accepts
    paused = _met(placed, shifted(-1), [key, "n"], tasks).filter(F.col("at_s") - F.col("then") >= limit.seconds).select(key, F.col("n").alias("next"))
    reach = F.sequence(F.greatest(F.col("next") - limit.most + 1, F.lit(0)), F.col("next") - 1)
    early = _dealt(paused.filter(F.lit(limit.most > 1)).select(key, F.explode(reach).alias("n"), "next"), tasks, key, "n").groupBy(key, "n").agg(F.min("next").alias("next"))
    full = _met(_met(placed, early, [key, "n"], tasks, "left_anti"), shifted(limit.most - 1), [key, "n"], tasks).select(key, "n", (F.col("then") + limit.seconds).alias("from_s"))
    return early.unionByName(_first_from(placed, full, key, tasks))


def _first_from(placed: DataFrame, asked: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """key, ``n, next``: the first request of the key at or after ``from_s``; both are sorted together, and what a part cannot tell is told by those after it."""
    both = asked.select(F.col(key).alias("key"), F.col("from_s").alias("s"), F.lit(0).alias("event"), "n").unionByName(placed.select(F.col(key).alias("key"), F.col("at_s").alias("s"), F.lit(1).alias("event"), "n"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        headed = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if rest is not None and rest.num_rows:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            event = batch.column(2).to_numpy(zero_copy_only=False) == 1
            n = batch.column(3).to_numpy(zero_copy_only=False)
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            # the first request of each key in this part, for questions that the parts before leave open
            firsts = np.flatnonzero(event)[np.unique(codes[event], return_index=True)[1]]
            firsts = firsts[[batch.column(0)[int(i)].as_py() != headed for i in firsts]]
            if len(firsts):
                heads = pa.array(firsts)
                yield pa.record_batch([batch.column(0).take(heads), pa.nulls(len(firsts), pa.int64()), batch.column(3).take(heads), batch.column(3).take(heads)], ["key", "s", "n", "next"])
                headed = batch.column(0)[int(firsts.max())].as_py()
            places = np.arange(len(n))
            ahead = np.minimum.accumulate(np.where(event, places, len(n))[::-1])[::-1]
            told = np.where(ahead < len(n), codes[np.minimum(ahead, len(n) - 1)] == codes, False)
            # another key's event, or none, follows: settled if a later key has begun, else wait for more rows
            open_ = ~told & (codes == codes[-1]) & ~event
            yield _answers(batch, ~event & ~open_, np.where(told, n[np.minimum(ahead, len(n) - 1)], -1))
            rest = batch.take(pa.array(np.flatnonzero(open_)))
        if rest is not None and rest.num_rows:
            yield _answers(rest, np.ones(rest.num_rows, bool), np.full(rest.num_rows, -1))

    def _answers(batch: pa.RecordBatch, some: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(some)
        found = following[at]
        return pa.record_batch([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), batch.column(3).take(pa.array(at)), pa.array(found, pa.int64(), mask=found < 0)], ["key", "s", "n", "next"])

    sorted_ = both.repartitionByRange(*([2 * tasks] if tasks else []), "key", "s", "event", "n").sortWithinPartitions("key", "s", "event", "n")
    filled = table(sorted_.mapInArrow(fill, "`key` string, s long, n long, next long").withColumn("part", F.spark_partition_id()), "filled")
    told = filled.filter("s is not null")
    # open at the end of a part: the key's first request in a later one; a key has few such parts and questions
    heads = filled.filter("s is null").select("key", F.col("part").alias("later"), F.col("next").alias("first"))
    late = told.filter("next is null").select("key", "n", "part")
    resolved = _met(late, heads, ["key"], tasks).filter("later > part").groupBy("key", "n").agg(F.min("first").alias("next"))
    out = told.filter("next is not null").select("key", "n", "next").unionByName(resolved)
    return out.select(F.col("key").alias(key), "n", "next")


def judged_stream(requests: DataFrame, limit: Limit, key: str = "key") -> DataFrame:
    """Stream form: state per key, dropped when its window has passed."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at_s", "event_id"])
        count, until = state.get if state.exists else (0, -(1 << 62))
        allowed, count, until = limit.fold(rows["at_s"].tolist(), count, until)
        state.update((count, until))
        state.setTimeoutDuration(limit.seconds * 1000)
        yield pd.DataFrame({key: keys[0], "at_s": rows["at_s"], "event_id": rows["event_id"], "allowed": allowed})

    return requests.groupBy(key).applyInPandasWithState(step, f"{key} string, at_s long, event_id long, allowed boolean", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def uploads_once(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Uploads of a stream, each hash once within the watermark (beyond the reference)."""
    return stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["file_hash"])


def activity(stream: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Audit events per window and action, late ones up to the watermark (beyond the reference)."""
    return stream.withWatermark("at", watermark).groupBy(F.window("at", window), "action").agg(F.count("*").alias("n"))
