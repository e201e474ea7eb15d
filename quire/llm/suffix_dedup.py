"""Removal of repeated passages with a run-length index.

A passage of ``length`` bytes that stands in two places holds, in both and at the same distance from
its start, the same anchor: the ``ANCHOR`` bytes with the least hash within it. So only anchors that
occur more than once matter, with what surrounds them (their contexts). Contexts that are equal as a
whole are repeats throughout and settle by their hashes alone. The others of an anchor go to an index,
aligned on the anchor: their Burrows-Wheeler transform is built column by column and kept as runs.
Within a run the rows stay neighbours, so their common prefix grows by one; it is sampled anew only at
run ends, as a minimum over the rows between. So the matching statistics of every context against the
others of its anchor stream from right to left, and where they reach ``length`` a passage repeats.

Only hashes and places move between machines, then each differing context once. An anchor that is
frequent is counted with map-side combining; one with more different contexts than an index holds is
settled by digests of its passages instead, which spread over all tasks.

Texts of which there are copies are one class, read once; the whole of each is a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_or_shuffled, table, text_of
from quire.llm.hashes import grams, mix, stretches

#: Bytes of a passage that may stand in one place only.
LENGTH = 200
#: Bytes of an anchor.
ANCHOR = 100
#: Contexts of one anchor that an index holds at most, and contexts that are indexed together.
MOST, TOGETHER = 20_000, 40_000
#: Share of all anchors from which one is counted apart; at most 1 / SUPPORT are.
SUPPORT = 1e-4
#: Starts of passages that are settled together for an anchor with more than MOST contexts.
RANGE = 10
#: Entries (some 30 bytes each) up to which a list of classes or spans is broadcast to the texts; contexts are always fetched by a shuffle.
BROADCAST = 1_000_000


def least_in_windows(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` values in a row, from the least so far in blocks, both ways."""
    n = len(values)
    padded = np.full(-(-n // size) * size, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    ahead = np.minimum.accumulate(padded.reshape(-1, size), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, size)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - size + 1], ahead[size - 1 : n])


def anchors(data: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: least of their passage for at least one passage (all of them in a tie)."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, width = grams(data, size), length - size + 1
    least = least_in_windows(hashes, width)
    # a place is chosen if, of the windows that hold it, one has its hash as least; no least is above it
    edge = np.zeros(width - 1, np.uint64)
    highest = ~least_in_windows(~np.concatenate([edge, least, edge]), width)
    at = np.flatnonzero(highest == hashes)
    return at, hashes[at]


def without_periods(at: np.ndarray, hashes: np.ndarray, length: int, size: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which anchors to keep, and the stretches in which one unit of at most ``size / 2`` bytes repeats.

    Equal anchors that close to each other have the same period, so each passage of such a stretch also
    starts one period on or back. Only anchors near its two ends see anything else.
    """
    keep, spans = np.ones(len(at), bool), []
    if len(at) < 3:
        return keep, spans
    linked = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (np.diff(at) <= size // 2), [False]])
    begins, ends = np.flatnonzero(~linked[:-1] & linked[1:]), np.flatnonzero(linked[:-1] & ~linked[1:])
    for i, j in zip(begins.tolist(), ends.tolist(), strict=True):
        if at[j] - at[i] >= 2 * length:
            spans.append((int(at[i]), int(at[j]) + size))
            keep[i : j + 1] = (at[i : j + 1] < at[i] + length) | (at[i : j + 1] > at[j] - length)
    return keep, spans


def _anchored(texts: DataFrame, length: int, size: int) -> DataFrame:
    """``class, place, hash, key``: the anchors of each text, ``key`` a hash of the context; or, if ``periodic``, a stretch from ``place`` to ``key``."""
    span = length - size

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            classes, places, hashes, keys, periodic = [], [], [], [], []
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                at, found = anchors(data, length, size)
                keep, spans = without_periods(at, found, length, size)
                at, found = at[keep], found[keep]
                starts, ends = np.maximum(at - span, 0), np.minimum(at + length, len(data))
                around = stretches(data, starts, ends) if len(at) else found
                classes.append(np.full(len(at) + len(spans), cls))
                places += [at, np.array([a for a, _ in spans], np.int64)]
                hashes += [found.view(np.int64), np.zeros(len(spans), np.int64)]
                keys += [mix(around ^ mix((at - starts + (ends - at) * 65536).astype(np.uint64))).view(np.int64), np.array([b for _, b in spans], np.int64)]
                periodic += [np.zeros(len(at), bool), np.ones(len(spans), bool)]
            if not classes:
                continue
            yield pa.record_batch(
                [pa.array(np.concatenate(classes)), pa.array(np.concatenate(places).astype(np.int32)), *(pa.array(np.concatenate(x)) for x in (hashes, keys, periodic))],
                ["class", "place", "hash", "key", "periodic"],
            )

    return texts.mapInArrow(anchored, "class long, place int, hash long, key long, periodic boolean")


#: What is known of an anchor's place: a periodic stretch; a context that repeats throughout, alone or also as one to compare with; one to compare; to be counted apart.
PERIOD, WHOLE, WITNESS, ALONE, FREQUENT = range(5)
_PLACES = "class long, place int, hash long, key long, kind int, contexts long"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places by kind, of rows ordered by hash, given kind (-1: not given) and key; anchors that occur once drop out."""
    rest = None

    def judge(hashes: np.ndarray, keys: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(hashes)
        new_hash = np.append(True, (hashes[1:] != hashes[:-1]) | (given[1:] != given[:-1]))
        new_key = new_hash | np.append(True, keys[1:] != keys[:-1])
        of_hash, of_key = np.cumsum(new_hash) - 1, np.cumsum(new_key) - 1
        alone = np.bincount(of_key)[of_key] == 1
        contexts = np.bincount(of_hash[new_key])[of_hash]
        opened = (np.bincount(of_hash, alone) > 0)[of_hash] & (contexts > 1)
        kind = np.full(n, WHOLE, np.int32)
        kind[opened & new_key] = WITNESS
        kind[opened & alone] = ALONE
        kind[alone & (contexts == 1)] = -1
        return np.where(given >= 0, given, kind), contexts

    def record(rows: list[np.ndarray]) -> pa.RecordBatch:
        kind, contexts = judge(rows[2], rows[3], rows[4])
        kept = kind >= 0
        return pa.record_batch([pa.array(x[kept]) for x in (*rows[:4], kind, contexts)], ["class", "place", "hash", "key", "kind", "contexts"])

    for batch in batches:
        if batch.num_rows:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if rest is None else [np.concatenate(both) for both in zip(rest, rows, strict=True)]
            cut = int(np.searchsorted(rows[2], rows[2][-1], "left"))
            if cut:
                yield record([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
    if rest is not None:
        yield record(rest)


def _places(anchored: DataFrame, support: float) -> DataFrame:
    """``_PLACES`` of the anchors that occur more than once, and of periodic stretches.

    Rows meet by anchor. Those that can make up more than ``support`` of all (found by Misra-Gries
    counters) are spread by place instead, and counted with map-side combining.
    """
    frequent = anchored.freqItems(["hash"], support).select(F.explode("hash_freqItems").alias("hash"))
    names = [r[0] for r in frequent.collect()]  # at most 1 / support
    heavy = anchored.sparkSession.createDataFrame([(n,) for n in names], "hash long").withColumn("frequent", F.lit(FREQUENT))
    given = F.when(F.col("periodic"), PERIOD).otherwise(F.coalesce("frequent", F.lit(-1)))
    spread = F.when(F.col("given") >= 0, F.xxhash64("class", "place")).otherwise(F.lit(0))
    dealt = anchored.join(F.broadcast(heavy), "hash", "left").select("class", "place", "hash", "key", given.alias("given"))
    dealt = dealt.repartition("hash", spread).sortWithinPartitions("hash", "given", "key")
    found = table(dealt.mapInArrow(_judged, _PLACES), "places")
    hot = found.filter(F.col("kind") == FREQUENT)
    groups = table(hot.groupBy("hash", "key").agg(F.count("*").alias("same"), F.min(F.struct("class", "place")).alias("first")), "frequent")
    sizes = groups.groupBy("hash").agg(F.count("*").alias("contexts"), F.max(F.col("same") == 1).alias("opened")).filter("contexts > 1 and opened")  # at most 1 / support
    kind = F.when(F.col("same") == 1, ALONE).otherwise(WITNESS)
    open_ = groups.join(F.broadcast(sizes), "hash").select("first.class", "first.place", "hash", "key", kind.alias("kind"), "contexts")
    once = groups.filter("same = 1").select("first.class", "first.place")
    whole = hot.join(once, ["class", "place"], "left_anti").withColumn("kind", F.lit(WHOLE))
    return found.filter(F.col("kind") != FREQUENT).unionByName(open_).unionByName(whole)


_CONTEXT = "hash long, class long, place int, alone boolean, big boolean, left int, context binary"


def _contexts(length: int, size: int):
    """The contexts of the wanted places of each text."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            lists = batch.column(2)
            flat = lists.flatten()
            at = flat.field("place").to_numpy(zero_copy_only=False)
            many = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts, out, k = np.maximum(at - (length - size), 0), [], 0
            for text, n in zip(batch.column(1).to_pylist(), many.tolist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [data[a:b] for a, b in zip(starts[k : k + n].tolist(), (at[k : k + n] + length).tolist(), strict=True)]
                k += n
            classes = np.repeat(batch.column(0).to_numpy(), many)
            columns = [flat.field("hash"), pa.array(classes), flat.field("place"), flat.field("alone"), flat.field("big"), pa.array((at - starts).astype(np.int32)), pa.array(out, pa.binary())]
            yield pa.record_batch(columns, ["hash", "class", "place", "alone", "big", "left", "context"])

    return contexts


class RunLengthIndex:
    """Contexts of anchors, aligned on the anchor, by their run-length Burrows-Wheeler transform.

    For each column ``k``, from the last to the first, the rows of a group are in the order of what they
    hold from ``k`` on, and the transform is the letters before ``k`` in that order, kept as runs. A step
    to the left moves whole runs: ordered by letter, they are the rows in the order of column ``k - 1``.
    Rows of a run stay neighbours, with one more letter in common; at the run's first row, and only
    there, the common prefix is sampled: the least one between it and the run of the same letter above.
    """

    def __init__(self, groups: np.ndarray, contexts: list[bytes], lefts: np.ndarray, length: int, size: int):
        self.length, self.span, width = length, length - size, 2 * length - size
        begins = self.span - lefts
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        padded = b"".join([b"\0" * a + c + b"\0" * (width - a - len(c)) for a, c in zip(begins.tolist(), contexts, strict=True)])
        # columns of letters from 1; 0 where a row has none, which equals nothing
        self.letters = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(-1, width).T).astype(np.uint16) + np.uint16(1)
        columns = np.arange(width)[:, None]
        self.letters[(columns < begins) | (columns >= begins + sizes)] = 0
        self.groups = groups.astype(np.int64)
        self.runs = 0

    def _step(self, order: np.ndarray, common: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(order)
        transform = self.groups[order] << 16 | self.letters[k][order]
        heads = np.flatnonzero(np.append(True, transform[1:] != transform[:-1]))
        self.runs += len(heads)
        head = transform[heads]
        moved = np.argsort(head, kind="stable")
        ends = np.append(heads[1:], n)
        sizes = (ends - heads)[moved]
        starts = np.cumsum(sizes) - sizes
        # where each row of the new order was
        was = np.repeat(heads[moved] - starts, sizes) + np.arange(n)
        value = common[was] + 1
        # samples: between the end of the run above of the same letter and this run's first row
        same = np.append(False, head[moved][1:] == head[moved][:-1]) & (head[moved] & 0xFFFF > 0)
        value[starts] = 0
        if same.any():
            run = moved[same]
            above = ends[moved[np.flatnonzero(same) - 1]]
            pairs = np.column_stack([above, heads[run] + 1]).ravel()
            least = np.minimum.reduceat(np.append(common, 0), pairs)[::2]
            value[starts[same]] = least + 1
        value[self.letters[k][order[was]] == 0] = 0
        return order[was], value

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first and the last column at which a passage starts that another row of its group has there too; -1 without any."""
        n = len(self.groups)
        order = np.argsort(self.groups, kind="stable")
        common = np.zeros(n, np.int64)
        first, last = np.full(n, -1), np.full(n, -1)
        for k in range(len(self.letters) - 1, -1, -1):
            order, common = self._step(order, common, k)
            if k <= self.span:
                far = common >= self.length
                rows = order[far | np.append(far[1:], False)]
                last[rows] = np.where(last[rows] < 0, k, last[rows])
                first[rows] = k
        return first, last


_SPAN = "class long, a int, b int"


def _indexed(length: int, size: int, together: int):
    """Stretches of the lone contexts that repeat, of rows ordered by anchor; several anchors share an index."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        some = pa.Table.from_batches(rows)
        column = lambda name: some[name].combine_chunks()
        hashes, lefts, alone = (column(c).to_numpy(zero_copy_only=False) for c in ("hash", "left", "alone"))
        groups = np.cumsum(np.append(0, hashes[1:] != hashes[:-1]))
        first, last = RunLengthIndex(groups, column("context").to_pylist(), lefts, length, size).repeated()
        found = np.flatnonzero((first >= 0) & alone)
        origin = column("place").to_numpy()[found] - (length - size)
        return pa.record_batch([pa.array(column("class").to_numpy()[found]), pa.array((origin + first[found]).astype(np.int32)), pa.array((origin + last[found] + length).astype(np.int32))], ["class", "a", "b"])

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in (b.slice(i, together) for b in batches for i in range(0, b.num_rows, together)):
            hashes = batch.column(0).to_numpy()
            if held and n >= together:
                # all rows up to the last change of anchor are whole groups
                before = held[-1].column(0)[-1].as_py()
                cut = int(np.argmax(hashes != before)) if (hashes != before).any() else len(hashes)
                held.append(batch.slice(0, cut))
                if cut < len(hashes):
                    yield settle(held)
                    held, n = [], 0
                batch = batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield settle(held)

    return indexed


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_DIGESTS = "hash long, class long, place int, alone boolean, low int, high int, core binary, hull binary"


def _digests(length: int, size: int, step: int):
    """For each context and each ``step`` distances of a passage's start from the anchor: digests of what all these passages hold, and of what any does."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            out = []
            for hash_, cls, place, alone, left, context, lows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for low in lows:
                    high = min(low + step - 1, length - size)
                    first, last = left - high, left - low  # starts of these passages in the context
                    if last < 0 or first + length > len(context):
                        continue
                    whole = first >= 0 and last + length <= len(context)
                    out.append((hash_, cls, place, alone, low, high, _digest(context[last : first + length]), _digest(context[first : last + length]) if whole else None))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["hash", "class", "place", "alone", "low", "high", "core", "hull"])

    return digests


def _settled(contexts: DataFrame, length: int, size: int, step: int) -> DataFrame:
    """``_DIGESTS`` rows with ``done``: all passages of these starts repeat, and ``open``: some may, in a lone context of the same core."""
    rows = table(contexts.mapInArrow(_digests(length, size, step), _DIGESTS), "digests")
    hulls = rows.filter("hull is not null").groupBy("hash", "low", "hull").agg(F.count("*").alias("n")).filter("n > 1").select("hash", "low", "hull", F.lit(True).alias("done"))
    judged = rows.join(hulls, ["hash", "low", "hull"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    if step == 1:
        return judged
    judged = table(judged, "judged")
    cores = judged.groupBy("hash", "low", "core").agg(F.count("*").alias("n"), F.max(F.col("alone") & ~F.col("done")).alias("open")).filter("n > 1 and open").select("hash", "low", "core", "open")
    return judged.join(cores, ["hash", "low", "core"], "left")


def _split(contexts: DataFrame, length: int, size: int, step: int = RANGE) -> DataFrame:
    """``_SPAN`` for anchors with more contexts than an index holds: by digests of stretches of starts, then of single starts where these differ."""
    columns = ["hash", "class", "place", "alone", "left", "context"]
    wide = _settled(contexts.select(*columns, F.array(*(F.lit(n) for n in range(0, length - size + 1, step))).alias("lows")), length, size, step)
    wide = table(wide, "ranges")
    starts = F.explode(F.sequence("low", "high")).alias("low")
    rest = wide.filter("open").select("class", "place", "hash", starts).groupBy("class", "place", "hash").agg(F.collect_list("low").alias("lows"))
    narrow = _settled(contexts.join(rest, ["class", "place", "hash"]).select(*columns, "lows"), length, size, 1)
    done = wide.select("class", "place", "alone", "low", "high", "done").unionByName(narrow.select("class", "place", "alone", "low", "high", "done"))
    return done.filter("done and alone").select("class", (F.col("place") - F.col("high")).alias("a"), (F.col("place") - F.col("low") + length).alias("b"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the stretches of which overlapping or adjoining ones are one, in order and within the text."""
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten()
        a, b = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        order = np.lexsort((a, of))
        a, b, of = a[order], np.minimum(b[order], batch.column(1).to_numpy()[of]), of[order]
        # ends so far within a text: texts are told apart by an offset beyond any place
        reach = np.maximum.accumulate(b + (of << 32)) if len(b) else b
        first = np.append(True, (a[1:] + (of[1:] << 32)) > reach[:-1])[: len(a)]
        starts = np.flatnonzero(first)
        ends = (reach[np.append(starts[1:] - 1, len(a) - 1)[: len(starts)]] & 0xFFFFFFFF) if len(a) else b
        spans = pa.StructArray.from_arrays([pa.array(a[starts].astype(np.int32)), pa.array(ends.astype(np.int32))], ["a", "b"])
        counts = np.bincount(of[starts], minlength=batch.num_rows) if len(a) else np.zeros(batch.num_rows, np.int64)
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), spans)], ["class", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of what is left of each text."""
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            ends = [0, *(x for s in spans for x in (s["a"], s["b"])), len(data)]
            out.append(hashlib.sha256(b"".join([data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)])).hexdigest())
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(out, pa.string())], ["class", "spans", "kept"])


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, size: int = ANCHOR, most: int = MOST, together: int = TOGETHER, support: float = SUPPORT, broadcast: int = BROADCAST
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` removed (``a`` to ``b``, in bytes), ``kept_sha256``.

    A byte goes if any passage of ``length`` bytes over it also starts at another place, of the same or
    of another document; passages are judged on the input and never cross documents. Null and empty
    texts have no bytes. Of rows with equal texts each is the other's repeat. Long stretches of one
    repeated unit are repeats of themselves. ``kept_sha256`` is of the bytes left. An empty table gives
    no rows; columns beyond the two are not read.
    """
    text = text_of(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = table(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    classes = table(rows.groupBy("digest").agg(F.min(rep).alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes")).withColumn("class", F.monotonically_increasing_id()), "classes")
    reps = classes.filter(F.col("n_bytes") >= length).select("class", "digest", F.col("rep.doc_id").alias("rep_id"))

    def read(some: DataFrame, entries: int | None, *columns: str) -> DataFrame:
        """The texts of some classes, with columns of theirs."""
        same = (texts["digest"] == some["digest"]) & texts["doc_id"].eqNullSafe(some["rep_id"])
        both = texts.hint("merge").join(some, same) if entries is None else small_or_shuffled(texts, some, same, "inner", entries, broadcast)
        return both.select("class", "text", *columns)

    def count(lists: DataFrame, name: str) -> int:
        return lists.agg(F.sum(F.size(name)) + F.count("*")).first()[0] or 0

    places = _places(_anchored(read(reps, 2 * reps.count()), length, size), support)
    wanted = places.filter(F.col("kind").isin(WITNESS, ALONE)).select("class", F.struct("place", "hash", (F.col("kind") == ALONE).alias("alone"), (F.col("contexts") > most).alias("big")).alias("x"))
    wanted = table(wanted.groupBy("class").agg(F.collect_list("x").alias("wanted")).join(reps, "class"), "wanted")
    contexts = table(read(wanted, None, "wanted").mapInArrow(_contexts(length, size), _CONTEXT), "contexts", "zstd")
    small = contexts.filter("not big").select("hash", "class", "place", "alone", "left", "context").repartition("hash").sortWithinPartitions("hash")
    spans = small.mapInArrow(_indexed(length, size, together), _SPAN)
    big = contexts.filter("big")
    if not big.isEmpty():
        spans = spans.unionByName(_split(big, length, size))
    periodic = F.col("kind") == PERIOD
    a = F.when(periodic, F.col("place")).otherwise(F.greatest(F.col("place") - (length - size), F.lit(0)))
    b = F.when(periodic, F.col("key").cast("int")).otherwise(F.col("place") + length)
    throughout = places.filter(F.col("kind").isin(PERIOD, WHOLE, WITNESS)).select("class", a.alias("a"), b.alias("b"))
    gone = spans.unionByName(throughout).groupBy("class").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    gone = gone.join(classes.select("class", "n_bytes"), "class").select("class", "n_bytes", "spans")
    gone = table(gone.mapInArrow(_merged, "class long, spans array<struct<a:int,b:int>>").join(reps, "class"), "gone")
    parts = read(gone, count(gone, "spans"), "spans").mapInArrow(_cut, "class long, spans array<struct<a:int,b:int>>, kept string").dropDuplicates(["class"])
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    result = classes.join(parts, "class", "left").select(
        "digest",
        F.when(copied, F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))).alias("spans"),
        F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    return rows.join(result, "digest").select(F.col("doc_id").alias(id_col), "n_bytes", "spans", "kept_sha256")
